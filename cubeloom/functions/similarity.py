"""String similarity for look-ups. Small helpers that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np

# Weights of the combined score.
TOKEN_WEIGHT = 0.95
NEAR_LENGTHS = 1.5
FAR_LENGTHS = 8.0
PARTIAL_WEIGHT = 0.9
FAR_PARTIAL_WEIGHT = 0.6


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per letter of ``a``."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(a):
        masks[letter] = masks.get(letter, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        hit = row & masks.get(letter, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of letters that need neither insertion nor deletion, 0 to 100."""
    total = len(a) + len(b)
    return 100.0 * 2 * _common(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any stretch of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    size = len(short)
    if not size:
        return 0.0
    if short in long:
        return 100.0
    stretches = {long[max(0, i) : i + size] for i in range(1 - size, len(long))}
    return max(ratio(short, s) for s in stretches)


def _tokens(text: str) -> list[str]:
    return sorted(text.split())


def _set_forms(a: str, b: str) -> tuple[str, str, str]:
    left, right = set(a.split()), set(b.split())
    shared = " ".join(sorted(left & right))
    return shared, " ".join(sorted(left - right)), " ".join(sorted(right - left))


def token_ratio(a: str, b: str) -> float:
    """Ratio that does not depend on word order or on repeated words."""
    shared, only_a, only_b = _set_forms(a, b)
    if shared and (not only_a or not only_b):
        return 100.0
    best = ratio(" ".join(_tokens(a)), " ".join(_tokens(b)))
    with_a, with_b = f"{shared} {only_a}".strip(), f"{shared} {only_b}".strip()
    best = max(best, ratio(with_a, with_b))
    if shared:
        best = max(best, ratio(shared, with_a), ratio(shared, with_b))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    shared, only_a, only_b = _set_forms(a, b)
    if shared:
        return 100.0
    return max(partial_ratio(" ".join(_tokens(a)), " ".join(_tokens(b))), partial_ratio(only_a, only_b))


def score(query: str, label: str) -> float:
    """Weighted best of the ratios above, by how far the lengths are apart."""
    if not query or not label:
        return 0.0
    apart = max(len(query), len(label)) / min(len(query), len(label))
    best = ratio(query, label)
    if apart < NEAR_LENGTHS:
        return max(best, TOKEN_WEIGHT * token_ratio(query, label))
    weight = PARTIAL_WEIGHT if apart <= FAR_LENGTHS else FAR_PARTIAL_WEIGHT
    return max(
        best,
        weight * partial_ratio(query, label),
        TOKEN_WEIGHT * weight * partial_token_ratio(query, label),
    )


#: Letters are counted in so many groups; letters that share one only raise a bound.
GROUPS = 64


@dataclass
class Profile:
    """What bounds are reckoned from, for some texts: letters by group, lengths of the forms that are compared, words."""

    letters: np.ndarray
    length: np.ndarray
    sorted_length: np.ndarray
    set_length: np.ndarray
    gaps: np.ndarray
    words: list[set[str]]


def profile(texts: Sequence[str]) -> Profile:
    """The letters exclude white space; ``gaps`` counts the spaces between sorted words."""
    split = [t.split() for t in texts]
    letters = np.zeros((len(texts), GROUPS), np.int32)
    for i, parts in enumerate(split):
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4") % GROUPS
        letters[i] = np.bincount(codes, minlength=GROUPS)
    number = lambda values: np.fromiter(values, np.int64, len(texts))
    words = [set(p) for p in split]
    return Profile(
        letters, number(len(t) for t in texts), number(len(" ".join(p)) for p in split), number(len(" ".join(w)) for w in words),
        number(max(len(p) - 1, 0) for p in split), words,
    )


def score_bounds(query: Profile, texts: Profile) -> np.ndarray:
    """For each text a number that ``score`` of the one query in ``query`` with it can't exceed.

    No common subsequence is longer than the letters two texts share, whatever
    their order. A stretch of k letters that holds c of them gives at most
    ``2c / (size + k)``, which is largest where k is c. With shared words the word
    forms that hold nothing else are reckoned as they are.
    """
    size = int(query.length[0])
    if not size:
        return np.zeros(len(texts.length))
    shared = np.minimum(query.letters[0], texts.letters).sum(axis=1)
    length = texts.length
    space_q, space_t = size - query.letters[0].sum(), length - texts.letters.sum(axis=1)
    whole = shared + np.minimum(space_q, space_t)
    ordered = shared + np.minimum(query.gaps[0], texts.gaps)
    least = lambda own, other: np.minimum(own, other)
    sets = np.minimum(ordered, least(query.set_length[0], texts.set_length))
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = 200.0 * whole / (size + length)
        near = np.maximum(200.0 * ordered / (query.sorted_length[0] + texts.sorted_length), 200.0 * sets / (query.set_length[0] + texts.set_length))
        part = 200.0 * whole / (least(size, length) + whole)
        part_words = np.maximum(
            200.0 * ordered / (least(query.sorted_length[0], texts.sorted_length) + ordered), 200.0 * sets / (least(query.set_length[0], texts.set_length) + sets)
        )
    near, part_words, part = np.nan_to_num(near, nan=100.0), np.nan_to_num(part_words, nan=100.0), np.nan_to_num(part)
    own = query.words[0]
    for i in np.flatnonzero(np.fromiter((not own.isdisjoint(w) for w in texts.words), bool, len(texts.words))).tolist():
        both, part_words[i] = own & texts.words[i], 100.0
        if len(both) in (len(own), len(texts.words[i])):
            near[i] = 100.0
        else:  # the shared words alone against either side
            joined = sum(map(len, both)) + len(both) - 1
            near[i] = max(near[i], 200.0 * joined / (joined + min(query.set_length[0], texts.set_length[i])))
    apart = np.maximum(size, length) / np.maximum(np.minimum(size, length), 1)
    weight = np.where(apart <= FAR_LENGTHS, PARTIAL_WEIGHT, FAR_PARTIAL_WEIGHT)
    far = np.maximum(weight * part, TOKEN_WEIGHT * weight * part_words)
    best = np.maximum(plain, np.where(apart < NEAR_LENGTHS, TOKEN_WEIGHT * near, far))
    return np.where(length > 0, np.minimum(best, 100.0) + 1e-9, 0.0)


def name_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()

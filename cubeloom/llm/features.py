"""Hashed n-gram indicators of whole texts, and linear models with a hinge loss."""

from __future__ import annotations

import numpy as np

from . import words as W

#: Weights of a model; features are hashed into so many places.
BITS = 18
#: Beginnings of words, in bytes.
BEGINNINGS = (4, 6, 8)

_byte = np.arange(256)
_KINDS = (
    (_byte >= 97) & (_byte <= 122), (_byte >= 65) & (_byte <= 90), (_byte >= 48) & (_byte <= 57), _byte >= 128,
    (_byte < 128) & ~np.isin(_byte, [*range(48, 58), *range(65, 91), *range(97, 123)]) & ~W.SPACE,
)
#: Stands where the eighths of a text would, beyond the largest of them.
_WORDLESS = 9
_LETTER = _KINDS[0] | _KINDS[1] | _KINDS[3]


def indicators(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """``text, feature``: each feature that a text has, once.

    Features are lower-cased words without outer symbols, their beginnings,
    beginnings met more than once, shapes of words (kinds of characters, last character, short or long) alone
    and in twos and threes, and how much of the text is made of word trigrams it
    has more than once, in eighths. A text without words has one feature that
    says so. No text's features depend on the others.
    """
    w = W.split(texts)
    text = w.text
    data = np.frombuffer(w.data, np.uint8)
    kinds, start, end = np.zeros(len(text), np.uint64), w.start, w.end
    for k, kind in enumerate(_KINDS):
        total = np.concatenate(([0], np.cumsum(kind[data])))
        kinds |= ((total[end] - total[start]) > 0).astype(np.uint64) << np.uint64(k)
    last = data[end - 1]
    shape = kinds | (np.where(_LETTER[last], 0, last).astype(np.uint64) << np.uint64(8)) | ((end - start > 12).astype(np.uint64) << np.uint64(16))
    # the span from the first to the last letter of each word
    index = np.arange(len(data))
    next_letter = np.minimum.accumulate(np.where(_LETTER[data], index, len(data))[::-1])[::-1]
    last_letter = np.maximum.accumulate(np.where(_LETTER[data], index, -1))
    a, b = next_letter[start], last_letter[end - 1] + 1
    at = np.flatnonzero(b > a)
    bare = W.Words(w.data.translate(W.FOLD), a[at], b[at], w.first, w.at)
    parts = [(text[at], W.hashes(bare, seed=1))]
    for n in BEGINNINGS:
        long = np.flatnonzero(bare.end - bare.start > n)
        head = W.Words(bare.data, bare.start[long], bare.start[long] + n, w.first, w.at)
        hashed, of = W.hashes(head, seed=10 + n), text[at][long]
        parts.append((of, hashed))
        _, where, many = np.unique(W.combine(of.astype(np.uint64), hashed), return_index=True, return_counts=True)
        twice = where[many > 1]
        parts.append((of[twice], W.mix(hashed[twice])))
    for n in (1, 2, 3):
        ok = W.inside(w, n)
        parts.append((text[: len(ok)][ok], W.grams(W.mix(shape), n, seed=20 + n)[ok]))
    ok = W.inside(w, 3)
    owner = text[: len(ok)][ok].astype(np.uint64)
    _, back, many = np.unique(W.combine(owner, W.grams(W.hashes(w), 3)[ok]), return_inverse=True, return_counts=True)
    again = np.bincount(owner.astype(np.int64)[many[back] > 1], minlength=len(texts))
    eighth = np.where(w.counts > 0, np.ceil(8 * again / np.maximum(w.counts, 1)), _WORDLESS).astype(np.uint64)
    parts.append((np.arange(len(texts)), W.mix(eighth + np.uint64(1 << 40))))
    owner = np.concatenate([p[0] for p in parts])
    feature = (np.concatenate([p[1] for p in parts]) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique((owner << BITS) | feature)
    return both >> BITS, both & ((1 << BITS) - 1)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """For each feature, how much likelier it is in positive rows than in negative ones, as a logarithm."""
    counted = []
    for sign in (1, -1):
        held = [r for r, s in zip(rows, y, strict=True) if s == sign] or [np.zeros(0, np.int64)]
        n = np.bincount(np.concatenate(held), minlength=1 << BITS) + smoothing
        counted.append(n / n.sum())
    return np.log(counted[0] / counted[1])


def hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, extra: np.ndarray | None = None, cost: float = 0.5, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Squared-hinge linear model by dual coordinate descent.

    A row has the value ``scale[f]`` for each of its features and the numbers in
    ``extra`` behind them. Returns weights for plain indicators, with the scale
    multiplied in, and those of ``extra`` with the intercept last.
    """
    extra = np.zeros((len(rows), 0)) if extra is None else extra
    tail = np.concatenate((extra, np.ones((len(rows), 1))), axis=1)
    values = [scale[r] for r in rows]
    # long texts have more features: each row is brought to one length, like a cosine
    size = np.array([np.sqrt((v * v).sum()) or 1.0 for v in values])
    w, v = np.zeros(len(scale)), np.zeros(tail.shape[1])
    alpha, loose = np.zeros(len(rows)), 1 / (2 * cost)
    square = 1 + (tail * tail).sum(axis=1) + loose
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            x = values[i] / size[i]
            gradient = y[i] * (w[rows[i]] @ x + v @ tail[i]) - 1 + loose * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[rows[i]] += step * x
                v += step * tail[i]
    return w * scale, v


def margins(owner: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray, scale: np.ndarray, tail: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
    """Margins of ``n`` texts from their indicators, as ``hinge`` saw them."""
    top = np.bincount(owner, weights[feature], n)
    size = np.sqrt(np.bincount(owner, scale[feature] ** 2, n))
    out = top / np.where(size > 0, size, 1) + tail[-1]
    return out if extra is None else out + extra @ tail[:-1]


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities, by Newton steps on held-out margins."""
    positive, negative = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack((margin, np.ones(len(margin))), axis=1)
    at = np.array([1.0, np.log((positive + 1) / (negative + 1))])
    # a slope near one is preferred, which settles it where one class is rare or missing
    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(np.sum(np.logaddexp(0, z) - target * z)) + 0.5 * (at[0] - 1) ** 2 + 5e-4 * at[1] ** 2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (p - target) + np.array([at[0] - 1, 1e-3 * at[1]])
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1e-3])
        step = np.linalg.solve(bend, slope)
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-8:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def probability(margin: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))

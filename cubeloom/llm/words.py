"""Words and hashes of whole texts, many texts at a time, inside Arrow batches.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. All functions work on flat arrays over every word of
a batch, so nothing loops over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that one numpy step works on; temporary arrays are some tens of times that.
STEP_BYTES = 4 << 20

_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x9E3779B97F4A7C15))
_LANE = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_HALF, _LOW = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = (x ^ (x >> _HALF)) * _A
    x = (x ^ (x >> _LOW)) * _B
    return x ^ (x >> _HALF)


@dataclass
class Words:
    """``start`` and ``end`` are byte spans in ``data``; text t has words ``first[t]:first[t + 1]``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(texts: list[bytes | None], fold: bool = False) -> Words:
    """Words of every text; ``fold`` lower-cases A-Z. Null has none."""
    data = b"\n".join(t or b"" for t in texts) + b"\n"
    if fold:
        data = data.translate(FOLD)
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(sizes)))
    space = SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    return Words(data, start, end, np.searchsorted(start, at), at)


def hashes(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, from all its bytes, eight at a time."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    padded = words.data + bytes(8)
    lanes = np.ndarray((len(words.data) + 1,), "<u8", padded, strides=(1,))
    size = words.end - words.start
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * _C + np.uint64(seed))
        out = mix(out ^ (lanes[words.start] & _LANE[np.minimum(size, 8)]))
        left, done = np.flatnonzero(size > 8), 8
        while len(left):
            rest = np.minimum(size[left] - done, 8)
            out[left] = mix(out[left] ^ (lanes[words.start[left] + done] & _LANE[rest]))
            done += 8
            left = left[size[left] > done]
    return out


def grams(hashed: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` words, over all texts; see ``inside`` for those that count."""
    m = max(0, len(hashed) - n + 1)
    with np.errstate(over="ignore"):
        out = np.full(m, seed, np.uint64)
        for k in range(n):
            out = (out ^ hashed[k : k + m]) * _A
            out ^= out >> _HALF
        return mix(out)


def inside(words: Words, n: int) -> np.ndarray:
    """True for each run of ``n`` words that lies in one text."""
    text = words.text
    m = max(0, len(text) - n + 1)
    return text[:m] == text[n - 1 : n - 1 + m]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(a + _C) ^ b)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` for ``counts[i]`` numbers each, one after another."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (total - counts), counts) + np.arange(total[-1])


def binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def steps(texts: list[bytes | None], most: int = STEP_BYTES) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` bytes, whole texts only."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def by_step(
    make: Callable[[pa.RecordBatch, list[bytes | None]], pa.RecordBatch | None], column: str = "text"
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``make`` gets rows and their texts as bytes, a few MB at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(column))
            for part in steps(texts):
                made = make(batch.slice(part.start, part.stop - part.start), texts[part])
                if made is not None and made.num_rows:
                    yield made

    return run

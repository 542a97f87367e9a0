"""Find benchmark items in documents, also with edits.

A random walk over the words of a window (CGK embedding: write the current word,
then stay or go on as a random function of step and word decides) turns edits
into few differing places of strings of one length. Bit sampling then hashes a
few places of the embedding; windows that differ little share a hash in one of
the repetitions with the wanted recall. What meets is verified exactly: the edit
distance, in characters, between the item and the best stretch of the document
around the window must be at most ``rate`` of the item's length.

Windows begin at anchors, the lowest words of every few neighbours, so an item
and its copy begin windows at the same words. Their sizes are those of the
items, rounded down to a few classes; one walk serves all classes.

Walks meet by chance, and an item may be too short for a window. So short runs
of words are looked up as well, without anchors: ``e`` edited words leave one of
``e + 1`` equal parts of an item whole, so a copy with up to ``rate`` of the
words edited always shares a run of that length with its item.

Documents are read once for each block of items, and nothing of them is
shuffled. A block is bounded in bytes, so its index can be sent to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Window sizes in words.
SIZES = (8, 16, 24)
#: Neighbouring words of which one is an anchor.
NEIGHBOURS = 5
#: Different walks, and places of an embedding that one hash takes.
WALKS, PLACES = 4, 4
#: Words in the runs that are looked up, at most; fewer where so many edits can leave shorter parts only.
RUN = 3
#: A hash goes into the index if it took so many different words of at least so many bytes; others meet by chance.
TELLING, LONG = 2, 5
#: Text of the items in one index.
BLOCK_BYTES = 16 << 20
#: Size of the table that passes over most hashes no item has, as a power of two.
_FILTER = 24

_STEPS = {c: 3 * c // 2 for c in SIZES}


def repetitions(recall: float, edited: float = 0.1) -> int:
    """Hashes of a window needed for ``recall`` where this share of words is edited; an edit upsets some 2.5 places."""
    met = (1 - min(0.9, 2.5 * edited)) ** PLACES
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def anchors(words: W.Words, hashed: np.ndarray) -> np.ndarray:
    """Words that are the lowest of some ``NEIGHBOURS`` in a row; long words are lower than short ones."""
    short = (words.end - words.start < 6).astype(np.uint64)
    order = (hashed >> np.uint64(1)) | (short << np.uint64(63))
    m = max(0, len(hashed) - NEIGHBOURS + 1)
    low, at = order[:m].copy(), np.zeros(m, np.int64)
    for k in range(1, NEIGHBOURS):
        less = order[k : k + m] < low
        low[less] = order[k : k + m][less]
        at[less] = k
    return np.unique((at + np.arange(m))[W.inside(words, NEIGHBOURS)])


def embed(hashed: np.ndarray, start: np.ndarray, end: np.ndarray, walk: int) -> np.ndarray:
    """The walk's string for each window: a row for each step. Behind ``end`` it writes zeros."""
    rng = np.random.default_rng(1000 + walk)
    at, out = start.copy(), np.zeros((max(_STEPS.values()), len(start)), np.uint64)
    padded = np.append(hashed, np.uint64(0))
    for step in range(len(out)):
        word = np.where(at < end, padded[np.minimum(at, len(hashed))], np.uint64(0))
        out[step] = word
        odd = rng.integers(1, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        with np.errstate(over="ignore"):
            at += ((word * odd) >> np.uint64(63)).astype(np.int64)
    return out


def keys(hashed: np.ndarray, start: np.ndarray, end: np.ndarray, times: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Window size, one hash of each window and the words it took, for all sizes and repetitions."""
    for walk in range(WALKS):
        written = embed(hashed, start, end, walk)
        for size in SIZES:
            for turn in range(walk, times, WALKS):
                places = np.random.default_rng((size, turn)).choice(_STEPS[size], PLACES, replace=False)
                key = np.full(len(start), size * 1000 + turn, np.uint64)
                for place in places:
                    key = W.combine(key, written[place])
                yield size, key, written[places]


def edits(item: str, text: str) -> int:
    """Least edit distance between ``item`` and any stretch of ``text``, bit-parallel over the item."""
    m = len(item)
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, here = full, 0, m
    best = m
    for c in text:
        same = where.get(c, 0)
        level = ((((same & up) + up) ^ up) | same | down) & full
        rise = down | (~(level | up) & full)
        fall = level & up
        here += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (~(level | rise) & full), rise & level
        best = min(best, here)
    return best


@dataclass
class Index:
    """Hashes of all windows of a block of items, sorted, with the item and the window's word in it."""

    ids: list[int]
    texts: list[str]
    counts: np.ndarray
    key: np.ndarray
    item: np.ndarray
    word: np.ndarray
    seen: np.ndarray
    times: int
    rate: float
    run_key: np.ndarray
    run_item: np.ndarray
    run_word: np.ndarray
    run_seen: np.ndarray
    run_sizes: list[int]
    hashed: np.ndarray
    first: np.ndarray


def edited(n: np.ndarray, rate: float) -> np.ndarray:
    """Words that may be edited in items of ``n`` words."""
    return np.floor(rate * n + 1e-9).astype(np.int64)


def runs(w: W.Words, hashed: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Hash of each run of the length that an item's edits leave whole, sorted, with the item and the run's word in it; the lengths."""
    size = np.minimum(w.counts // (edited(w.counts, rate) + 1), RUN)
    sizes = np.unique(size[size > 0]).tolist()
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    text = w.text
    for n in sizes:
        begin = np.flatnonzero(W.inside(w, n) & (size[text[: max(0, len(text) - n + 1)]] == n))
        item = text[begin]
        found.append((W.grams(hashed, n, seed=n)[begin], item, begin - w.first[item]))
    key, item, word = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.argsort(key, kind="stable")
    return key[order], item[order], word[order], sizes


def _seen(key: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER, bool)
    out[(key >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
    return out


def index(items: list[tuple[int, str | None]], recall: float, rate: float) -> Index:
    data = [(t or "").encode() for _, t in items]
    w = W.split(data, fold=True)
    hashed, times = W.hashes(w), repetitions(recall)
    start = anchors(w, hashed)
    owner = w.text[start]
    end = w.first[owner + 1]
    found = []
    long = np.unique(hashed[w.end - w.start >= LONG])
    for size, key, took in keys(hashed, start, end, times):
        took = np.sort(took, axis=0)
        telling = (np.diff(took, axis=0, prepend=0) != 0) & np.isin(took, long)
        fits = (end - start >= size) & (took != 0).all(axis=0)
        found.append((key[fits], owner[fits], (start - w.first[owner])[fits], telling.sum(axis=0)[fits] >= TELLING))
    key, item, word, good = (np.concatenate([f[k] for f in found]) for k in range(4))
    # an item of few different words goes in with all its hashes
    good |= np.bincount(item, good, len(items))[item] < times
    key, item, word = key[good], item[good], word[good]
    order = np.argsort(key, kind="stable")
    run_key, run_item, run_word, run_sizes = runs(w, hashed, rate)
    texts = [_plain(w, w.first[i], w.first[i + 1]) for i in range(len(items))]
    return Index(
        [i for i, _ in items], texts, w.counts, key[order], item[order], word[order], _seen(key), times, rate,
        run_key, run_item, run_word, _seen(run_key), run_sizes, hashed, w.first,
    )


def _plain(w: W.Words, start: int, end: int) -> str:
    """Words joined by one space, A-Z lower-cased."""
    return b" ".join(w.data[a:b] for a, b in zip(w.start[start:end].tolist(), w.end[start:end].tolist(), strict=True)).decode()


def alike(w: W.Words, hashed: np.ndarray, ix: Index, met: np.ndarray) -> np.ndarray:
    """Those of ``met`` that have enough of the item's words near: each edited word costs one, and as many again are allowed."""
    out = [met[:0]]
    for part in np.array_split(met, len(met) // 20_000 + 1):
        text, item, begin = part.T
        n = ix.counts[item]
        e = edited(n, ix.rate)
        low, high = np.maximum(w.first[text], begin - 2 * e), np.minimum(w.first[text + 1], begin + n + 2 * e)
        case = np.arange(len(part), dtype=np.uint64)
        near = np.unique(W.combine(np.repeat(case, high - low), hashed[W.spread(low, high - low)]))
        of = np.repeat(np.arange(len(part)), n)
        there = np.isin(W.combine(case[of], ix.hashed[W.spread(ix.first[item], n)]), near)
        out.append(part[np.bincount(of[there], minlength=len(part)) >= n - 2 * e])
    return np.concatenate(out)


def search(texts: list[bytes | None], ix: Index) -> list[tuple[int, int, int]]:
    """``text, item, edits`` for each item found in each text, with the fewest edits found."""
    w = W.split(texts, fold=True)
    hashed = W.hashes(w)
    start = anchors(w, hashed)
    owner = w.text[start]
    end = w.first[owner + 1]
    met = []
    for _, key, _ in keys(hashed, start, end, ix.times):
        maybe = np.flatnonzero(ix.seen[(key >> np.uint64(64 - _FILTER)).astype(np.int64)])
        low, high = (np.searchsorted(ix.key, key[maybe], side=s) for s in ("left", "right"))
        window, at = np.repeat(maybe, high - low), W.spread(low, high - low)
        # where the item would begin in the text
        met.append(np.stack((owner[window], ix.item[at], start[window] - ix.word[at]), axis=1))
    text = w.text
    shared = [np.zeros((0, 3), np.int64)]
    for size in ix.run_sizes:
        key = W.grams(hashed, size, seed=size)
        maybe = np.flatnonzero(ix.run_seen[(key >> np.uint64(64 - _FILTER)).astype(np.int64)] & W.inside(w, size))
        low, high = (np.searchsorted(ix.run_key, key[maybe], side=s) for s in ("left", "right"))
        begin, at = np.repeat(maybe, high - low), W.spread(low, high - low)
        shared.append(np.unique(np.stack((text[begin], ix.run_item[at], begin - ix.run_word[at]), axis=1), axis=0))
    met.append(alike(w, hashed, ix, np.concatenate(shared)))
    best: dict[tuple[int, int], int] = {}
    done: dict[tuple[int, int], int] = {}
    for text, item, begin in np.unique(np.concatenate(met), axis=0).tolist():
        n = int(ix.counts[item])
        slack = int(ix.rate * n) + 2
        # a stretch covers the places near it as well
        if best.get((text, item)) == 0 or ((text, item) in done and begin - done[text, item] <= slack):
            continue
        done[text, item] = begin
        a, b = max(int(w.first[text]), begin - 2 * slack), min(int(w.first[text + 1]), begin + n + 3 * slack)
        found = edits(ix.texts[item], _plain(w, a, b))
        if found <= ix.rate * len(ix.texts[item]):
            best[text, item] = min(found, best.get((text, item), found))
    return [(t, i, e) for (t, i), e in best.items()]


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """All items, in blocks of about ``BLOCK_BYTES`` of text."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // BLOCK_BYTES)
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).distinct()
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, items: DataFrame, recall: float = 0.99, rate: float = 0.2) -> DataFrame:
    """``doc_id, item_id, edits`` for each document and each item it holds.

    A copy with up to ``rate`` of the item's words edited is always found if it is
    a match. Where more words are edited, each by few characters, ``recall`` only
    sets how many hashes are tried. Null texts hold nothing; items without words
    are found nowhere; rows that share an id count as one document; empty tables
    give no rows.
    """

    def use(docs: DataFrame, ix: Broadcast[Index]) -> DataFrame:
        def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch | None:
            found = search(texts, ix.value)
            if not found:
                return None
            ids = rows.column("doc_id").take(pa.array([t for t, _, _ in found]))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([ix.value.ids[i] for _, i, _ in found], pa.int64()), pa.array([e for _, _, e in found], pa.int32())],
                ["doc_id", "item_id", "edits"],
            )

        return docs.mapInArrow(W.by_step(make), "doc_id bigint, item_id bigint, edits int")

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, edits int")
    for block in blocks(items):
        out = out.unionByName(use(texts, docs.sparkSession.sparkContext.broadcast(index(block, recall, rate))))
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def clean(docs: DataFrame, items: DataFrame, recall: float = 0.99, rate: float = 0.2) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged and with all their columns."""

    def use(docs: DataFrame, ix: Broadcast[Index]) -> DataFrame:
        def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            keep = np.ones(len(texts), bool)
            keep[[t for t, _, _ in search(texts, ix.value)]] = False
            return rows.filter(pa.array(keep))

        return docs.mapInArrow(W.by_step(make), docs.schema)

    for block in blocks(items):
        docs = use(docs, docs.sparkSession.sparkContext.broadcast(index(block, recall, rate)))
    return docs

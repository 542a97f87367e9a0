"""Pack tokenised documents into sequences of bounded length.

Only lengths decide a packing, and there are at most ``capacity`` of them. So
Spark counts the pieces of each length, the driver packs these counts (its work
and memory are bounded by the capacity, never by rows), and each piece finds its
place from its length and its rank among pieces of that length.

Pieces above a third of the capacity pair at most twice per sequence, each
largest with the largest that still fits beside it. Smaller ones then go, large
to small, into the smallest gap that holds them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import words as W
from .tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
PLACES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def cut(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every document's ids with ``end_id`` behind them, cut into pieces of at most ``capacity``.

    A null or empty text is the end id alone. Repeated rows are pieces of their
    own. ``nth`` counts pieces of one length in one task (``part``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(vocabulary)
        seen = np.zeros(capacity + 1, np.int64)

        def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            ids, many = code.encode(texts)
            total = many + 1
            begin = np.cumsum(total) - total
            full = np.empty(total.sum(), "<u4")
            full[W.spread(begin, many)] = ids
            full[begin + many] = end_id
            count = -(-total // capacity)
            doc = np.repeat(np.arange(len(texts)), count)
            piece = W.spread(np.zeros(len(texts), np.int64), count)
            start = piece * capacity
            length = np.minimum(total[doc] - start, capacity)
            at = begin[doc] + start
            data = memoryview(full).cast("B")
            crc = [crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            new = np.diff(length[order], prepend=-1) != 0
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            nth += seen[length]
            np.add.at(seen, length, 1)
            return pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                    pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()),
                    pa.array(nth),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

        yield from W.by_step(make)(batches)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where pieces go, by length: rows ``length, rank, n, sequence, offset``.

    ``n`` pieces of a length, from ``rank`` on, go to as many sequences from
    ``sequence`` on, at ``offset`` each. Every sequence a group of equal gaps
    holds got the same lengths, so the rows number at most groups times pieces a
    sequence, whatever the counts are.
    """
    left = [counts.get(n, 0) for n in range(capacity + 1)]
    given = [0] * (capacity + 1)
    rows: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    after = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, given[length], n, sequence, offset))
        given[length] += n
        left[length] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if not groups.get(gap):
                insort(gaps, gap)
            groups.setdefault(gap, []).append((sequence, n))

    third = capacity // 3
    for a in range(capacity, third, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b > third and not left[b] or b == a and left[a] < 2:
                b -= 1
            if b <= third:
                n = left[a]
                put(a, n, after, 0)
                leave(capacity - a, after, n)
            else:
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, n, after, 0)
                put(b, n, after, a)
                leave(capacity - a - b, after, n)
            after += n
    for s in range(third, 0, -1):
        while left[s]:
            k = bisect_left(gaps, s)
            if k < len(gaps):
                gap = gaps[k]
                sequence, n = groups[gap].pop()
                if not groups[gap]:
                    gaps.pop(k)
                m = min(n, left[s])
                put(s, m, sequence, capacity - gap)
                leave(gap - s, sequence, m)
                leave(gap, sequence + m, n - m)
            else:
                each = min(capacity // s, left[s])
                n = left[s] // each
                for j in range(each):
                    put(s, n, after, j * s)
                leave(capacity - each * s, after, n)
                after += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece with its sequence and its offset there. An empty table gives none."""
    spark = docs.sparkSession
    pieces = stored(cut(docs, vocabulary, capacity, end_id), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = stored(by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(counts, capacity)
    # rank fits in the low 48 bits, so one sorted key finds the row that covers it
    keys = (rows[:, 0] << 48) | rows[:, 1]
    table = spark.sparkContext.broadcast((keys, rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = table.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = rows[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            own = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(by_part.select("length", "part", "base"), ["length", "part"])
    return ranked.withColumn("rank", F.col("base") + F.col("nth")).mapInArrow(place, PLACES)

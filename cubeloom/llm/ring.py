"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every key has a place on the ring and belongs to the first virtual node
clockwise. A shard takes keys until it is full; the others go on clockwise to
the next shard with room. With no slack the capacities add up to the rows, so
counts are at most one apart. When a shard is added, keys move only where its
nodes or the smaller capacities push them.

The walk runs on counts of keys between virtual nodes, of which there are as
many as virtual nodes, so the driver's work doesn't grow with the rows. Rows are
dealt by ring position and row, so a key that holds a third of the rows is
spread over tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SHARDED = "doc_id bigint, size bigint, text_crc32 bigint, shard int, slot bigint"
ORDERED = "doc_id bigint, size bigint, text_crc32 bigint, arc int, part int, nth bigint"


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all virtual nodes in ring order, and the shard of each."""
    made = sorted(
        (int.from_bytes(blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "little", signed=True), s)
        for s in range(shards)
        for v in range(nodes)
    )
    return np.array([p for p, _ in made], np.int64), np.array([s for _, s in made])


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def settle(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Walk the ring: rows ``rank, n, shard, slot`` for runs of keys in ring order.

    ``counts[i]`` keys belong to virtual node i; a last entry beyond the nodes
    holds the keys behind the last node, which belong to the first. At a node its
    own keys come before those that wait, which keep their order.
    """
    waiting: deque[tuple[int, int]] = deque()
    used = [0] * len(room)
    out: list[tuple[int, int, int, int]] = []
    rank = 0
    for turn in range(2):
        for i in range(len(owners) + 1):
            shard = owners[i % len(owners)]
            if not turn:
                if counts[i]:
                    waiting.appendleft((rank, counts[i]))
                rank += counts[i]
            own = not turn and bool(counts[i])
            while waiting and used[shard] < room[shard]:
                first, n = waiting.popleft()
                m = min(n, room[shard] - used[shard])
                out.append((first, m, shard, used[shard]))
                used[shard] += m
                if m < n:
                    waiting.appendleft((first + m, n - m))
                else:
                    own = False
            if own:
                waiting.append(waiting.popleft())  # behind those that have waited longer
    return sorted(out)


def shard(docs: DataFrame, shards: int = 8, nodes: int = 512, slack: float = 0.0) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    Size is the UTF-8 bytes of the text plus one; a null text counts as empty. A
    null ``doc_id`` has a place on the ring like any other value; repeated rows
    are placed one by one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.col("doc_id").cast("bigint")).alias("place"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = stored(keys, "ring-keys")
    places, owners = ring(shards, nodes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            arc = np.searchsorted(places, b.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [
                    *[b.column(c) for c in ("doc_id", "size", "text_crc32")], pa.array(arc, pa.int32()),
                    pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(nth, nth + n)),
                ],
                ["doc_id", "size", "text_crc32", "arc", "part", "nth"],
            )
            nth += n

    in_order = keys.repartitionByRange("place", "row").sortWithinPartitions("place", "row")
    ordered = stored(in_order.mapInArrow(number, ORDERED), "ring-order")
    arcs = {r["arc"]: r["n"] for r in ordered.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [arcs.get(i, 0) for i in range(len(places) + 1)]
    runs = settle(counts, owners.tolist(), capacities(sum(counts), shards, slack))
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 4))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        for b in batches:
            rank = b.column("rank").to_numpy()
            run = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *[b.column(c) for c in ("doc_id", "size", "text_crc32")], pa.array(run[:, 2], pa.int32()),
                    pa.array(run[:, 3] + rank - run[:, 0]),
                ],
                ["doc_id", "size", "text_crc32", "shard", "slot"],
            )

    # one row for each task of the ordering
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    bases = bases.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = ordered.join(bases, "part").withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(place, SHARDED)

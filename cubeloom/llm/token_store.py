"""Token-id files compressed by Re-Pair, with random access.

A store is a Parquet table with one row for each shard, written by Spark's own
writer, so a lost task leaves nothing half done. A shard holds whole documents,
in ascending ``doc_id`` over the store:

==========  ==============================================================
part, nth   place of the shard in the store
begin       ids before it in its part
n_ids       its ids
doc_ids     its documents
sizes       ids of each document, little-endian u4
rules       two symbols for each rule, little-endian u4
lengths     ids that each rule stands for, little-endian u4
symbols     the compressed sequence, little-endian u4
==========  ==============================================================

Symbols below ``terminals`` are ids; symbol ``terminals + r`` is rule r. No rule
runs over the end of a document, so any document, or any range of ids, is read
by expanding only the symbols that cover it.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .tokens import encoder

SHARD = (
    "part int, nth int, begin bigint, n_ids bigint, doc_ids array<bigint>, sizes binary, rules binary, "
    "lengths binary, symbols binary"
)
#: Ids gathered before a shard is closed.
SHARD_IDS = 1 << 20
#: A rule takes 12 bytes and each use saves 4.
LEAST_USES = 4
#: Share of the symbols that a round must replace for another one to follow.
LEAST_SHARE = 0.005
_BUCKETS = 20
#: A rank has 31 bits: the number of uses and some of the hash.
_TIES = 11
_MOST = (1 << 20) - 1


def compress(ids: np.ndarray, end_id: int, terminals: int, least_share: float = LEAST_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: ``symbols``, ``rules`` (pairs), ``lengths``.

    Each round estimates how often every neighbouring pair occurs, lets a pair
    win where it beats the pairs that overlap it, counts the winners exactly and
    replaces those that pay by new symbols. It ends when a round replaces no
    more than ``least_share`` of the symbols; 0 goes on while any pair pays.
    """
    symbols = ids.astype(np.uint32)
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    closed = np.zeros(terminals, bool)
    closed[end_id] = True
    slots = np.arange(1 << _BUCKETS, dtype=np.int32) & ((1 << _TIES) - 1)
    while len(symbols) > 1:
        pairs = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        with np.errstate(over="ignore"):
            bucket = ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BUCKETS)).astype(np.int32)
        # pairs used equally often are ranked by hash, so that a passage repeated as a whole shrinks everywhere at once
        often = np.minimum(np.bincount(bucket, minlength=1 << _BUCKETS), _MOST).astype(np.int32)
        rank = ((often << _TIES) | slots)[bucket]
        rank[closed[symbols[:-1]]] = 0
        best = rank >= LEAST_USES << _TIES
        rises, falls = rank[1:] > rank[:-1], rank[1:] < rank[:-1]
        best[1:] &= ~falls
        best[:-1] &= ~rises
        at = np.flatnonzero(best)
        # of equal neighbours every other one wins
        nth = np.arange(len(at))
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) > 1
        at = at[(nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0]
        # pairs whose bucket has too few winners can't pay; the rest is counted exactly
        at = at[np.bincount(bucket[at], minlength=1 << _BUCKETS)[bucket[at]] >= LEAST_USES]
        found, back, uses = np.unique(pairs[at], return_inverse=True, return_counts=True)
        pays = uses >= LEAST_USES
        at, back = at[pays[back]], back[pays[back]]
        if len(at) <= least_share * len(symbols):
            break
        number = np.cumsum(pays) - 1 + terminals + len(rules)
        chosen = np.stack((found[pays] >> np.uint64(32), found[pays] & np.uint64(0xFFFFFFFF)), axis=1).astype(np.uint32)
        size = np.concatenate((np.ones(terminals, np.uint32), lengths))
        lengths = np.concatenate((lengths, size[chosen[:, 0]] + size[chosen[:, 1]]))
        closed = np.concatenate((closed, closed[chosen[:, 1]]))
        rules = np.concatenate((rules, chosen))
        symbols[at] = number[back]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
    return symbols, rules, lengths


def unroll(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of a few symbols, level by level."""
    while True:
        rule = symbols >= terminals
        if not rule.any():
            return symbols
        at = np.arange(len(symbols)) + np.cumsum(rule) - rule
        out = np.empty(len(symbols) + rule.sum(), np.uint32)
        pair = rules[symbols[rule] - terminals]
        out[at[~rule]] = symbols[~rule]
        out[at[rule]], out[at[rule] + 1] = pair[:, 0], pair[:, 1]
        symbols = out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of a whole shard: each rule is unrolled once and put in where it stands."""
    size = np.concatenate((np.ones(terminals, np.int64), lengths.astype(np.int64)))
    whole = np.concatenate((np.arange(terminals, dtype=np.uint32), unroll(rules.ravel(), rules, terminals)))
    return whole[W.spread((np.cumsum(size) - size)[symbols], size[symbols])]


def read_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, count: int, terminals: int) -> np.ndarray:
    """``count`` ids of a shard from ``start`` on, expanding only the symbols over them."""
    size = np.ones(len(symbols), np.int64)
    rule = symbols >= terminals
    size[rule] = lengths[symbols[rule] - terminals]
    ends = np.cumsum(size)
    a = int(np.searchsorted(ends, start, side="right"))
    b = int(np.searchsorted(ends, start + count, side="left")) + 1
    skip = start - int(ends[a - 1]) if a else start
    return unroll(symbols[a:b], rules, terminals)[skip : skip + count]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text, put ``end_id`` behind each, and write the store to ``path``.

    A null text counts as empty, so it is its end id alone. Rows without a
    ``doc_id`` come first; repeated ids keep the order of the input. A long
    document stays in one shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(vocabulary)
        terminals = len(code.ends)
        nth = begin = 0
        held: list[np.ndarray] = []
        docs_held: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal nth, begin
            ids, size = np.concatenate(held), np.concatenate(sizes)
            symbols, rules, lengths = compress(ids, end_id, terminals)
            listed = pa.concat_arrays(docs_held)
            whole = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
            data = [x.astype("<u4").tobytes() for x in (size, rules, lengths, symbols)]
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([begin]),
                    pa.array([len(ids)]), whole, *[pa.array([x], pa.binary()) for x in data],
                ],
                ["part", "nth", "begin", "n_ids", "doc_ids", "sizes", "rules", "lengths", "symbols"],
            )
            nth, begin = nth + 1, begin + len(ids)
            held.clear(), docs_held.clear(), sizes.clear()
            return made

        def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch | None:
            ids, many = code.encode(texts)
            total = many + 1
            first = np.cumsum(total) - total
            full = np.full(total.sum(), end_id, np.uint32)
            full[W.spread(first, many)] = ids
            held.append(full)
            docs_held.append(rows.column("doc_id"))
            sizes.append(total)
            return close() if sum(map(len, held)) >= shard_ids else None

        yield from W.by_step(make)(batches)
        if held:
            yield close()

    numbered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_row", F.monotonically_increasing_id())
    in_order = numbered.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row")
    in_order.select("doc_id", "text").mapInArrow(run, SHARD).write.parquet(path)


def documents(spark: SparkSession, path: str, vocabulary: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminals = len(encoder(vocabulary).ends)
        for b in batches:
            for row in range(b.num_rows):
                one = {c: b.column(c)[row] for c in b.schema.names}
                size, rules, lengths, symbols = (np.frombuffer(one[c].as_py(), "<u4") for c in ("sizes", "rules", "lengths", "symbols"))
                ids = memoryview(np.ascontiguousarray(expand(symbols, rules.reshape(-1, 2), lengths, terminals), "<u4")).cast("B")
                end = np.cumsum(size, dtype=np.int64)
                crc = [crc32(ids[4 * x : 4 * y]) for x, y in zip((end - size).tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        one["doc_ids"].values, pa.array(end - size + one["begin"].as_py()), pa.array(size.astype(np.int64)),
                        pa.array(crc, pa.int64()), pa.array(np.full(len(size), one["part"].as_py()), pa.int32()),
                    ],
                    ["doc_id", "inner", "n_tokens", "ids_crc32", "part"],
                )

    store = spark.read.schema(SHARD).parquet(path)
    read = store.mapInArrow(run, "doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint, part int")
    # one row for each task that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = bases.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return read.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )

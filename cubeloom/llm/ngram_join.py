"""Link documents whose sets of word n-grams have a Jaccard similarity of ``percent`` or more.

Prefix filtering: order all n-grams in one way, rare ones first. Two similar
sets then share an n-gram among the first few of each (their prefixes), so a
join on prefix n-grams finds every similar pair. Pairs of that join must still
fit in length and in what the positions of the shared n-gram leave over; the
rest meets its partner's text once, where a suffix filter compares how both sets
spread over the range of hashes before their overlap is counted.

A group of thousands of near copies has millions of pairs, but its links are
needed only until the group hangs together. Equal sets are one node from the
start. In the first round each prefix n-gram ties its nodes to one leader. Later
rounds look only at pairs of nodes that no link has joined yet; the last one
takes all of these, so no link between different components is missed and
components are exact.

Rarity is counted over all documents in hashed buckets, so the order needs a
table of fixed size only. Any order gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, stored
from . import words as W
from .graph import components

#: Buckets of the frequency table, as a power of two.
BUCKETS = 18
#: Untested pairs for each posting up to which the last round may begin; above it, leaders are tried again.
PAIRS_A_POSTING = 100
_PARTS = 4


def shingles(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """``text, hash`` of each n-gram of each text, repeats included; A-Z are lower-cased.

    A text with fewer than ``n`` words has its whole sequence as its one n-gram.
    """
    w = W.split(texts, fold=True)
    hashed, text = W.hashes(w), w.text
    ok = W.inside(w, n)
    owners, found = [text[: len(ok)][ok]], [W.grams(hashed, n)[ok]]
    for k in range(1, n):
        short = np.flatnonzero(w.counts == k)
        owners.append(short)
        found.append(W.grams(hashed, k, seed=k)[w.first[short]] if len(short) else np.zeros(0, np.uint64))
    return np.concatenate(owners), np.concatenate(found)


def _distinct(owner: np.ndarray, hashed: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram of a text once, in the order of ``weight`` and hash."""
    order = np.lexsort((hashed, owner) if weight is None else (hashed, weight[_bucket(hashed)], owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(owner), bool)
    new[1:] = (np.diff(owner) != 0) | (hashed[1:] != hashed[:-1])
    return owner[new], hashed[new]


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - BUCKETS)).astype(np.int64)


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents have an n-gram of each bucket, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)

        def make(_: pa.RecordBatch, texts: list[bytes | None]) -> None:
            total[:] += np.bincount(_bucket(_distinct(*shingles(texts, n))[1]), minlength=1 << BUCKETS)

        for _ in W.by_step(make)(batches):
            pass
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most one row a bucket
    out = np.zeros(1 << BUCKETS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def sets(docs: DataFrame, n: int, percent: int, weight: np.ndarray) -> DataFrame:
    """``doc_id``, size and signature of each set, and its prefix: rare n-grams first."""
    table = docs.sparkSession.sparkContext.broadcast(weight)

    def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        owner, hashed = _distinct(*shingles(texts, n), table.value)
        size = np.bincount(owner, minlength=len(texts))
        begin = np.cumsum(size) - size
        length = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
        prefix = hashed[W.spread(begin, length)].view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(prefix))
        # sums don't depend on order
        ends = np.concatenate((begin, [len(owner)]))
        with np.errstate(over="ignore"):
            signs = [
                np.diff(np.concatenate(([np.uint64(0)], np.cumsum(W.combine(np.full(len(hashed), k, np.uint64), hashed), dtype=np.uint64)))[ends])
                for k in (1, 2)
            ]
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(size), *[pa.array(s.view(np.int64)) for s in signs], lists],
            ["doc_id", "n_shingles", "sign", "sign2", "prefix"],
        )

    return docs.mapInArrow(W.by_step(make), "doc_id bigint, n_shingles bigint, sign bigint, sign2 bigint, prefix array<bigint>")


def _fits(percent: int, x: str, y: str) -> Column:
    """What two sets still can share, from the positions of a shared n-gram, is enough. Implies the length filter."""
    rest = F.least(F.col(f"{x}.size") - F.col(f"{x}.pos"), F.col(f"{y}.size") - F.col(f"{y}.pos"))
    return (100 + percent) * rest >= percent * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def _pairs(met: DataFrame) -> DataFrame:
    a, b = F.col("x.node"), F.col("y.node")
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _led(postings: DataFrame, percent: int, turn: int) -> DataFrame:
    """Every node with the leader of each of its prefix n-grams, among sets of about its size."""
    # the first leader is the node with fewest rarer n-grams: where copies were edited, the one edited least
    first = [F.col("pos")] if turn == 0 else [F.xxhash64("node", F.lit(turn))]
    banded = postings.withColumn("band", F.floor(F.log("size") / F.log(F.lit(200 / (100 + percent)))))
    row = F.struct("node", "size", "pos", "root")
    lead = banded.groupBy("token", "band").agg(F.min(F.struct(*first, row.alias("row")))["row"].alias("y"), F.count(F.lit(1)).alias("n"))
    met = banded.select("token", "band", row.alias("x")).join(lead.where("n > 1"), ["token", "band"])
    return _pairs(met.where(F.col("x.root") != F.col("y.root")).where(_fits(percent, "x", "y")))


def _apart(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of different components that share a prefix n-gram."""
    row = F.struct("node", "size", "pos", "root")
    x, y = postings.select("token", row.alias("x")), postings.select("token", row.alias("y"))
    return _pairs(x.join(y, "token").where(F.col("x.root") < F.col("y.root")).where(_fits(percent, "x", "y")))


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough. ``texts`` has ``node, text``."""

    def make(rows: pa.RecordBatch, left: list[bytes | None]) -> pa.RecordBatch:
        right = W.binary(rows.column("right"))
        m = len(left)
        (own_a, a), (own_b, b) = (_distinct(*shingles(t, n)) for t in (left, right))
        size = np.bincount(own_a, minlength=m), np.bincount(own_b, minlength=m)
        both = size[0] + size[1]
        # suffix filter: sets that share enough differ little in any part of the hash range
        part = [np.bincount(o * (1 << _PARTS) + (h >> np.uint64(64 - _PARTS)).astype(np.int64), minlength=m << _PARTS).reshape(m, -1) for o, h in ((own_a, a), (own_b, b))]
        least = -(-percent * both // (100 + percent))
        near = np.abs(part[0] - part[1]).sum(axis=1) <= both - 2 * least
        keep_a, keep_b = near[own_a], near[own_b]
        own, hashed = np.concatenate((own_a[keep_a], own_b[keep_b])), np.concatenate((a[keep_a], b[keep_b]))
        order = np.lexsort((hashed, own))
        own, hashed = own[order], hashed[order]
        shared = np.bincount(own[1:][(own[1:] == own[:-1]) & (hashed[1:] == hashed[:-1])], minlength=m)
        alike = near & (both > 0) & (100 * shared >= percent * (both - shared))
        return rows.filter(pa.array(alike)).select(["a", "b"])

    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("left")), texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return met.mapInArrow(W.by_step(make, "left"), "a bigint, b bigint").distinct()


def _open(postings: DataFrame) -> tuple[int, int]:
    """Postings, and pairs of them that share an n-gram and aren't in one component."""
    each = postings.groupBy("token", "root").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    row = total.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
    return int(row[0] or 0), int(row[1] or 0)


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links. A null or
    wordless text has an empty set and is alone. A row without an id takes no
    part and has no component. Rows that share an id are one document with
    several sets. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every = stored(sets(docs, n, percent, frequencies(docs, n)), "sets")
    key = ["sign", "sign2", "n_shingles"]
    usable = every.where("doc_id is not null and n_shingles > 0")
    nodes = usable.groupBy(*key).agg(F.min(F.struct("doc_id", "prefix")).alias("one"))
    nodes = stored(nodes.select(*key, F.col("one.doc_id").alias("node"), "one.prefix"), "nodes")
    postings = nodes.select("node", F.col("n_shingles").alias("size"), F.posexplode("prefix").alias("pos", "token"))
    common = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    postings = stored(postings.join(common, "token", "left_semi"), "postings")
    path = scratch_path(spark, "candidates")
    members = postings.select(F.col("node").alias("doc_id")).distinct()
    met = docs.join(members, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
    met.write.option("compression", "zstd").parquet(path)
    texts = spark.read.schema("node bigint, text string").parquet(path)

    # sets of one id are linked
    of_set = every.select("doc_id", *key).join(nodes.select(*key, "node"), key, "left")
    several = of_set.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    same_id = stored(of_set.join(several, "doc_id").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "same-id")
    links, tested = [] if same_id.isEmpty() else [same_id], None
    roots = same_id.select(F.col("a").alias("node"), F.col("b").alias("root"))
    turn, new = 0, 1
    while True:
        if links:
            roots = stored(components(reduce(DataFrame.unionByName, links)), "components")
        rooted = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        rooted = stored(rooted.join(mixed, "token", "left_semi"), "open")
        rows, pairs_left = _open(rooted)
        last = turn > 0 and (new == 0 or pairs_left <= PAIRS_A_POSTING * rows)
        pairs = _apart(rooted, percent) if last else _led(rooted, percent, turn)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = stored(verify(pairs, texts, n, percent), "links")
        new = found.count()
        links = [*links, found] if new else links
        turn += 1
        if last:
            break
    if new:
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = stored(components(edges.unionByName(found)), "components")
    told = of_set.join(roots, "node", "left")
    return told.select("doc_id", "n_shingles", F.coalesce("root", "node", "doc_id").alias("component_id"))

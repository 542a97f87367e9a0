"""Prefix trie of conversations from padded matrices of turn ids.

A conversation is its sequence of turns; a turn is its role and text, known by
128 bits of hash. Conversations are dealt to shards by the order of their
sequences, so a node of the trie (a distinct beginning) is a run of neighbours.
A shard pads its sequences to a matrix, sorts it with ``lexsort``, and ORs the
change masks of its columns from left to right: a node starts wherever the mask
of its depth is set, and ``reduceat`` sums up every depth. A node on the path of
a shard's first or last row may go on in the next shard. Such nodes are few
(twice the depth per shard); their parts are summed by key, and what hangs below
them is summed up the trie by pointer doubling.

Nothing depends on the size of a group: equal sequences are spread by
``conv_id``, which ends the order, and a long conversation is cut into slabs of
``WIDTH`` turns, each sorted below the hash of all turns before it. The node at
the end of one slab and the root of the next have the same key, so slabs are put
together like shards.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import BUCKET_ROWS, running
from ..session import stored

#: Turns in a slab, so columns in a matrix at most.
WIDTH = 64
#: Cells of a shard's matrix.
SHARD_CELLS = 1 << 20
#: Members of a node in one piece of the list that is hashed.
PIECE = 1 << 15

WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_PARTS = pa.schema(
    [
        ("shard", pa.int32()), ("kind", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
        ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("piece", pa.int32()),
    ]
)
_PARTS_DDL = (
    "shard int, kind string, key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "words bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, piece int"
)


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, t1, t2, words``: every turn with its place in its conversation, from 1, and its id.

    Turns are ordered by ``turn``, null first; turns of one number by their id,
    so equal rows count as turns of their own. Null role and text are empty. Rows
    without ``conv_id`` belong to no conversation and are left out.

    Rows are dealt by range and numbered in place; only a conversation that lies
    in several ranges needs the counts of those before.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "t1", "t2", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "conv_id bigint, shard int, nth bigint, t1 bigint, t2 bigint, words bigint"
    numbered = stored(dealt.select("conv_id", "t1", "t2", "words").mapInArrow(_number, schema), "turns")
    spans = numbered.groupBy("conv_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(spans.select("conv_id", "shard", F.sum("n").over(before).alias("before")).where("before > 0"), "carried")
    placed = numbered.join(carried, ["conv_id", "shard"], "left")
    return placed.select("conv_id", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "words")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation inside one sorted partition."""
    shard, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv, n = batch.column("conv_id").to_numpy(), batch.num_rows
        if not n:
            continue
        place = np.arange(n)
        starts = np.concatenate(([True], conv[1:] != conv[:-1]))
        nth = place - np.maximum.accumulate(np.where(starts, place, 0)) + 1
        if conv[0] == last:
            nth[conv == last] += count
        last, count = conv[-1], nth[-1]
        yield pa.record_batch(
            [batch.column("conv_id"), pa.array(np.full(n, shard, np.int32)), pa.array(nth), *(batch.column(c) for c in ("t1", "t2", "words"))],
            ["conv_id", "shard", "nth", "t1", "t2", "words"],
        )


def with_shared_heads(placed: DataFrame, family: int, heads: Column) -> DataFrame:
    """Turns (as from ``turns``) after each conversation's head is replaced by that of its family's first.

    The first ``heads`` turns (an expression over ``conv_id``, 3 at most) of conversation
    ``conv_id - conv_id % family`` come first, all if it has fewer, none if it is
    absent; the conversation's own turns after its first ``heads`` follow. A conversation without turns has one row with ``pos`` 0.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    lengths = stored(placed.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", heads.alias("h"), base.alias("base")), "lengths")
    first = lengths.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = lengths.join(first, "base", "left").select("conv_id", "base", "n", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m"))
    lost = stored(convs.where("m < h").select("conv_id", (F.col("h") - F.col("m")).alias("lost")), "lost")
    own = placed.where(F.col("pos") > heads).join(lost, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.coalesce("lost", F.lit(0))).alias("pos"), "t1", "t2", "words")
    donors = placed.where((F.col("pos") <= 3) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    given = donors.join(lengths.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "t1", "t2", "words")
    bare = lengths.select("conv_id", F.lit(0).cast("bigint").alias("pos"), *[F.lit(None).cast("bigint").alias(c) for c in ("t1", "t2", "words")])
    return own.unionByName(given).unionByName(bare)


def trie(placed: DataFrame, width: int = WIDTH, cells: int = SHARD_CELLS, piece: int = PIECE) -> DataFrame:
    """A row for each node of the trie of the conversations in ``placed`` (as from ``turns``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs`` (conversations that begin so), ``n_children``, ``n_leaves`` (childless
    nodes in its subtree, itself included), ``saved_tokens`` (over its subtree: each
    node's ``n_convs - 1`` times the words of its last text), ``ends_sha256`` (hash
    of the comma-joined ids, ascending, of the conversations that end here).

    Rows with ``pos`` 0 stand for conversations that may have no turn. An empty
    table gives no rows, not even a root. The list of one node's ends is hashed in one task, as
    the hash is sequential; it reads ready pieces of ``piece`` ids and holds one at
    a time. ``width`` is the turns in a slab, ``cells`` the size of a shard's matrix.
    """
    slabs = stored(_slabs(placed, width), "slabs")
    size = slabs.agg(F.count(F.lit(1)), F.max(F.size("ids"))).first()
    shards = max(1, math.ceil(size[0] * max(1, size[1] or 0) / cells))
    shards = max(shards, min(size[0] // 4096 + 1, int(slabs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = slabs.repartitionByRange(shards, "slab", "p1", "p2", "ids", "conv_id")
    parts = stored(dealt.mapInArrow(partial(_shard_nodes, width=width, piece=piece), _PARTS_DDL), "trie-parts")

    ends = _hashed_ends(parts.where("kind = 'ends'"))
    known = _recombined(parts.where("kind = 'open'"))
    open_nodes = known.join(ends, "key", "left")
    parents = known.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    whole = parts.where("kind = 'whole'")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    told = whole.where("parent_key is null").withColumnRenamed("ends", "ends_sha256").select(columns)
    below = whole.where("parent_key is not null").join(parents, "parent_key", "left")
    below = below.withColumn("parent_conv_id", F.col("above")).withColumnRenamed("ends", "ends_sha256").select(columns)
    cut = open_nodes.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("above"))
    cut = cut.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))).select(columns)
    return told.unionByName(below).unionByName(cut)


def _slabs(placed: DataFrame, width: int) -> DataFrame:
    """``conv_id, slab, p1, p2, e1, e2, goes_on, ids, words``: the turns of each slab in order.

    ``p1, p2`` are a hash of all turns before the slab, ``e1, e2`` of all to its end.
    """
    slab = F.floor((F.greatest("pos", F.lit(1)) - 1) / F.lit(width)).cast("bigint")
    turn = F.when(F.col("pos") > 0, F.struct("pos", "t1", "t2", "words"))
    lane = [F.sum(F.when(F.col("pos") > 0, F.xxhash64(F.lit(k), "pos", "t1", "t2").cast("decimal(20,0)"))) for k in (3, 4)]
    zero = F.lit(0).cast("decimal(30,0)")
    grouped = placed.withColumn("slab", slab).groupBy("conv_id", "slab").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), *[F.coalesce(s, zero).alias(f"s{k}") for k, s in enumerate(lane, 1)]
    )
    grouped = stored(grouped, "slab-turns")
    longer = stored(grouped.where("slab > 0").groupBy("conv_id").agg(F.max("slab").alias("last_slab")), "long")
    sums = grouped.select("conv_id", "slab", "s1", "s2").join(longer.select("conv_id"), "conv_id", "left_semi")
    bucket = F.floor(F.col("slab") / F.lit(BUCKET_ROWS))
    carried = running(sums, ["conv_id"], ["slab"], bucket, sums={"b1": F.col("s1"), "b2": F.col("s2")}, inclusive=False)
    carried = stored(carried.where("slab > 0").select("conv_id", "slab", "b1", "b2"), "before")
    whole = grouped.join(carried, ["conv_id", "slab"], "left").join(longer, "conv_id", "left")
    wide = "decimal(38,0)"
    begun = [F.coalesce(f"b{k}", zero).cast(wide) for k in (1, 2)]
    return whole.select(
        "conv_id", "slab",
        *[F.xxhash64(F.lit(k), b).alias(f"p{k}") for k, b in enumerate(begun, 1)],
        *[F.xxhash64(F.lit(k), (b + F.col(f"s{k}")).cast(wide)).alias(f"e{k}") for k, b in enumerate(begun, 1)],
        F.coalesce(F.col("slab") < F.col("last_slab"), F.lit(False)).alias("goes_on"),
        F.transform("turns", lambda t: F.struct(t["t1"].alias("t1"), t["t2"].alias("t2"))).alias("ids"),
        F.col("turns.words").alias("words"),
    )


def _padded(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of different length as one matrix, filled up with zeros."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _shard_nodes(batches: Iterator[pa.RecordBatch], width: int, piece: int) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard: whole ones, parts of those that may go on elsewhere, and lists of ends of the latter."""
    shard = TaskContext.get().partitionId()
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    table = table.combine_chunks()
    slab, p1, p2, e1, e2, conv = (table.column(c).to_numpy() for c in ("slab", "p1", "p2", "e1", "e2", "conv_id"))
    goes_on = table.column("goes_on").to_numpy(zero_copy_only=False).astype(bool)
    ids, counted = (table.column(c).combine_chunks() for c in ("ids", "words"))
    ids, counted = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, counted))
    sizes = ids.value_lengths().to_numpy().astype(np.int64)
    t1, t2 = (ids.flatten().field(k).to_numpy() for k in (0, 1))

    # turn ids numbered inside the shard, in their own order; 0 fills up
    by_id = np.lexsort((t2, t1))
    new = np.concatenate(([True], (np.diff(t1[by_id]) != 0) | (np.diff(t2[by_id]) != 0)))[: len(by_id)]
    rank = np.empty(len(by_id), np.int64)
    rank[by_id] = np.cumsum(new)
    matrix, words = _padded(rank, sizes), _padded(counted.flatten().to_numpy().astype(np.int64), sizes)
    first = np.cumsum(sizes) - sizes
    n, deepest = matrix.shape
    order = np.lexsort((conv, *matrix.T[::-1], p2, p1, slab))
    matrix, words = matrix[order], words[order]
    slab, p1, p2, e1, e2, conv, goes_on, sizes, first = (x[order] for x in (slab, p1, p2, e1, e2, conv, goes_on, sizes, first))

    # from left to right: where the nodes of each depth start
    differs = lambda x: np.concatenate(([True], x[1:] != x[:-1]))
    change = differs(slab) | differs(p1) | differs(p2)
    starts: list[np.ndarray] = [np.flatnonzero(change)]
    for j in range(deepest):
        change = change | differs(matrix[:, j])
        starts.append(np.flatnonzero(change))

    out: dict[str, list] = {name: [] for name in _PARTS.names}

    def emit(**columns: list) -> None:
        n_rows = len(columns["depth"])
        for name in _PARTS.names:
            out[name] += columns.get(name, [None] * n_rows)

    def keys(rows: np.ndarray, j: int) -> list[bytes]:
        """Key of the node that row r passes at column j (-1: where its slab begins)."""
        made = []
        for r in rows.tolist():
            if j == width - 1:
                head, tail = struct.pack("<qqq", slab[r] + 1, e1[r], e2[r]), b""
            else:
                span = slice(first[r], first[r] + j + 1)
                head, tail = struct.pack("<qqq", slab[r], p1[r], p2[r]), t1[span].tobytes() + t2[span].tobytes()
            made.append(hashlib.blake2b(head + tail, digest_size=16).digest())
        return made

    def ended(a: int, size: int, j: int) -> np.ndarray:
        """Ids of the conversations that end at column j, of the ``size`` rows from a."""
        run = slice(a, a + size)
        return conv[run][(sizes[run] == j + 1) & ~goes_on[run]]

    # from the deepest column back: sums of whole subtrees stand in the row where the subtree starts
    leaves, saved, kids = (np.zeros(n, np.int64) for _ in range(3))
    went_on = np.concatenate(([0], np.cumsum(goes_on)))
    for j in range(deepest - 1, -2, -1):
        at = starts[j + 1]
        stop = np.append(at[1:], n)
        real = matrix[at, j] > 0 if j >= 0 else np.ones(len(at), bool)
        count = stop - at
        is_open = (at == 0) | (stop == n) | (went_on[stop] > went_on[at]) | (j < 0)
        low, below, spared, children = (f.reduceat(x, at) for f, x in ((np.minimum, conv), (np.add, leaves), (np.add, saved), (np.add, kids)))
        own = (count - 1) * words[at, j] if j >= 0 else np.zeros(len(at), np.int64)
        done = real & ~is_open
        total_leaves = np.where(children == 0, 1, below)
        total_saved = spared + own
        enders = np.add.reduceat(((sizes == j + 1) & ~goes_on).astype(np.int64), at)
        depth = slab[at] * width + j + 1

        pick = np.flatnonzero(done)
        if len(pick):
            up = starts[j]
            above = np.searchsorted(up, at[pick], "right") - 1
            up_stop = np.append(up[1:], n)[above]
            up_open = (up[above] == 0) | (up_stop == n) | (went_on[up_stop] > went_on[up[above]]) | (j == 0)
            up_low = np.minimum.reduceat(conv, up)[above]
            of_open = np.flatnonzero(up_open)
            parent_key: list = [None] * len(pick)
            for i, key in zip(of_open.tolist(), keys(at[pick][of_open], j - 1), strict=True):
                parent_key[i] = key
            hashes = [
                hashlib.sha256(",".join(map(str, ended(a, c, j).tolist())).encode()).hexdigest() if e else EMPTY_SHA
                for a, c, e in zip(at[pick].tolist(), count[pick].tolist(), enders[pick].tolist(), strict=True)
            ]
            emit(
                kind=["whole"] * len(pick), parent_key=parent_key, conv_id=low[pick].tolist(), depth=depth[pick].tolist(),
                parent_conv_id=[None if o else x for o, x in zip(up_open.tolist(), up_low.tolist(), strict=True)],
                n_convs=count[pick].tolist(), n_children=children[pick].tolist(), n_leaves=total_leaves[pick].tolist(),
                saved_tokens=total_saved[pick].tolist(), ends=hashes,
            )
        pick = np.flatnonzero(real & is_open)
        if len(pick):
            shadow = [j < 0 and s > 0 for s in slab[at[pick]].tolist()]
            of = lambda x: [None if s else v for s, v in zip(shadow, x[pick].tolist(), strict=True)]
            named = keys(at[pick], j)
            emit(
                kind=["open"] * len(pick), key=named, parent_key=keys(at[pick], j - 1) if j >= 0 else [None] * len(pick), conv_id=of(low),
                depth=depth[pick].tolist(), n_convs=of(count), words=words[at[pick], j].tolist() if j >= 0 else [0] * len(pick),
                n_children=children[pick].tolist(), n_leaves=below[pick].tolist(), saved_tokens=spared[pick].tolist(),
            )
            for key, a, c, e, s in zip(named, at[pick].tolist(), count[pick].tolist(), enders[pick].tolist(), shadow, strict=True):
                if e and not s:
                    members = ended(a, c, j).tolist()
                    pieces = [",".join(map(str, members[i : i + piece])) for i in range(0, len(members), piece)]
                    emit(kind=["ends"] * len(pieces), key=[key] * len(pieces), depth=[0] * len(pieces), ends=pieces, piece=list(range(len(pieces))))
        leaves, saved, kids = (np.zeros(n, np.int64) for _ in range(3))
        leaves[at[done]], saved[at[done]], kids[at[done]] = total_leaves[done], total_saved[done], 1
    out["shard"] = [shard] * len(out["kind"])
    made = pa.table({f.name: pa.array(out[f.name], f.type) for f in _PARTS}, schema=_PARTS)
    yield from made.to_batches(max_chunksize=1 << 14)


def _recombined(parts: DataFrame) -> DataFrame:
    """One row for each node that lay in several parts, with the sums of its subtree.

    The sums climb by pointer doubling: after round k a node holds what is less
    than 2^k steps below it and passes that on to the node 2^k steps above.
    """
    nodes = stored(
        parts.groupBy("key").agg(
            F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
            F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"),
            *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
        ),
        "open-nodes",
    )
    more = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    own = (F.col("n_convs") - 1) * F.col("words")
    nodes = nodes.join(more, "key", "left").withColumn("n_children", children)
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    nodes = stored(nodes.withColumn("saved_tokens", F.col("saved_tokens") + own).withColumn("jump", F.col("parent_key")), "open-nodes")
    climbing = nodes.select("key", "jump", "n_leaves", "saved_tokens")
    while not climbing.where("jump is not null").isEmpty():
        told = climbing.where("jump is not null").groupBy(F.col("jump").alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        above = climbing.select(F.col("key").alias("jump"), F.col("jump").alias("further"))
        climbing = climbing.join(told, "key", "left").join(above, "jump", "left").select(
            "key", F.col("further").alias("jump"),
            (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
        )
        climbing = stored(climbing, "climbing")
    kept = nodes.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children")
    return stored(kept.join(climbing.drop("jump"), "key"), "open-sums")


def _hashed_ends(pieces: DataFrame) -> DataFrame:
    """``key, ends_sha256``: pieces of one key follow each other, in shard order, into one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, sums = [], []
            for one, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if one != key:
                    if key is not None:
                        keys.append(key)
                        sums.append(digest.hexdigest())
                    key, digest = one, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(sums, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "ends_sha256"])

    dealt = pieces.select("key", "shard", "piece", "ends").repartition("key").sortWithinPartitions("key", "shard", "piece")
    return dealt.mapInArrow(run, "key binary, ends_sha256 string")

"""The trie of turns against a plain dictionary of all beginnings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cubeloom.llm import turn_trie
from cubeloom.llm.queries import QUERIES

ROWS = "conv_id bigint, turn bigint, role string, text string, pos string, depth string, key string, n string, slab string"


def shared(placed):
    return turn_trie.with_shared_heads(placed, 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)


def sequences(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    return {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}


def rebuilt(own):
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: heads[c]] + own[c][heads[c] :] for c in own}


def plain(seqs):
    members, kids = defaultdict(list), defaultdict(list)
    for conv, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(conv)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
        ends = ",".join(map(str, sorted(c for c in members[node] if len(seqs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], ROWS).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def dialogues(seed, most, ids=120):
    rng = random.Random(seed)
    for conv in rng.sample(range(300), ids):
        for turn in range(rng.choice([1, 2, 3, most // 2, most])):
            text = "x y " * (turn % 3) if rng.random() < 0.95 else rng.choice([None, "z q", "k", "　w\x1cv"])
            yield conv, None if turn == 0 and rng.random() < 0.5 else turn, rng.choice(["user", None]) if turn < 2 else "user", text


@pytest.mark.parametrize(("most", "width", "cells", "piece"), [(8, 64, 1 << 20, 1 << 15), (9, 4, 60, 3), (6, 2, 8, 1), (40, 4, 300, 7)])
def test_trie_equals_dictionary(spark, most, width, cells, piece):
    rows = list(dialogues(most, most))
    df = frame(spark, rows)
    own = sequences(rows)
    alone = turn_trie.trie(turn_trie.turns(df), width, cells, piece)
    assert got(alone) == plain(own)
    assert got(turn_trie.trie(shared(turn_trie.turns(df)), width, cells, piece)) == plain(rebuilt(own))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    assert got(QUERIES["op12_turn_trie"](spark, "/root/testdata/sf0.01")) == plain(rebuilt(sequences(rows)))


def test_copies_and_a_long_conversation(spark):
    """A third of the conversations are equal, another third share a first turn, one and its copy are long."""
    rows = [(c, t, "user", f"same {t}") for c in range(100) for t in range(3)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(100, 200) for t in range(2)]
    rows += [(c, t, "a", f"long {t}") for c in (300, 301) for t in range(700)] + [(301, 700, "a", "more")]
    df = frame(spark, rows)
    assert got(turn_trie.trie(turn_trie.turns(df), 16, 400, 9)) == plain(sequences(rows))


def test_odd_rows(spark):
    """Equal rows are turns of their own; turnless conversations belong to the root; rows without an id are left out."""
    rows = [(1, 5, "u", "a")] * 3 + [(2, None, None, None), (2, None, None, None), (None, 1, "u", "x"), (-7, -2, "", " \n"), (-7, 9, "u", "w" * 100_000)]
    own = sequences(rows)
    assert got(turn_trie.trie(turn_trie.turns(frame(spark, rows)))) == plain(own)
    bare = spark.createDataFrame([(4, 0), (3, 0)], "conv_id bigint, pos bigint").select("conv_id", "pos", *[F.lit(None).cast("bigint").alias(c) for c in ("t1", "t2", "words")])
    assert got(turn_trie.trie(bare)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]
    empty = spark.createDataFrame([], ROWS)
    assert got(turn_trie.trie(shared(turn_trie.turns(empty)))) == []


def test_ties_are_ordered_alike_everywhere(spark):
    rows = [(c, 1, "u", t) for c in (1, 2) for t in ("b", "a", "c")]
    nodes = got(turn_trie.trie(turn_trie.turns(frame(spark, rows))))
    assert [n[:2] for n in nodes] == [(1, d) for d in range(4)] and all(n[3] == 2 for n in nodes)

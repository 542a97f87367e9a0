"""Duplicate spans against a plain version that knows every window."""

import random
import re
from collections import Counter
from hashlib import sha256

import pytest
from conftest import SCHEMA

from cubeloom.llm import substrings
from cubeloom.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, span):
    """doc_id, words, removed words and digest of the kept ones, for each row."""
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in split:
        if i is not None:
            for k in range(len(words) - span + 1):
                w = tuple(words[k : k + span])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - span + 1) if i is not None else ():
            if first[tuple(words[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), sha256(kept.encode()).hexdigest()))
    return Counter(out)


def check(df, span):
    rows = substrings.dedup(df, span).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)
    assert got == plain([(r["doc_id"], r["text"]) for r in df.collect()], span)
    bare = substrings.dedup(df, span, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(tuple(r) for r in bare) == got
    return rows


def test_given_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], 13)
    assert Counter(tuple(r) for r in QUERIES["op7_relative_parsing"](spark, sf_dir).collect()) == want
    assert sum(r[2] > 0 for r in want) > 100
    check(docs.repartition(7), 13)


@pytest.mark.parametrize("seed", range(4))
def test_dense_repeats(spark, seed):
    """Few words and many pasted pieces, so that windows are shared in every mixture of blocks."""
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 7) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(80):
        words = []
        while len(words) < rng.randint(0, 70):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            piece = b[a : a + rng.randint(1, 30)]
            if rng.random() < 0.4:
                piece[rng.randrange(len(piece))] = f"w{rng.randint(0, 9)}"
            words += piece
        rows.append((rng.randint(-30, 60), rng.choice([" ", "\n", " \t "]).join(words), None, None, None))
    check(spark.createDataFrame(rows, SCHEMA).repartition(5), rng.choice([3, 5, 8]))


def test_odd_and_empty(spark, odd, empty):
    check(odd, 3)
    assert substrings.dedup(empty).collect() == []
    rest = substrings.dedup(odd, 3).select("rest.*").columns
    assert set(rest) == set(odd.columns) - {"text"}


def test_kept_text_and_spans(spark):
    rows = [
        (1, "a b  c\nd e f g", None, None, None), (2, "x  a b c d\ty", None, None, None), (3, "p\nq", None, None, None),
        (4, " a b c d", None, None, None),
    ]
    got = {r["doc_id"]: r for r in substrings.dedup(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    assert got[1]["text"] == "a b  c\nd e f g" and got[3]["text"] == "p\nq"
    assert got[2]["text"] == "x  y" and [tuple(s) for s in got[2]["spans"]] == [(1, 4)]
    assert got[4]["text"].strip() == "" and got[4]["n_removed"] == 4


def test_many_copies(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(i, text if i % 3 else f"{i} {text}", None, None, None) for i in range(600)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(6), 13)

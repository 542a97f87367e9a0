"""Items against plain edit distances; recall on edited copies."""

import random

import numpy as np
import pytest
from conftest import SCHEMA
from hypothesis import given, settings
from hypothesis import strategies as st

from cubeloom.llm import decontaminate
from cubeloom.llm.queries import QUERIES

ITEMS = "item_id bigint, text string"


def plain_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=40), st.text("abcd ", max_size=60))
def test_edits(item, text):
    assert decontaminate.edits(item, text) == plain_edits(item, text)


def fold(text):
    return " ".join((text or "").translate({c: c + 32 for c in range(65, 91)}).split())


def test_given_documents(spark):
    """All pairs in which a document holds a run of five words of an item are tried in full."""
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: fold(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: fold(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    runs = {}
    for i, t in items.items():
        w = t.split()
        for k in range(len(w) - 4):
            runs.setdefault(tuple(w[k : k + 5]), set()).add(i)
    want = {}
    for d, t in docs.items():
        w = t.split()
        for i in {i for k in range(len(w) - 4) for i in runs.get(tuple(w[k : k + 5]), ())}:
            e = decontaminate.edits(items[i], t)
            if e <= 0.2 * len(items[i]):
                want[d, i] = e
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in QUERIES["op2_decontamination"](spark, sf_dir).collect()}
    assert got == want and len(want) > 10
    kept = decontaminate.clean(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == set(docs) - {d for d, _ in want}


def prose(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_recall_on_edited_copies(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(prose(rng, rng.randint(15, 60)))) for i in range(60)]
    rows, want = [], {}
    for d in range(300):
        i, text = rng.choice(items)
        words = text.split()
        for _ in range(int(0.1 * len(words))):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["new", words[k]], [words[k][::-1]]])
        whole = fold(" ".join(prose(rng, 100) + words + prose(rng, 100)))
        e = decontaminate.edits(text, whole)
        if e <= 0.2 * len(text):
            want[d, i] = e
        rows.append((d, whole, None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.matches(docs, spark.createDataFrame(items, ITEMS)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 200
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)


def test_exact_copies_of_short_items(spark):
    """Items of one to twelve words, whether or not one of their words is an anchor with room behind it."""
    rng = random.Random(3)
    items = [(n * 100 + k, " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(n))) for n in range(1, 13) for k in range(12)]
    docs = spark.createDataFrame([(i, f"Not {' '.join(prose(rng, 20))} {t.upper()} or else", None, None, None) for i, t in items], SCHEMA)
    docs = docs.unionByName(spark.createDataFrame([(-1, " ".join(prose(rng, 200)), None, None, None)], SCHEMA))
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.matches(docs, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(i, i, 0) for i, _ in items}
    assert [r["doc_id"] for r in decontaminate.clean(docs, spark.createDataFrame(items, ITEMS)).collect()] == [-1]


@pytest.mark.parametrize("rate", [0.2, 0.3])
def test_all_copies_with_up_to_rate_of_the_words_edited(spark, rate):
    """Items of 15 to 20 words: everything brute force takes is found, from no edit up to ``rate`` of the words."""
    rng = random.Random(7)
    items = [(i, " ".join(prose(rng, rng.randint(15, 20)))) for i in range(60)]
    rows, want = [], set()
    for d in range(400):
        i, text = items[d % 60]
        words = text.split()
        most = int(rate * len(words) + 1e-9)
        for _ in range(most if d % 2 else rng.randint(0, most)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["new", words[k]], [words[k][::-1]]])
        whole = fold(" ".join(prose(rng, 60) + words + prose(rng, 60)))
        if decontaminate.edits(text, whole) <= rate * len(text):
            want.add((d, i))
        rows.append((d, whole, None, None, None))
    docs, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items, rate=rate).collect()}
    assert got == want and len(want) > 350
    assert {r["doc_id"] for r in decontaminate.clean(docs, items, rate=rate).collect()} == set(range(400)) - {d for d, _ in want}


def test_blocks_hold_all_items(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} " * 8) for i in range(50)] + [(None, None), (3, "item number 3 " * 8)], ITEMS)
    docs = spark.createDataFrame([(i, "x " * 20 + f"ITEM number {i} " * 8, None, None, None) for i in range(50)], SCHEMA)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.matches(docs, items, rate=0.0).collect()}
    assert got == {(i, i, 0) for i in range(50)}


def test_odd_and_empty(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same words here " * 5), (4, "too short an item")], ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(odd, items).collect()}
    assert got == {(11, 3), (12, 3)}
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate.matches(empty, items).collect() == [] and decontaminate.clean(empty, items).collect() == []
    assert decontaminate.matches(odd, spark.createDataFrame([], ITEMS)).collect() == []


def test_recall_of_bit_sampling():
    assert decontaminate.repetitions(0.99) > decontaminate.repetitions(0.9) > 1
    ids = np.arange(40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    one = decontaminate.embed(ids, np.array([0]), np.array([40]), 0)[:, 0]
    cut = decontaminate.embed(np.delete(ids, 10), np.array([0]), np.array([39]), 0)[:, 0]
    assert (one[:10] == cut[:10]).all() and (one == cut).mean() > 0.3

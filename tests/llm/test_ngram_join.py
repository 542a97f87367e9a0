"""Components of the similarity join against all pairs."""

import random
import re
from collections import Counter

import pytest
from conftest import SCHEMA
from test_urls import plain_components

from cubeloom.llm import ngram_join
from cubeloom.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_set(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def plain(rows, n, percent):
    """Components by id over all pairs that share an n-gram."""
    sets = [(i, plain_set(t, n)) for i, t in rows]
    holders = {}
    for k, (i, s) in enumerate(sets):
        for g in s if i is not None else ():
            holders.setdefault(g, []).append(k)
    shared = Counter()
    for ks in holders.values():
        for x in range(len(ks)):
            for y in range(x):
                shared[ks[y], ks[x]] += 1
    edges = []
    for (x, y), both in shared.items():
        if 100 * both >= percent * (len(sets[x][1]) + len(sets[y][1]) - both):
            edges.append((sets[x][0], sets[y][0]))
    roots = plain_components(edges)
    return Counter((i, len(s), roots.get(i, i)) for i, s in sets)


def check(df, n, percent):
    got = Counter(tuple(r) for r in ngram_join.join(df, n, percent).collect())
    assert got == plain([(r["doc_id"], r["text"]) for r in df.collect()], n, percent)
    return got


def test_given_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = Counter(tuple(r) for r in QUERIES["op3_ngram_join"](spark, sf_dir).collect())
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 90)
    assert sum(r[0] != r[2] for r in got) > 50


@pytest.mark.parametrize(("seed", "percent"), [(0, 60), (1, 80), (2, 90)])
def test_edited_copies(spark, seed, percent):
    """Copies of copies with edits around the limit, many of them in one large group."""
    rng = random.Random(seed)
    pool = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 90))] for _ in range(5)]
    rows = []
    for i in range(150):
        words = list(rng.choice(pool[:2] if rng.random() < 0.6 else pool))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 5000)}"
        pool.append(words)
        rows.append((rng.randint(-20, 400), " ".join(words).upper() if i % 7 == 0 else " ".join(words), None, None, None))
    check(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, percent)


def test_more_than_one_turn(spark, monkeypatch):
    """With no allowance for open pairs, leaders are tried until a turn finds nothing."""
    monkeypatch.setattr(ngram_join, "PAIRS_A_POSTING", 0)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        base = list(base)
        base[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(base), None, None, None))
    check(spark.createDataFrame(rows, SCHEMA), 3, 85)


def test_odd_and_empty(spark, odd, empty):
    check(odd, 3, 90)
    assert ngram_join.join(empty).collect() == []

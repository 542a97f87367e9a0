"""Counts against plain Python; the estimation on made votes; classifiers on held-out rows."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cubeloom.llm import nbsvm, quality_rules, toxicity
from cubeloom.llm import features as X
from cubeloom.llm.queries import CHAIN, QUERIES

DATA = "/root/testdata/sf0.1"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_ended": sum(WORD.findall(x)[-1][-1] in ".!?" for x in lines),
    }


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text("ab é\n\t#|.!", max_size=60))))
def test_counts(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    found = quality_rules.counts([None if t is None else t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert {k: int(found[k][i]) for k in plain_counts(t)} == plain_counts(t)


def test_odd_rows_and_empty_table(spark, odd, empty):
    rows = quality_rules.judge(quality_rules.measure(odd), np.ones(3**9)).collect()
    texts = Counter((r["doc_id"], *plain_counts(r["text"]).values()) for r in odd.collect())
    assert Counter((r["doc_id"], *[r[k] for k in plain_counts("")]) for r in rows) == texts
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])
    kept = quality_rules.keep(odd)
    assert kept.columns == odd.columns and kept.count() == 0
    assert quality_rules.keep(empty).collect() == []


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    votes = np.where(rng.random((20_000, 6)) < 0.2, 1, np.where(good[:, None], 2, np.where(rng.random((20_000, 6)) < 0.5, 0, 2)))
    patterns, weights = np.unique(quality_rules.pattern(votes), return_counts=True)
    posterior = quality_rules.estimate(patterns, weights.astype(float), 6)
    decided = posterior[quality_rules.pattern(votes)] >= 0.5
    seen_bad = (votes == 0).any(axis=1)
    assert (decided == good).mean() > 0.96 and not decided[seen_bad].any()
    assert (quality_rules.estimate(np.zeros(0, int), np.zeros(0), 6) <= 1).all()


def test_rules_agree_with_labels(spark):
    rows = QUERIES["op1_quality_rules"](spark, DATA).where("not base_failed")
    got = rows.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    got = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert got.get((1, False), 0) <= 0.005 * got[1, True]
    assert got.get((0, True), 0) <= 0.05 * got[0, False]


def test_keep_equals_judge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.keep(docs).collect()}
    told = QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.01").where("kept").collect()
    assert kept == {r["doc_id"] for r in told} and len(kept) > 700


def test_classifier_on_held_out_rows(spark):
    rows = QUERIES["op6_nbsvm_quality"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = rows.where("held_out").join(labels, "doc_id").collect()
    assert len(got) > 500 and sum(r["predicted"] == r["quality"] for r in got) >= 0.98 * len(got)
    assert rows.count() == 10_000 and all(0 <= r["score"] <= 1 for r in got)


def test_chain_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").selectExpr(
        "doc_id", "toxic * (1 - quality) toxic_junk", "toxic * quality toxic_prose", "toxic"
    )
    models = toxicity.fit(docs, labels.where("crc32(cast(doc_id as string)) % 4 <> 2"), CHAIN)
    held = labels.where("crc32(cast(doc_id as string)) % 4 = 2")
    rows = toxicity.score(docs, models, CHAIN).join(held, "doc_id").collect()
    caught = [r["p_toxic"] >= 0.5 for r in rows if r["toxic"]]
    clean = [r["p_toxic"] >= 0.5 for r in rows if not r["toxic"]]
    assert sum(caught) >= 0.93 * len(caught) and sum(clean) <= 0.01 * len(clean)
    assert len(models[2][2]) == 3  # the third model weighs two earlier probabilities


def test_classifiers_on_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (77, 0)], "doc_id bigint, quality int")
    model = nbsvm.fit(odd, labels)
    rows = nbsvm.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    bare = nbsvm.fit(empty, labels)
    assert nbsvm.score(empty, bare).collect() == []
    assert {r["score"] for r in nbsvm.score(odd, bare).collect()} == {0.5}
    assert toxicity.score(odd, toxicity.fit(odd, labels, ["quality"]), ["quality"]).count() == odd.count()


ALONE = [None, "", " \n", "one", "a b a b a b a b", "Ein Test, noch einer!", "$$$ win ### now", "x" * 70_000, "", "many words " * 500]


def plain_margin(text, weights, scale, tail, earlier):
    """One text on its own, feature by feature."""
    held = sorted(set(X.indicators([None if text is None else text.encode()])[1].tolist()))
    assert held
    size = sum(float(scale[f]) ** 2 for f in held) ** 0.5 or 1.0
    return sum(float(weights[f]) for f in held) / size + sum(float(a) * b for a, b in zip(tail, [*earlier, 1.0], strict=True))


def plain_chain(text, models):
    earlier = []
    for weights, scale, tail, (slope, shift) in models:
        z = slope * plain_margin(text, weights, scale, tail, earlier) + shift
        earlier.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
    return earlier


def test_scores_do_not_depend_on_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model, chain = nbsvm.fit(docs, labels, "quality"), toxicity.fit(docs, labels, ["quality", "toxic"])
    texts = ALONE + [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ALONE
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for parts, batch in ((1, 10_000), (3, 10_000), (50, 10_000), (2, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            one = {r["doc_id"]: r["score"] for r in nbsvm.score(rows.repartition(parts), model).collect()}
            two = {r["doc_id"]: (r["p_quality"], r["p_toxic"]) for r in toxicity.score(rows.repartition(parts), chain, ["quality", "toxic"]).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for i, text in enumerate(texts):
            assert abs(one[i] - plain_chain(text, [model])[0]) < 1e-5
            assert np.allclose(two[i], plain_chain(text, chain), atol=1e-5)
    assert one[0] == one[1] == one[2] == one[len(texts) - 2 - 7]


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(60)]
    y = np.where([1 in r or 2 in r for r in rows], 1.0, -1.0)
    scale = X.log_count_ratios(rows, y)

    def loss(w, v):
        total = 0.5 * (w @ w + v @ v)
        for r, s in zip(rows, y, strict=True):
            x = scale[r] / np.linalg.norm(scale[r])
            total += 0.5 * max(0, 1 - s * (w[r] @ x + v[-1])) ** 2
        return total

    weights, tail = X.hinge(rows, y, scale, rounds=300)
    w = np.divide(weights, scale, out=np.zeros_like(weights), where=scale != 0)
    best = loss(w, tail)
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.01, len(w)) * (np.arange(len(w)) < 40), tail + rng.normal(0, 0.01, 1)) >= best - 1e-6

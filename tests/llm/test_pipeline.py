"""The pipeline against plain versions of its stages."""

import pytest
from test_decontaminate import fold
from test_ngram_join import plain as plain_groups
from test_substrings import WORD, plain as plain_spans
from test_tokens import check_packing

import corpus_pipeline
from cubeloom.llm import decontaminate, quality_rules

DATA = "/root/testdata/sf0.001"


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [fold(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]

    def step(name, docs):
        out = stages[name](spark, docs, DATA)
        if name != "best-fit packing":
            assert out.columns == columns
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema), rows

    measured = quality_rules.measure(docs)
    good = {r["doc_id"] for r in quality_rules.judge(measured, quality_rules.fit(measured)).where("kept").collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    docs, rows = step("quality rules", docs)
    assert {r["doc_id"]: r for r in rows} == {i: r for i, r in before.items() if i in good}

    before = {r["doc_id"]: r for r in rows}
    groups = plain_groups([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    docs, rows = step("n-gram Jaccard join", docs)
    assert {r["doc_id"]: r for r in rows} == {i: before[i] for i, _, root in groups if i == root}

    want = plain_spans([(r["doc_id"], r["text"]) for r in rows], 13)
    want = {i: (n - gone, digest) for i, n, gone, digest in want if gone < n or n == 0}
    before = {r["doc_id"]: r for r in rows}
    docs, rows = step("substring dedup", docs)
    assert {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows} == {i: n for i, (n, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) and r["lang"] == before[r["doc_id"]]["lang"] for r in rows)

    docs, kept = step("benchmark decontamination", docs)
    held = {r["doc_id"] for r in rows if any(decontaminate.edits(t, fold(r["text"])) <= 0.2 * len(t) for t in items)}
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in rows} - held

    _, pieces = step("best-fit packing", docs)
    check_packing(pieces, [(r["doc_id"], r["text"]) for r in kept], 2048)
    whole = corpus_pipeline.run(spark, DATA).collect()
    facts = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted([r[c] for c in facts] for r in whole) == sorted([r[c] for c in facts] for r in pieces)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty(spark, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    last = name == "best-fit packing"
    rows = stage(spark, odd, DATA)
    assert last or rows.columns == odd.columns
    got = rows.collect()
    if name == "n-gram Jaccard join":
        ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
        assert len(ids) == len(set(ids)) and 5 in ids and 11 in ids and 12 not in ids and len(got) == len(ids) + 1
    assert stage(spark, empty, DATA).collect() == []

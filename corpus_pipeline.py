"""Training-text preparation: five stages in order, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import decontaminate, ngram_join, packing, quality_rules, substrings
from cubeloom.llm.queries import table, vocabulary
from cubeloom.session import SCRATCH, delete_paths, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left_behind: list[str] = []


def tidy(stage: Stage) -> Stage:
    """What a stage leaves in the shared folder goes when the next one begins: by then its result is written."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_paths(spark, _left_behind)
        made = len(SCRATCH)
        out = stage(spark, docs, sf_dir)
        _left_behind[:] = SCRATCH[made:]
        return out

    return run_stage


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (1): documents that fail the base rules or are probably bad go."""
    return quality_rules.keep(docs)


@tidy
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (3): of each group alike in 5-word shingles (0.8 or more) the smallest id stays, in its first row.

    Rows without an id can't be told apart and stay.
    """
    alone = ngram_join.join(docs, n=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    first = numbered.groupBy("doc_id").agg(F.min("__row").alias("__row")).join(alone, "doc_id", "left_semi")
    kept = numbered.join(first, ["doc_id", "__row"], "left_semi")
    return kept.unionByName(numbered.where("doc_id is null")).select(*docs.columns)


@tidy
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (7): passages of earlier documents are cut out; a document that loses all its words goes."""
    found = substrings.dedup(docs).where("n_removed < n_words or n_words = 0")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("rest.n_chars"))
    own = {"text": F.col("text"), "n_chars": length}
    return found.select(*[own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


@tidy
def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (2): documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (8): a row for each piece of each document."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", passages),
    ("benchmark decontamination", benchmarks),
    ("best-fit packing", packed),
]

#: No SQL: the estimation of the first stage and the tokenizer of the last have none. tests/llm/test_pipeline.py
#: holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        delete_paths(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs

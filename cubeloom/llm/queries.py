"""Registered queries: each operator over its whole table with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stored
from . import (
    decontaminate, html_text, nbsvm, ngram_join, packing, quality_rules, ring, sql, substrings, token_store, toxicity, turn_trie, url_rules,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file, which every machine has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stored(quality_rules.measure(table(spark, sf_dir, "documents")), "measured")
    told = quality_rules.judge(measured, quality_rules.fit(measured))
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op4_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


@query
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path, vocabulary())
    return token_store.documents(spark, path, vocabulary())


@query
def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = nbsvm.fit(docs, labels.where(~held_out), "quality")
    scored = nbsvm.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query
def op7_relative_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


#: Toxic junk, toxic prose, and toxic of either kind.
CHAIN = ["toxic_junk", "toxic_prose", "toxic"]


@query
def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bad, good = F.col("toxic") * (1 - F.col("quality")), F.col("toxic") * F.col("quality")
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("toxic_junk"), good.alias("toxic_prose"), "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, CHAIN), CHAIN)
    return scored.select("*", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).alias("toxic"))


@query
def op10_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.shard(table(spark, sf_dir, "documents"))
    return placed.select("*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op11_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    placed = turn_trie.turns(table(spark, sf_dir, "conversations"))
    return turn_trie.trie(turn_trie.with_shared_heads(placed, 20, heads))


@query
def op13_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = whitening.whole_numbers(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(numbers, whitening.fit(numbers, components=16))


ORACLES |= {
    "op3_ngram_join": sql.NGRAM_JOIN,
    "op4_redirect_rules": sql.redirect_rules(RULES),
    "op7_relative_parsing": sql.RELATIVE_PARSING,
    "op11_block_rules": sql.BLOCK_RULES,
    "op12_turn_trie": sql.TURN_TRIE,
}

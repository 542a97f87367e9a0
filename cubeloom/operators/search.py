"""Fuzzy look-ups and finding the column a classification belongs to."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import Profile, name_ratio, profile, score, score_bounds
from ..session import stored

NAME_THRESHOLD = 0.7  # fixed value


class Best:
    """The ``n`` best texts for one query so far, by score, then text; ``scored`` counts the texts that were scored."""

    def __init__(self, query: str, n: int) -> None:
        self.query, self.n, self.own, self.scored = query, n, profile([query]), 0
        self.kept: list[tuple[float, str]] = []

    def offer(self, texts: list[str], profiles: Profile) -> None:
        """Score texts from the highest bound down, until no bound reaches the n-th best score."""
        bounds = score_bounds(self.own, profiles)
        for i in np.argsort(-bounds, kind="stable").tolist():
            if len(self.kept) == self.n and bounds[i] < -self.kept[-1][0]:
                break
            self.scored += 1
            insort(self.kept, (-score(self.query, texts[i]), texts[i]))
            del self.kept[self.n :]


def fuzzy_top(labels: DataFrame, queries: list[str], n: int = 5) -> DataFrame:
    """The ``n`` best labels for each query string: ``query, rank, code, label, score``.

    ``labels`` is ``(code, label)``. A text counts once, however many codes carry
    it, and is scored only where its bound, from the letters and words it shares
    with the query, reaches the n-th best score met so far; so the result is that
    of scoring all. Each task passes on its own best ``n``; texts are distinct,
    so the best ``n`` of all are among them and pairs never pile up.
    """
    wanted = list(dict.fromkeys(queries))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [Best(q, n) for q in wanted]
        for batch in batches:
            texts = batch["label"].tolist()
            profiles = profile(texts)
            for one in found:
                one.offer(texts, profiles)
        rows = [(one.query, label, -negative) for one in found for negative, label in one.kept]
        yield pd.DataFrame(rows, columns=["query", "label", "score"])

    texts = labels.select("label").where(F.col("label").isNotNull()).distinct()
    scored = texts.mapInPandas(best, "query string, label string, score double")
    # at least one code per text, so the n best texts are enough for the n best rows
    by_text = Window.partitionBy("query").orderBy(F.desc("score"), "label")
    few = scored.withColumn("_t", F.row_number().over(by_text)).where(F.col("_t") <= n).drop("_t")
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), "label", "code")
    rows = few.join(labels, "label").withColumn("rank", F.row_number().over(by_row)).where(F.col("rank") <= n)
    return rows.select("query", "rank", "code", "label", F.round("score", 6).alias("score"))


def _name_scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_ratio(x, y) for x, y in zip(a, b)])


def discover_links(requests: DataFrame, values: DataFrame, dims: DataFrame) -> DataFrame:
    """Fact column each requested ``(table_id, dim_id)`` belongs to.

    In turn: the only column that is a prefix of the dimension's name; the most
    similar name at 0.7 or more; the column that shares most codes, then the
    larger share of its own codes. ``rule`` says which applied, ``none`` if no
    column fits.
    """
    columns = values.select("table_id", "column_name").distinct()
    named = stored(requests.select("table_id", "dim_id").distinct().join(columns, "table_id"), "named")
    # names recur from table to table, so each pair of names is scored once
    pairs = named.select("column_name", "dim_id").distinct()
    pairs = stored(pairs.withColumn("_name", F.pandas_udf(_name_scores, "double")("column_name", "dim_id")), "names")
    named = named.join(pairs, ["column_name", "dim_id"])
    prefix = F.when(F.col("dim_id").startswith(F.col("column_name")), F.col("column_name"))
    by_name = named.groupBy("table_id", "dim_id").agg(
        F.count(prefix).alias("_prefixes"),
        F.min(prefix).alias("_prefix"),
        F.max("_name").alias("_best"),
        # equal similarity: first column by name
        F.min(F.struct((-F.col("_name")).alias("s"), "column_name"))["column_name"].alias("_closest"),
    )
    decided = by_name.withColumns(
        {
            "rule": F.when(F.col("_prefixes") == 1, "prefix").when(F.col("_best") >= NAME_THRESHOLD, "name"),
            "column_name": F.when(F.col("_prefixes") == 1, F.col("_prefix")).when(
                F.col("_best") >= NAME_THRESHOLD, F.col("_closest")
            ),
        }
    ).select("table_id", "dim_id", "rule", "column_name")
    undecided = decided.where(F.col("rule").isNull()).select("table_id", "dim_id")
    known = dims.select("dim_id", F.col("kode").cast("string").alias("id")).distinct().withColumn("_hit", F.lit(1))
    overlaps = (
        values.select("table_id", "column_name", F.col("id").cast("string").alias("id"))
        .where(F.col("id").isNotNull())
        .distinct()
        .join(undecided, "table_id")
        .join(known, ["dim_id", "id"], "left")
        .groupBy("table_id", "dim_id", "column_name")
        .agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("size"))
    )
    by_codes = overlaps.groupBy("table_id", "dim_id").agg(
        F.min(
            F.struct((-F.col("hits")).alias("h"), (-(F.col("hits") / F.col("size"))).alias("r"), "column_name")
        ).alias("b")
    )
    return decided.join(by_codes, ["table_id", "dim_id"], "left").select(
        "table_id",
        "dim_id",
        F.coalesce("rule", F.when(F.col("b.h") < 0, "codes"), F.lit("none")).alias("rule"),
        F.coalesce("column_name", F.when(F.col("b.h") < 0, F.col("b.column_name"))).alias("column_name"),
    )

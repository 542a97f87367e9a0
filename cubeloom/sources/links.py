"""Dimension links: one JSON list per fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_name_column

LINKS = "array<struct<column:string,dimension:string,match_type:string,note:string,join_override:string>>"


def parse_links(documents: DataFrame) -> DataFrame:
    """Links of documents ``(table_id, body)``: names normalised, match type ``exact`` by default.

    A column linked twice keeps its last entry.
    """
    entry = F.posexplode(F.from_json("body", LINKS)).alias("pos", "link")
    flat = documents.select("table_id", entry).select(
        F.lower("table_id").alias("table_id"),
        "pos",
        plain_name_column(F.col("link.column")).alias("column_name"),
        F.struct(
            F.lower(F.trim("link.dimension")).alias("dim_id"),
            F.coalesce("link.match_type", F.lit("exact")).alias("match_type"),
            F.col("link.note").alias("note"),
            F.col("link.join_override").alias("join_override"),
        ).alias("v"),
    )
    return flat.groupBy("table_id", "column_name").agg(F.max_by("v", "pos").alias("v")).select(
        "table_id", "column_name", "v.*"
    )


def load_links(spark: SparkSession, folder: str) -> DataFrame:
    """Read ``<folder>/<TABLE>.json``, one file per fact table."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return parse_links(files.select(name.alias("table_id"), F.col("value").alias("body")))

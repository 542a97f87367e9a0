"""Typed tables: what is still to be loaded, and loading it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import DATE_FORMS, parse_range_text, range_text
from ..operators.clean import SPARK_TYPES, infer_types

SORT_FIRST = 2  # leading code columns that rows are sorted by inside a file


def pending_tables(available: DataFrame, loaded: DataFrame) -> DataFrame:
    """Tables with data that are not loaded yet; names are compared in lower case."""
    name = F.lower("table_id").alias("table_id")
    return available.select(name).distinct().join(loaded.select(name).distinct(), "table_id", "left_anti")


def cast_to_stored(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Columns cast to their stored types; found by one pass if not given.

    Only the list of column types, one row per column, reaches the driver.
    """
    if types is None:
        types = {r.column_name: r.column_type for r in infer_types(df).collect()}
    out = []
    for field in df.schema.fields:
        stored, c = types[field.name], F.col(field.name)
        if stored == "int4range":
            out.append(c if field.dataType.typeName() == "struct" else parse_range_text(c).alias(field.name))
        elif stored.startswith("varchar"):
            out.append(c.cast("string").alias(field.name))
        else:
            out.append(c.cast(SPARK_TYPES[stored]).alias(field.name))
    return df.select(*out)


def fact_columns(cleaned: DataFrame) -> DataFrame:
    """A cleaned fact of one table in its final columns: ``tid`` and ``alder`` in the type that the table's form has.

    Dates, ranges, whole numbers or text; the cleaning keeps every form side by
    side and says which one holds. Only the two form names reach the driver.
    """
    helpers = [c for c in cleaned.columns if c.startswith(("tid_", "alder_"))]
    forms = [c for c in ("tid_form", "alder_form") if c in cleaned.columns]
    used = cleaned.agg(*[F.max(c).alias(c) for c in forms]).first()
    period = {"span": "tid_range", **{form: "tid_date" for form in DATE_FORMS}}.get(used["tid_form"], "tid_text")
    out = cleaned.withColumn("tid", F.col(period))
    if "alder_form" in forms:
        out = out.withColumn("alder", F.col(f"alder_{used['alder_form'] or 'text'}"))
    return out.drop(*helpers)


def load_fact(df: DataFrame, path: str, types: dict[str, str] | None = None, partition: str = "tid") -> DataFrame:
    """Write a cleaned fact with its stored types and return it as read back.

    Partitioned by period, rows sorted by their leading codes inside a file, so
    the minima and maxima in the file footers cut reads the way an index would;
    every code column has bloom filters, for codes that rows are not sorted by.
    Ranges can't name directories; such a table has their text as directory
    names and the range itself inside.
    """
    codes = [c for c in df.columns if c not in (partition, "indhold")]
    typed = cast_to_stored(df, types)
    plain = [c for c in codes if isinstance(typed.schema[c].dataType, (T.StringType, T.IntegralType))]
    ranges = isinstance(typed.schema[partition].dataType, T.StructType)
    folder = f"{partition}_key" if ranges else partition
    laid = typed.withColumn(folder, range_text(F.col(partition))) if ranges else typed
    (
        laid.hint("rebalance", folder)
        .sortWithinPartitions(folder, *codes[:SORT_FIRST])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .options(**{"parquet.bloom.filter.adaptive.enabled": "true"}, **{f"parquet.bloom.filter.enabled#{c}": "true" for c in plain})
        .partitionBy(folder)
        .parquet(path)
    )
    return df.sparkSession.read.schema(laid.schema).parquet(path).select(*typed.columns)


def load_dim(df: DataFrame, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Write a classification; the parent gets the type of the code."""
    if types is None:
        types = {r.column_name: r.column_type for r in infer_types(df.select("kode", "niveau", "titel")).collect()}
    types = {**types, "parent_kode": types["kode"]}
    typed = cast_to_stored(df.select("kode", "niveau", "titel", "parent_kode"), types)
    typed.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return df.sparkSession.read.schema(typed.schema).parquet(path)

"""Readers for the other formats facts and boundaries arrive in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import decimal, measure_problem


#: A separator that does not stand inside quotes.
_SEPARATOR = r';(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _fields(line: Column) -> Column:
    """The fields of a line, without their quotes."""
    bare = lambda f: F.replace(F.regexp_replace(f, r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(F.split(line, _SEPARATOR, -1), bare)


def _bulk_lines(spark: SparkSession, path: str, columns: list[str], decimals: tuple[str, ...]) -> DataFrame:
    """Every line of bulk files with its file, what is wrong with it, and its columns as text, found by the file's header."""
    text = spark.read.text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"),
    )
    # a file's lines are read in order, so its header is the first line of its first block; where it comes again, it is no data
    first = text.where("_start = 0").groupBy("file").agg(F.min_by("line", "_id").alias("_header"))
    headers = first.select("file", "_header", F.transform(_fields(F.col("_header")), F.upper).alias("_names"))
    lines = text.join(headers, "file").where((F.col("line") != F.col("_header")) & (F.col("line") != "")).withColumn("_fields", _fields(F.col("line")))
    place = {c: F.array_position("_names", c.upper()).cast("int") for c in columns}
    lacking = F.filter(F.array(*[F.when(place[c] == 0, F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    found = lines.select(
        "file", "line", lacking.alias("_lacking"), (F.size("_names") - F.size("_fields")).alias("_short"),
        *[F.get("_fields", place[c] - 1).alias(c) for c in columns],
    )
    wrong = F.when(F.size("_lacking") > 0, F.concat(F.lit("no column "), F.array_join("_lacking", ", ")))
    wrong = wrong.when(F.col("_short") > 0, "fields are missing").when(F.col("_short") < 0, "fields too many")
    return found.select("file", "line", wrong.alias("malformed"), F.coalesce(*[measure_problem(F.col(c)) for c in decimals], F.lit(None).cast("string")).alias("unread"), *columns)


def read_bulk_csv(
    spark: SparkSession, path: str, columns: list[str], decimals: tuple[str, ...] = ()
) -> DataFrame:
    """Semicolon CSV with a header; codes stay text, ``decimals`` have a decimal comma.

    Columns are found by the header of their own file, in any order and any case;
    other columns are left out. In a decimal column ``..`` and an empty cell are
    null. A malformed line, a missing column or other text in a decimal column
    ends the query; ``read_bulk`` keeps such lines apart instead. A field holds no line break.
    """
    lines = _bulk_lines(spark, path, columns, decimals)
    message = F.concat(F.col("malformed"), F.lit(": "), F.col("line"))
    whole = {c: F.when(F.col("malformed").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col(c)) for c in columns}
    return lines.select(*[(decimal(v) if c in decimals else v).alias(c) for c, v in whole.items()])


def read_bulk(spark: SparkSession, path: str, columns: list[str], decimals: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The good rows as from ``read_bulk_csv``, and every other line as ``file, line, reason``."""
    lines = _bulk_lines(spark, path, columns, decimals)
    reason = F.coalesce("malformed", "unread")
    good = lines.where(reason.isNull())
    rows = good.select(*[(decimal(F.col(c)) if c in decimals else F.col(c)).alias(c) for c in columns])
    return rows, lines.where(reason.isNotNull()).select("file", "line", reason.alias("reason"))


def read_geojson(spark: SparkSession, path: str, properties: list[str], layer: str) -> DataFrame:
    """Features of GeoJSON documents; the geometry stays JSON text."""
    fields = ", ".join(f"`{p}`: string" for p in properties)
    feature = f"struct<properties: struct<{fields}>, geometry: string>"
    documents = spark.read.schema(f"features array<{feature}>").json(path, multiLine=True)
    flat = documents.select(F.explode("features").alias("f"))
    return flat.select(F.lit(layer).alias("layer"), "f.properties.*", F.col("f.geometry").alias("geometry"))


def read_database(
    spark: SparkSession, url: str, table: str, split_column: str | None = None,
    bounds: tuple[int, int] | None = None, parts: int = 64, **options: str,
) -> DataFrame:
    """A database table; with a split column it is read in ``parts`` ranges at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_column and bounds:
        reader = reader.options(
            partitionColumn=split_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts
        )
    return reader.load()

"""Joins between facts and classifications.

No join here carries a broadcast hint: Spark broadcasts a side when its
statistics, or its size at run time, stay below the configured threshold, and
shuffles otherwise. Keys are always plain equalities, so both ways are open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layers import layer_key
from ..functions.periods import overlaps
from .clean import SPARK_TYPES

# Further stored type names beside those that a load gives.
STORED_TYPES = {
    **SPARK_TYPES, "varchar": "string", "character varying": "string", "character": "string", "numeric": "double", "real": "float",
}


def stored_type(name: str | None) -> T.DataType:
    """Spark type of a stored type's name, its length or precision aside; unknown names give a null type."""
    plain = re.sub(r"\(.*\)", "", name or "").strip().lower()
    return T.DataType.fromDDL(STORED_TYPES[plain]) if plain in STORED_TYPES else T.NullType()


def spark_family(kind: T.DataType) -> str:
    """``text``, ``numeric`` or ``other``: types of one family are compared as they are."""
    if isinstance(kind, T.StringType):
        return "text"
    return "numeric" if isinstance(kind, T.NumericType) else "other"


def _as_text(kind: T.DataType, partner: T.DataType) -> bool:
    """Whether a column must be cast to text to be compared with its partner."""
    return spark_family(kind) not in (spark_family(partner), "text")


def join_text(
    column: str, fact_type: str | None, dim_type: str | None, fact_alias: str = "", dim_alias: str = ""
) -> str:
    """The join condition as text, for the catalog."""
    kinds = stored_type(fact_type), stored_type(dim_type)
    sides = ((fact_alias, column, kinds), (dim_alias, "kode", kinds[::-1]))
    return "=".join(".".join(filter(None, (alias, name))) + "::text" * _as_text(*pair) for alias, name, pair in sides)


def typed_condition(facts: DataFrame, column: str, dims: DataFrame, key: str = "kode") -> Column:
    """Equality of a fact column and a classification code under the same rule.

    The cast to text is explicit: left alone, Spark would cast text to a number
    and fail on codes such as ``TOT``.
    """
    kinds = facts.schema[column].dataType, dims.schema[key].dataType
    left = facts[column].cast("string") if _as_text(*kinds) else facts[column]
    return left == (dims[key].cast("string") if _as_text(*kinds[::-1]) else dims[key])


def join_dim(facts: DataFrame, dims: DataFrame, column: str, level: int | None = None, how: str = "inner") -> DataFrame:
    """Facts with ``niveau, titel, parent_kode`` of their code; ``how='left'`` keeps unknown codes."""
    side = dims if level is None else dims.where(F.col("niveau") == level)
    side = side.select("kode", "niveau", "titel", "parent_kode")
    return facts.join(side, typed_condition(facts, column, side), how)


def join_padded(facts: DataFrame, dims: DataFrame, column: str, width: int, level: int | None = None) -> DataFrame:
    """Join on codes that the facts pad with zeros."""
    side = dims if level is None else dims.where(F.col("niveau") == level)
    padded = side.withColumn("_padded", F.lpad(F.col("kode").cast("string"), width, "0"))
    return facts.join(padded, facts[column] == padded["_padded"]).drop("_padded")


def join_override(facts: DataFrame, dims: DataFrame, condition: str, how: str = "inner") -> DataFrame:
    """Join on the condition a link states, with ``f`` the facts and ``n`` the classification."""
    return facts.alias("f").join(dims.alias("n"), F.expr(condition), how)


def code_values(facts: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct ``(table_id, column_name, id)`` over several columns in one pass; null codes are left out."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("id")) for c in columns])
    )
    return (
        facts.select("table_id", cells.alias("v"))
        .select("table_id", "v.column_name", "v.id")
        .where(F.col("id").isNotNull())
        .distinct()
    )


def dim_values_for_table(dims: DataFrame, values: DataFrame, links: DataFrame) -> DataFrame:
    """Classification rows whose code occurs in the linked fact column, compared as text.

    Where a table links one dimension through several columns, the first by
    name counts.
    """
    first = links.groupBy("table_id", "dim_id").agg(F.min("column_name").alias("column_name"))
    codes = (
        values.join(first, ["table_id", "column_name"])
        .select("table_id", "dim_id", F.col("id").cast("string").alias("_id"))
        .distinct()
    )
    return (
        dims.withColumn("_id", F.col("kode").cast("string"))
        .join(codes, ["dim_id", "_id"])
        .select("table_id", "dim_id", "kode", "niveau", "titel", "parent_kode")
    )


def missing_codes(values: DataFrame, dims: DataFrame, links: DataFrame) -> DataFrame:
    """Codes of linked fact columns that the classification does not have."""
    known = dims.select("dim_id", F.col("kode").cast("string").alias("id")).distinct()
    used = values.join(links.select("table_id", "column_name", "dim_id"), ["table_id", "column_name"])
    return used.join(known, ["dim_id", "id"], "left_anti").select("table_id", "column_name", "dim_id", "id")


def check_link(values: DataFrame, dims: DataFrame, links: DataFrame) -> DataFrame:
    """Verdict per link: in order if no code is missing, or only the total ``0``.

    The codes themselves come from ``missing_codes``, in rows, however many.
    """
    absent = missing_codes(values, dims, links)
    counted = absent.groupBy("table_id", "column_name", "dim_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("id") != "0").alias("_real"),
        F.min("id").alias("first_missing"),
    )
    zero = F.lit(0).cast("bigint")
    return links.select("table_id", "column_name", "dim_id").join(
        counted, ["table_id", "column_name", "dim_id"], "left"
    ).select(
        "table_id",
        "column_name",
        "dim_id",
        (F.coalesce("_real", zero) == 0).alias("ok"),
        F.coalesce("_n", zero).alias("n_missing"),
        "first_missing",
    )


def code_overlap(values: DataFrame, dims: DataFrame, links: DataFrame) -> DataFrame:
    """Per link: distinct codes used, how many the classification knows, and their ratio."""
    known = dims.select("dim_id", F.col("kode").cast("string").alias("id")).distinct().withColumn("_hit", F.lit(1))
    return (
        values.join(links.select("table_id", "column_name", "dim_id"), ["table_id", "column_name"])
        .join(known, ["dim_id", "id"], "left")
        .groupBy("table_id", "column_name", "dim_id")
        .agg(F.count(F.lit(1)).alias("codes"), F.count("_hit").alias("overlap"))
        .withColumn("overlap_ratio", F.round(F.col("overlap") / F.col("codes"), 6))
    )


def boundary_keys(features: DataFrame) -> DataFrame:
    """``(layer, dim_kode, navn, geometry)`` of raw features; the geometry is carried, not read."""
    return features.select("layer", layer_key(F.col("layer")).alias("dim_kode"), "navn", "geometry")


def boundary_merge(
    layer: DataFrame, facts: DataFrame, column: str, offset: int = 0, country: str = "0"
) -> DataFrame:
    """Facts on their boundaries: integer code less ``offset``, whole-country code dropped."""
    keyed = facts.where(F.col(column).cast("string") != country).withColumn(
        "dim_kode", F.col(column).cast("bigint") - offset
    )
    return keyed.join(layer.select("dim_kode", "navn", "geometry"), "dim_kode")


def cross_cube_join(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Measures of two cubes side by side, each first summed to the shared keys."""
    a = left.groupBy(*keys).agg(F.sum("indhold").alias(names[0]))
    b = right.groupBy(*keys).agg(F.sum("indhold").alias(names[1]))
    return a.join(b, keys)


def latest_period(facts: DataFrame, period: str = "tid", source: DataFrame | None = None) -> DataFrame:
    """Rows of the latest period, found by a scalar subquery.

    ``source`` is where the maximum is read, when it is cheaper than ``facts``.
    """
    periods = facts if source is None else source
    return facts.where(F.col(period) == periods.agg(F.max(period)).scalar())


#: Points in a slot from which on it is split: half of the 8-byte keys that a Parquet dictionary of 1 MB holds.
SLOT_POINTS = 1 << 16
#: Points of a block: two thirds of the 504 values that Parquet packs under one header, so packed blocks repeat byte by byte.
BLOCK = 336
#: Pairs that a task emits at once.
PAIRS = 1 << 16


def _slot(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``x``, by halving."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    return between(0, len(bounds))


def range_join(points: DataFrame, point: str, ranges: DataFrame, span: str) -> DataFrame:
    """Every point with every range that contains it, by a sweep along the axis.

    The axis is cut into slots at quantiles of the ranges' starts. A point goes to
    its slot once; a range goes to each slot it touches, an open one to all that
    follow. A slot with many points is split, and its ranges go to each part. A
    task meets ranges and points of a slot in order: it keeps the ranges that are
    still open at the current point, and finds the points of a range by two
    searches. What leaves Python is a block of points and the stretch of it that
    each range holds; Spark unfolds the pairs, a bounded number from each row.
    Null points and ranges without a start meet nothing.

    Pairs come out block by block, so files of many pairs stay small: a range is
    a run of rows, the points of a block come again for each range that holds it,
    and a task has no more points than fit a file's dictionary.

    Points are shuffled once; before, one pass counts them per slot.
    """
    spark = points.sparkSession
    x, low, high = F.col(point).cast("bigint"), F.col(f"{span}.lo").cast("bigint"), F.col(f"{span}.hi").cast("bigint")
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # exact in the extremes, close elsewhere: any cuts give the same pairs
    cuts = ranges.agg(F.percentile_approx(low, [k / slots for k in range(1, slots)] or [0.5])).first()[0]
    bounds = sorted(set(cuts or []))
    counted = points.where(x.isNotNull()).groupBy(_slot(x, bounds).alias("slot")).count().collect()  # a row per slot
    split = [1] * (len(bounds) + 1)
    for r in counted:
        split[r["slot"]] = -(-r["count"] // SLOT_POINTS)
    parts = F.array(*[F.lit(k) for k in split])
    # open ranges gather in the last slots, whose tasks start first
    cells = F.array(*[F.lit(sum(split[k + 1 :])) for k in range(len(split))])

    at = points.where(x.isNotNull()).select(F.struct(*points.columns).alias("p"), x.alias("lo"))
    at = at.withColumn("slot", _slot(F.col("lo"), bounds))
    part = F.pmod(F.xxhash64("p"), F.get(parts, "slot")).cast("int")
    no_range = F.lit(None).cast(ranges.schema).alias("r")
    at = at.select("slot", part.alias("part"), "lo", F.lit(None).cast("bigint").alias("hi"), "p", no_range)
    touched = F.sequence(_slot(F.col("lo"), bounds), F.when(F.col("hi").isNull(), len(bounds)).otherwise(_slot(F.col("hi") - 1, bounds)))
    spread = ranges.where(low.isNotNull() & (high.isNull() | (high > low))).select(F.struct(*ranges.columns).alias("r"), low.alias("lo"), high.alias("hi"))
    spread = spread.withColumn("slot", F.explode(touched)).where(F.get(parts, "slot") > 0)
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts, "slot") - 1)))
    spread = spread.select("slot", "part", "lo", "hi", F.lit(None).cast(at.schema["p"].dataType).alias("p"), "r")

    both = at.unionByName(spread).withColumns({"is_point": F.col("p").isNotNull(), "cell": F.get(cells, "slot") + F.col("part")}).drop("slot", "part")
    dealt = both.repartitionById(sum(split), "cell").sortWithinPartitions("cell", "lo", "is_point")
    met = T.StructType([T.StructField("r", spread.schema["r"].dataType), T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())])
    schema = T.StructType([T.StructField("ps", T.ArrayType(at.schema["p"].dataType)), T.StructField("met", T.ArrayType(met))])
    stretches = dealt.mapInArrow(_sweep, schema).select("ps", F.explode("met").alias("m"))
    pairs = stretches.select("ps", "m.r", F.explode(F.sequence(F.col("m.first"), F.col("m.first") + F.col("m.n") - 1)).alias("k"))
    return pairs.select(F.get("ps", "k").alias("p"), "r").select("p.*", "r.*")


def _one_list(items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of points in order, and ranges with the stretch of them that each holds, from rows in order of cell and place, ranges before points."""
    here: int | None = None
    lows, highs, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # ranges still open
    for batch in batches:
        cell, lo = (batch.column(c).to_numpy() for c in ("cell", "lo"))
        hi = batch.column("hi").fill_null(np.iinfo(np.int64).max).to_numpy()
        is_point = batch.column("is_point").to_numpy(zero_copy_only=False)
        p, r = batch.column("p"), batch.column("r")
        edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))) if len(cell) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if cell[a] != here:
                here = cell[a]
                lows, highs, rows = lows[:0], highs[:0], None
            new, spots = a + np.flatnonzero(~is_point[a:b]), a + np.flatnonzero(is_point[a:b])
            if len(new):
                more = r.take(pa.array(new))
                lows, highs = np.concatenate((lows, lo[new])), np.concatenate((highs, hi[new]))
                rows = more if rows is None else pa.concat_arrays([rows, more])
            if not len(spots) or rows is None:
                continue
            x = lo[spots]
            first, last = np.searchsorted(x, lows, "left"), np.searchsorted(x, highs, "left")
            for left in range(0, len(spots), BLOCK):
                block = _one_list(p.take(pa.array(spots[left : left + BLOCK])))
                start, stop = np.clip(first - left, 0, BLOCK), np.clip(last - left, 0, BLOCK)
                own = np.flatnonzero(stop > start)
                for k in range(0, len(own), PAIRS // BLOCK):
                    some = own[k : k + PAIRS // BLOCK]
                    stretch = [pa.array(start[some].astype(np.int32)), pa.array((stop - start)[some].astype(np.int32))]
                    met = pa.StructArray.from_arrays([rows.take(pa.array(some)), *stretch], ["r", "first", "n"])
                    yield pa.record_batch([block, _one_list(met)], ["ps", "met"])
            still = np.flatnonzero(highs > x[-1])
            if len(still) < len(highs):
                lows, highs, rows = lows[still], highs[still], rows.take(pa.array(still))


def range_overlap_join(a: DataFrame, a_span: str, b: DataFrame, b_span: str) -> DataFrame:
    """Every pair of overlapping ranges once: one of them starts inside the other."""
    low_a, low_b = F.col(f"{a_span}.lo"), F.col(f"{b_span}.lo")
    inside = range_join(a.withColumn("_start", low_a), "_start", b, b_span)
    around = range_join(b.withColumn("_start", low_b), "_start", a, a_span).where(low_b > low_a)
    columns = [*a.columns, *b.columns]
    both = inside.select(*columns).unionByName(around.select(*columns))
    return both.where(overlaps(F.col(a_span), F.col(b_span)))

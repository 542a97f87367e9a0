"""Aggregates, series, cube requests and value display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cube
from ..session import stored
from . import frames
from ._registry import query
from .joins import dbl

TOTALS = {"omrade": "0", "status": "TOT"}


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.fact_cube(spark, sf_dir)


def _day(name: str = "tid_date") -> Column:
    return F.col(name).cast("string").alias("period")


@query(
    "trend_sum",
    "SELECT CAST(tid_date AS VARCHAR) AS period, CAST(SUM(indhold) AS DOUBLE) AS indhold FROM fact_clean GROUP BY tid_date ORDER BY tid_date",
)
def trend_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.fact_clean(spark, sf_dir).groupBy(_day()).agg(dbl(F.sum("indhold"))).orderBy("period")




@query(
    "monthly_revenue",
    """
    SELECT CAST(CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS VARCHAR) AS month, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem GROUP BY 1 ORDER BY 1
    """,
)
def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc(F.to_date("l_shipdate"), "month").cast("string")
    return (
        frames.table(spark, sf_dir, "lineitem")
        .groupBy(month.alias("month"))
        .agg(dbl(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), "revenue"))
        .orderBy("month")
    )


@query(
    "top_products",
    """
    SELECT l_partkey AS product, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS orders
    FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
    """,
)
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        frames.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("product"))
        .agg(dbl(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), "revenue"), F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("revenue"), "product")
        .limit(10)
    )


@query(
    "conditional_share",
    """
    SELECT omrade, tid, ROUND(CAST(SUM(CASE WHEN status = 'F' THEN indhold END) AS DOUBLE) * 100.0 / CAST(SUM(CASE WHEN status = 'TOT' THEN indhold END) AS DOUBLE), 6) AS share
    FROM fact_cube GROUP BY omrade, tid
    """,
)
def conditional_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = cube.conditional_share(_cube(spark, sf_dir), ["omrade", "tid"], "status", "F", "TOT")
    return shares.select("omrade", "tid", F.round("share", 6).alias("share"))


@query(
    "net_change",
    """
    SELECT omrade, tid, CAST(SUM(CASE WHEN status = 'F' THEN indhold ELSE -indhold END) AS DOUBLE) AS net
    FROM fact_clean GROUP BY omrade, tid
    """,
)
def net_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.net_change(frames.fact_clean(spark, sf_dir), ["omrade", "tid"], "status", "F")
    return out.select("omrade", "tid", dbl("net", "net"))


@query(
    "banded_sum",
    """
    SELECT CASE WHEN p_size >= 40 THEN '40+' ELSE ((p_size // 5) * 5) || '-' || ((p_size // 5) * 5 + 4) END AS band,
           CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS indhold FROM part GROUP BY 1
    """,
)
def banded_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = frames.table(spark, sf_dir, "part")
    bands = part.groupBy(cube.band(F.col("p_size"), 5, 40).alias("band"))
    return bands.agg(dbl(F.sum(F.col("p_retailprice").cast("decimal(18,2)"))))


@query(
    "annual_snapshot",
    "SELECT omrade, status, CAST(tid_date AS VARCHAR) AS period, CAST(indhold AS DOUBLE) AS indhold FROM fact_cube WHERE EXTRACT(MONTH FROM tid_date) = 1",
)
def annual_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir).where(F.month("tid_date") == 1).select("omrade", "status", _day(), dbl("indhold"))


@query(
    "code_shape_filter",
    """
    SELECT omrade, status, tid, CAST(indhold AS DOUBLE) AS indhold FROM fact_cube
    WHERE LENGTH(omrade) = 3 AND omrade LIKE '1%' AND omrade NOT LIKE '%5' AND status IN ('F', 'O', 'TOT') AND tid NOT IN ('1998K1', '1999K4')
    """,
)
def code_shape_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = cube.code_shape("omrade", length=3, like="1%", not_like="%5")
    chosen = shaped & cube.code_shape("status", among=("F", "O", "TOT")) & cube.code_shape("tid", not_among=("1998K1", "1999K4"))
    return _cube(spark, sf_dir).where(chosen).select("omrade", "status", "tid", dbl("indhold"))


@query(
    "disambiguate_rows",
    """
    SELECT omrade, status, tid, CAST(MAX(indhold) AS DOUBLE) AS larger, CAST(MIN(indhold) AS DOUBLE) AS smaller, COUNT(*) AS n
    FROM fact_clean GROUP BY omrade, status, tid
    """,
)
def disambiguate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.disambiguate_rows(frames.fact_clean(spark, sf_dir), ["omrade", "status", "tid"])
    return out.select("omrade", "status", "tid", dbl("larger", "larger"), dbl("smaller", "smaller"), "n")


@query("pin_totals", "SELECT tid, CAST(indhold AS DOUBLE) AS indhold FROM fact_cube WHERE omrade = '0' AND status = 'TOT'")
def pin_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.pin_totals(_cube(spark, sf_dir), TOTALS).select("tid", dbl("indhold"))


@query(
    "pin_totals_by_area",
    """
    SELECT 'cube' AS table_id, omrade, tid, CAST(SUM(indhold) AS DOUBLE) AS indhold FROM fact_clean GROUP BY omrade, tid
    UNION ALL SELECT 'supply', omrade, tid, CAST(indhold AS DOUBLE) FROM fact_supply
    """,
)
def pin_totals_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables at once; the second has no in-line totals and stays as it is."""
    columns = ["table_id", "omrade", "status", "tid", "indhold"]
    first = _cube(spark, sf_dir).withColumn("table_id", F.lit("cube")).select(*columns)
    second = frames.fact_supply(spark, sf_dir).withColumns({"table_id": F.lit("supply"), "status": F.lit("all")})
    totals = spark.createDataFrame(
        [("cube", c, t) for c, t in TOTALS.items()] + [("other", c, t) for c, t in TOTALS.items()],
        "table_id string, column_name string, code string",
    )
    out = cube.pin_totals_by_table(first.unionByName(second.select(*columns)), totals, list(TOTALS), ["omrade"])
    return out.select("table_id", "omrade", "tid", dbl("indhold"))


@query("leaves_only", "SELECT omrade, status, tid, CAST(SUM(indhold) AS DOUBLE) AS indhold FROM fact_clean GROUP BY omrade, status, tid")
def leaves_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.leaves_only(_cube(spark, sf_dir), TOTALS).select("omrade", "status", "tid", dbl("indhold"))


@query(
    "additivity_check",
    """
    SELECT omrade, tid, CAST(SUM(indhold) AS DOUBLE) AS stated, CAST(SUM(indhold) AS DOUBLE) AS parts, CAST(0 AS DOUBLE) AS difference
    FROM (SELECT omrade, tid, indhold FROM fact_clean UNION ALL SELECT '0', tid, indhold FROM fact_clean) GROUP BY omrade, tid
    """,
)
def additivity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.additivity_check(_cube(spark, sf_dir), "status", "TOT", ["omrade", "tid"])
    return out.select("omrade", "tid", *[dbl(c, c) for c in ("stated", "parts", "difference")])


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.fact_clean(spark, sf_dir).groupBy("omrade", "tid").agg(F.sum("indhold").alias("indhold"))


@query(
    "latest_with_change",
    """
    SELECT omrade, tid, CAST(indhold AS DOUBLE) AS indhold, CAST(previous AS DOUBLE) AS previous,
           ROUND((CAST(indhold AS DOUBLE) - CAST(previous AS DOUBLE)) / CAST(previous AS DOUBLE), 6) AS change
    FROM (SELECT *, LAG(indhold) OVER (PARTITION BY omrade ORDER BY tid) AS previous, ROW_NUMBER() OVER (PARTITION BY omrade ORDER BY tid DESC) AS rn
          FROM (SELECT omrade, tid, SUM(indhold) AS indhold FROM fact_clean GROUP BY omrade, tid)) WHERE rn = 1
    """,
)
def latest_with_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.latest_with_change(_series(spark, sf_dir), ["omrade"], "tid", "indhold")
    return out.select("omrade", "tid", dbl("indhold"), dbl("previous", "previous"), F.round("change", 6).alias("change"))


@query(
    "indexed_series",
    """
    SELECT omrade, tid, ROUND(CAST(indhold AS DOUBLE) * 100 / CAST(FIRST_VALUE(indhold) OVER (PARTITION BY omrade ORDER BY tid) AS DOUBLE), 6) AS index_value
    FROM (SELECT omrade, tid, SUM(indhold) AS indhold FROM fact_clean GROUP BY omrade, tid)
    """,
)
def indexed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.indexed_series(_series(spark, sf_dir), ["omrade"], "tid", "indhold")
    return out.select("omrade", "tid", F.round("index_value", 6).alias("index_value"))


@query(
    "top_bottom_n",
    """
    SELECT l_suppkey, l_partkey, side, CAST(rank AS INTEGER) AS rank, CAST(indhold AS DOUBLE) AS indhold FROM (
      SELECT *, 'top' AS side, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY indhold DESC, l_partkey) AS rank FROM s
      UNION ALL SELECT *, 'bottom', ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY indhold, l_partkey) FROM s)
    WHERE rank <= 3
    """.replace("FROM s", "FROM (SELECT l_suppkey, l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS indhold FROM lineitem GROUP BY ALL)"),
)
def top_bottom_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = (
        frames.table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("indhold"))
    )
    out = cube.top_bottom_n(sums, ["l_suppkey"], "indhold", "l_partkey", 3)
    return out.select("l_suppkey", "l_partkey", "side", "rank", dbl("indhold"))


@query(
    "category_ratio",
    """
    SELECT omrade, tid, ROUND(CAST(MAX(CASE WHEN status = 'F' THEN indhold END) AS DOUBLE) / CAST(MAX(CASE WHEN status = 'O' THEN indhold END) AS DOUBLE), 6) AS ratio
    FROM fact_cube GROUP BY omrade, tid
    """,
)
def category_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.category_ratio(_cube(spark, sf_dir), ["omrade", "tid"], "status", "F", "O")
    return out.select("omrade", "tid", F.round("ratio", 6).alias("ratio"))


@query(
    "pivot_bands",
    """
    SELECT CASE WHEN p_size >= 40 THEN '40+' ELSE ((p_size // 10) * 10) || '-' || ((p_size // 10) * 10 + 9) END AS band,
      CAST(SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS closed,
      CAST(SUM(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS open
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
    """,
)
def pivot_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = frames.table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", "l_quantity")
    part = frames.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    facts = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        cube.band(F.col("p_size"), 10, 40).alias("band"), "l_linestatus", F.col("l_quantity").cast("decimal(18,2)").alias("indhold")
    )
    out = cube.pivot_bands(facts, "band", "l_linestatus", ["F", "O"])
    return out.select("band", dbl("F", "closed"), dbl("O", "open"))


@query(
    "indicator_correlation",
    """
    SELECT a.tid, ROUND(CORR(CAST(a.v AS DOUBLE), CAST(b.indhold AS DOUBLE)), 6) AS correlation, COUNT(*) AS n
    FROM (SELECT omrade, tid, SUM(indhold) AS v FROM fact_clean GROUP BY omrade, tid) a JOIN fact_supply b ON b.omrade = a.omrade AND b.tid = a.tid
    GROUP BY a.tid
    """,
)
def indicator_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.indicator_correlation(_series(spark, sf_dir), frames.fact_supply(spark, sf_dir), ["omrade"], ["tid"])
    return out.select("tid", F.round("correlation", 6).alias("correlation"), "n")


@query(
    "union_periods",
    """
    SELECT omrade, status, tid, CAST(indhold AS DOUBLE) AS indhold FROM fact_clean
    UNION ALL SELECT omrade, NULL, tid, CAST(indhold AS DOUBLE) FROM fact_supply
    """,
)
def union_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = frames.fact_clean(spark, sf_dir).select("omrade", "status", "tid", "indhold")
    both = cube.union_periods([first, frames.fact_supply(spark, sf_dir)])
    return both.select("omrade", "status", "tid", dbl("indhold"))


@query(
    "select_codes",
    """
    SELECT omrade, status, tid, CAST(indhold AS DOUBLE) AS indhold FROM fact_cube
    WHERE (tid LIKE '%K1' OR (tid >= '1999K2' AND tid < '1999K4') OR tid = '2000K3') AND omrade LIKE '1%2'
    """,
)
def select_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = cube.select_codes(_cube(spark, sf_dir), "tid", ["*K1", ">=1999K2<1999K4", "2000K3"])
    return cube.select_codes(chosen, "omrade", ["1*2"]).select("omrade", "status", "tid", dbl("indhold"))


@query(
    "nth_periods",
    """
    SELECT table_id, pos, tid FROM (SELECT *, COUNT(*) OVER (PARTITION BY table_id) - pos AS k FROM period_lists)
    WHERE k <= 3 OR pos = 0 OR k = 5 OR (pos + 1 >= 2 AND (pos + 1 - 2) % 4 = 0)
    """,
)
def nth_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.nth_periods(frames.period_lists(spark, sf_dir), ["(-n+3)", "-(1)", "(5)", "first(4n+2)"])


@query(
    "code_arithmetic",
    """
    SELECT omrade, tid, status, indhold FROM (
      SELECT omrade, tid, 'F_O' AS status, CAST(SUM(indhold) AS DOUBLE) AS indhold FROM fact_cube WHERE status IN ('F', 'O') GROUP BY omrade, tid
      UNION ALL SELECT omrade, tid, 'F-O', CAST(a AS DOUBLE) - CAST(b AS DOUBLE) FROM p
      UNION ALL SELECT omrade, tid, 'F/O', ROUND(CAST(a AS DOUBLE) / CAST(b AS DOUBLE), 6) FROM p)
    """.replace("FROM p", """FROM (SELECT omrade, tid, SUM(CASE WHEN status = 'F' THEN indhold END) AS a, SUM(CASE WHEN status = 'O' THEN indhold END) AS b
         FROM fact_cube WHERE status IN ('F', 'O') GROUP BY omrade, tid)"""),
)
def code_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _cube(spark, sf_dir)
    made = [
        cube.code_arithmetic(facts, ["omrade", "tid"], "status", op, ["F", "O"], code)
        for op, code in (("sum", "F_O"), ("subtract", "F-O"), ("divide", "F/O"))
    ]
    made[0] = made[0].withColumn("indhold", dbl("indhold"))
    made[2] = made[2].withColumn("indhold", F.round("indhold", 6))
    return cube.union_periods(made)


@query(
    "percent_of_base",
    """
    SELECT omrade, status, tid, content, value FROM (
      SELECT omrade, status, tid, 'count' AS content, CAST(indhold AS DOUBLE) AS value FROM fact_cube
      UNION ALL
      SELECT c.omrade, c.status, c.tid, 'percent', ROUND(CAST(c.indhold AS DOUBLE) * 100 / CAST(b.indhold AS DOUBLE), 6)
      FROM fact_cube c JOIN fact_cube b ON b.omrade = c.omrade AND b.tid = c.tid AND b.status = 'TOT')
    """,
)
def percent_of_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _cube(spark, sf_dir).select("omrade", "status", "tid", "indhold")
    shares = cube.percent_of_base(facts, ["omrade", "tid"], "status", base="TOT")
    rows = cube.add_as_new_value(shares.withColumn("share", F.round("share", 6)), "content", "count", "percent")
    return rows.withColumnRenamed("indhold", "value")


@query(
    "per_mille_of_all",
    """
    SELECT omrade, tid, ROUND(CAST(indhold AS DOUBLE) * 1000 / CAST(SUM(indhold) OVER (PARTITION BY tid) AS DOUBLE), 6) AS share FROM fact_supply
    """,
)
def per_mille_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = cube.percent_of_base(frames.fact_supply(spark, sf_dir), ["tid"], "omrade", per=1000)
    return shares.select("omrade", "tid", F.round("share", 6).alias("share"))


@query(
    "densify_cube",
    """
    SELECT o.omrade, s.status, t.tid, CASE WHEN h.tid IS NOT NULL AND c.indhold IS NULL THEN NULL ELSE COALESCE(CAST(c.indhold AS DOUBLE), 0) END AS indhold
    FROM (SELECT DISTINCT omrade FROM cells) o CROSS JOIN (SELECT DISTINCT status FROM cells) s CROSS JOIN (SELECT DISTINCT tid FROM cells) t
    LEFT JOIN cells c ON c.omrade = o.omrade AND c.status = s.status AND c.tid = t.tid
    LEFT JOIN (SELECT DISTINCT omrade, status, tid FROM fact_raw WHERE indhold = '..') h ON h.omrade = o.omrade AND h.status = s.status AND h.tid = t.tid
    """.replace("FROM cells", "FROM (SELECT omrade, status, tid, SUM(indhold) AS indhold FROM fact_clean GROUP BY omrade, status, tid)").replace(
        "JOIN cells", "JOIN (SELECT omrade, status, tid, SUM(indhold) AS indhold FROM fact_clean GROUP BY omrade, status, tid)"
    ),
)
def densify_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["omrade", "status", "tid"]
    cells = stored(frames.fact_clean(spark, sf_dir).groupBy(*keys).agg(dbl(F.sum("indhold"))), "cells")
    withheld = frames.fact_raw(spark, sf_dir).where(F.col("indhold") == "..")
    return cube.densify_cube(cells, keys, withheld)


@query(
    "cell_estimate",
    """
    SELECT table_id, rows, fields, rows * fields AS cells, rows * fields <= 1000000 AS allowed FROM (
      SELECT table_id, CAST(PRODUCT(n) AS BIGINT) AS rows, COUNT(*) + 1 AS fields FROM (SELECT table_id, variable, COUNT(DISTINCT id) AS n FROM meta_values GROUP BY ALL)
      GROUP BY table_id)
    """,
)
def cell_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    variables = frames.metadata(spark, sf_dir).select("table_id", F.explode("variables").alias("v"))
    selected = variables.select("table_id", F.col("v.id").alias("column_name"), F.explode("v.values.id").alias("code"))
    return cube.cell_estimate(selected)


@query(
    "format_value",
    """
    SELECT omrade, status, tid, printf(pattern, CAST(indhold AS DOUBLE) / scale) || suffix AS number, printf(pattern, CAST(indhold AS DOUBLE) / scale) || suffix || ' kr.' AS money,
           CASE WHEN change >= 0 THEN '↑ +' ELSE '↓ ' END || printf('%.1f%%', change * 100) AS change
    FROM (SELECT *, '%.1f' AS pattern, CASE WHEN indhold >= 1000000000 THEN 1e9 WHEN indhold >= 1000000 THEN 1e6 ELSE 1e3 END AS scale,
            CASE WHEN indhold >= 1000000000 THEN 'B' WHEN indhold >= 1000000 THEN 'M' ELSE 'K' END AS suffix,
            (CAST(indhold AS DOUBLE) - 3000000.5) / 3000000.5 AS change FROM fact_cube WHERE indhold >= 1000)
    UNION ALL
    SELECT omrade, status, tid, printf('%.0f', CAST(indhold AS DOUBLE)), printf('%.0f', CAST(indhold AS DOUBLE)) || ' kr.', '↓ ' || printf('%.1f%%', (CAST(indhold AS DOUBLE) - 3000000.5) / 3000000.5 * 100)
    FROM fact_cube WHERE indhold < 1000
    """,
)
def format_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("indhold").cast("double")
    return _cube(spark, sf_dir).select(
        "omrade",
        "status",
        "tid",
        text.format_value(value, F.lit("number")).alias("number"),
        text.format_value(value, F.lit("currency")).alias("money"),
        text.change_text((value - 3000000.5) / 3000000.5).alias("change"),
    )


@query(
    "value_list_text",
    """
    SELECT table_id, variable, COUNT(*) AS n,
      CASE WHEN COUNT(*) <= 10 THEN STRING_AGG(id, ', ' ORDER BY pos)
           ELSE STRING_AGG(id, ', ' ORDER BY pos) FILTER (WHERE pos < 5) || ' ... ' || STRING_AGG(id, ', ' ORDER BY pos) FILTER (WHERE pos >= size - 5) END AS ids,
      CASE WHEN COUNT(*) <= 20 THEN STRING_AGG(id || '=' || label, ', ' ORDER BY pos)
           ELSE STRING_AGG(id || '=' || label, ', ' ORDER BY pos) FILTER (WHERE pos < 5) || ' ... ' || STRING_AGG(id || '=' || label, ', ' ORDER BY pos) FILTER (WHERE pos >= size - 5) END AS pairs
    FROM (SELECT *, COUNT(*) OVER (PARTITION BY table_id, variable) AS size FROM meta_values) GROUP BY table_id, variable
    """,
)
def value_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    variables = frames.metadata(spark, sf_dir).select("table_id", F.explode("variables").alias("v"))
    pairs = F.transform("v.values", lambda x: F.concat(x["id"], F.lit("="), x["text"]))
    return variables.select(
        "table_id",
        F.col("v.id").alias("variable"),
        F.size("v.values").cast("bigint").alias("n"),
        text.value_list_text(F.col("v.values.id")).alias("ids"),
        text.value_list_text(pairs, most=20).alias("pairs"),
    )

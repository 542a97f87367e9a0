"""Free SQL and parameterised query sets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queryset as qsets
from ..session import scratch_path, stored
from . import frames
from ._registry import query
from .views import view

view("shipments", """
SELECT CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS month, l_returnflag AS flag, l_linestatus AS status, CAST(SUM(l_quantity) AS BIGINT) AS units, COUNT(*) AS lines
FROM lineitem GROUP BY 1, 2, 3
""")

FLAGS = "SELECT DISTINCT flag, 'Flag ' || flag AS label FROM shipments"
BY_MONTH = """
SELECT month, SUM(units) AS units, SUM(lines) AS lines FROM shipments
WHERE month BETWEEN COALESCE(:month_from, month) AND COALESCE(:month_to, month) AND flag = COALESCE(:flag, flag)
GROUP BY month
"""
BY_FLAG = """
SELECT flag, SUM(lines) AS lines, MAX(units)::double AS most FROM shipments
WHERE status = CASE WHEN :open_only THEN 'O' ELSE status END AND flag <> COALESCE(:left_out, '')
GROUP BY flag
"""


def units_shipped(by_month: DataFrame) -> qsets.Metric:
    """All units, and how far the last month is above the first."""
    ends = by_month.agg(
        F.sum("units").alias("all"), F.min_by("units", "month").alias("first"), F.max_by("units", "month").alias("last")
    )
    return qsets.metric(
        ends.withColumn("growth", F.round(F.col("last") / F.col("first") - 1, 6)), "all", "Units shipped",
        change="growth", change_label="last month against the first",
    )


def busiest_month(by_month: DataFrame) -> qsets.Metric:
    busiest = by_month.agg(F.date_format(F.max_by("month", F.struct("lines", "month")), "yyyy-MM").alias("month"))
    return qsets.metric(busiest, "month", "Busiest month", format="text")


def shipment_set(spark: SparkSession, sf_dir: str) -> qsets.QuerySet:
    """Shipped units and order lines by month, return flag and line status."""
    cells = frames.table(spark, sf_dir, "lineitem").groupBy(
        F.trunc("l_shipdate", "month").alias("month"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")
    )
    return qsets.QuerySet(
        name="shipments",
        tables={"shipments": cells.agg(F.sum("l_quantity").cast("bigint").alias("units"), F.count(F.lit(1)).alias("lines"))},
        queries={"flags": FLAGS, "by_month": BY_MONTH, "by_flag": BY_FLAG},
        outputs={
            "units_shipped": qsets.Output(("by_month",), units_shipped),
            "busiest_month": qsets.Output(("by_month",), busiest_month),
            "flag_table": qsets.Output(("by_flag",), lambda by_flag: by_flag),
        },
        parameters=(*qsets.choice("flag", options="flags"), *qsets.day_range("month"), *qsets.flag("open_only")),
    )


GIVEN = {"flag": "R", "month_from": "1996-01-01"}
_KEY = "flag=R&month_from=1996-01-01"
_MONTHS_SQL = "SELECT month, SUM(units) AS units, SUM(lines) AS lines FROM shipments WHERE flag = 'R' AND month >= DATE '1996-01-01' GROUP BY month"
_FLAGS_SQL = "SELECT flag, CAST(SUM(lines) AS BIGINT) AS lines, CAST(MAX(units) AS DOUBLE) AS most FROM shipments GROUP BY flag"


@query(
    "sql_passthrough",
    """
    SELECT d.titel || ' ' || f.tid AS label, CAST(f.indhold AS DOUBLE) AS indhold, COALESCE(d.parent_kode, 0) AS parent_kode
    FROM fact_cube f JOIN dim_geo d ON f.omrade = d.kode::VARCHAR
    WHERE f.status IN ('F', 'O') AND f.tid BETWEEN '1998K1' AND '1999K4' AND d.titel LIKE 'NATION_1%'
    """,
)
def sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """
    SELECT d.titel || ' ' || f.tid AS label, CAST(f.indhold AS DOUBLE) AS indhold, COALESCE(d.parent_kode, 0) AS parent_kode
    FROM fact_cube f JOIN dim_geo d ON f.omrade = d.kode::string
    WHERE f.status IN ('F', 'O') AND f.tid BETWEEN '1998K1' AND '1999K4' AND d.titel LIKE 'NATION_1%'
    """
    tables = {"fact_cube": frames.fact_cube(spark, sf_dir), "dim_geo": frames.dim_geo(spark, sf_dir)}
    return qsets.run_sql(spark, text, tables)


@query("param_query", f"SELECT CAST(month AS TIMESTAMP) AS month, CAST(units AS BIGINT) AS units, CAST(lines AS BIGINT) AS lines FROM ({_MONTHS_SQL})")
def param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = shipment_set(spark, sf_dir)
    return qsets.run_query(spark, qs, "by_month", qs.filter_values(GIVEN))


@query("param_query_unfiltered", _FLAGS_SQL)
def param_query_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults only; ``left_out`` is named in the text but is no parameter of the set, and binds null."""
    qs = shipment_set(spark, sf_dir)
    return qsets.run_query(spark, qs, "by_flag", qs.filter_values({}))


@query("option_list", "SELECT DISTINCT flag AS value, 'Flag ' || flag AS label FROM shipments")
def option_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qsets.option_list(qsets.run_query(spark, shipment_set(spark, sf_dir), "flags", {}))


@query("output_table", _FLAGS_SQL.replace("FROM shipments", "FROM shipments WHERE status = 'O'"))
def output_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = shipment_set(spark, sf_dir)
    return qsets.run_output(spark, qs, "flag_table", qs.filter_values({"open_only": "true"}))


@query(
    "output_metric",
    f"""
    SELECT CAST(SUM(units) AS BIGINT) AS value, 'Units shipped' AS label, 'number' AS format,
           ROUND(ARG_MAX(units, month) / ARG_MIN(units, month) - 1, 6) AS change, 'last month against the first' AS change_label
    FROM ({_MONTHS_SQL})
    """,
)
def output_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = shipment_set(spark, sf_dir)
    return qsets.run_output(spark, qs, "units_shipped", qs.filter_values(GIVEN)).frame


@query(
    "validate_set",
    """
    SELECT 'query' AS kind, 'by_flag' AS name, COUNT(DISTINCT flag) AS rows, 'ok' AS status, CAST(NULL AS VARCHAR) AS message FROM shipments
    UNION ALL SELECT 'query', 'by_month', COUNT(*), 'warning', 'query by_month came out empty' FROM shipments WHERE flag = 'Nowhere'
    UNION ALL SELECT 'query', 'flags', COUNT(DISTINCT flag), 'ok', NULL FROM shipments
    UNION ALL SELECT 'metric', 'busiest_month', NULL, 'warning', 'metric busiest_month came out empty'
    UNION ALL SELECT 'table', 'flag_table', NULL, 'ok', NULL
    UNION ALL SELECT 'metric', 'units_shipped', NULL, 'warning', 'metric units_shipped came out empty'
    """,
)
def validate_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qsets.validate_set(spark, shipment_set(spark, sf_dir), {"flag": "Nowhere"})


@query(
    "invalid_filter_values",
    """
    SELECT 'nation' AS filter_name, c_mktsegment AS value,
           (SELECT STRING_AGG(n_name, ', ' ORDER BY n_nationkey DESC) FROM (SELECT * FROM nation ORDER BY n_nationkey DESC LIMIT 5)) AS sample_allowed_values
    FROM (SELECT DISTINCT c_mktsegment FROM customer)
    UNION ALL
    SELECT 'segment', n_name, (SELECT STRING_AGG(s, ', ' ORDER BY k) FROM (SELECT c_mktsegment AS s, MIN(c_custkey) AS k FROM customer GROUP BY 1 ORDER BY k LIMIT 5)) FROM nation
    """,
)
def invalid_filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation and every market segment chosen in both filters; each offers only its own, in its own order."""
    nation, segment = F.lit("nation").alias("filter_name"), F.lit("segment").alias("filter_name")
    customer = frames.table(spark, sf_dir, "customer")
    segments = customer.groupBy(F.col("c_mktsegment").alias("value")).agg(F.min("c_custkey").alias("pos"))
    nations = frames.table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), (-F.col("n_nationkey")).alias("pos"))
    options = stored(nations.select(nation, "pos", "value").unionByName(segments.select(segment, "pos", "value")), "options")
    values = segments.select("value").unionByName(nations.select("value"))
    chosen = values.select(nation, "value").unionByName(values.select(segment, "value"))
    return qsets.invalid_filter_values(options, chosen.withColumn("default", F.lit("all")))


@query("snapshot_tables", f"SELECT k AS filter_key, flag, lines FROM ({_FLAGS_SQL}), (SELECT UNNEST(['{_KEY}', '_']) AS k)")
def snapshot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "snapshot")
    qs = shipment_set(spark, sf_dir)
    for given in (GIVEN, {}):
        qsets.snapshot(spark, qs, given, folder)
    return spark.read.parquet(f"{folder}/tables/flag_table").select("filter_key", "flag", "lines")


@query(
    "snapshot_metrics",
    f"""
    SELECT '{_KEY}' AS filter_key, 'units_shipped' AS name, CAST(SUM(units) AS VARCHAR) AS value, 'Units shipped' AS label FROM ({_MONTHS_SQL})
    UNION ALL SELECT '{_KEY}', 'busiest_month', STRFTIME(ARG_MAX(month, (lines, month)), '%Y-%m'), 'Busiest month' FROM ({_MONTHS_SQL})
    """,
)
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "snapshot")
    qsets.snapshot(spark, shipment_set(spark, sf_dir), GIVEN, folder)
    return spark.read.parquet(f"{folder}/metrics").select("filter_key", "name", "value", "label")


@query("snapshot_replaced", "SELECT '_' AS filter_key, flag, CAST(SUM(lines) AS BIGINT) AS lines FROM shipments GROUP BY flag")
def snapshot_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of one key, the second with an output that has become empty; another key is left alone."""
    folder = scratch_path(spark, "snapshot")
    qs = shipment_set(spark, sf_dir)
    nothing = replace(qs, outputs={"flag_table": qsets.Output(("by_flag",), lambda by_flag: by_flag.where("flag IS NULL"))})
    for given, made in (({}, qs), (GIVEN, qs), (GIVEN, nothing)):
        qsets.snapshot(spark, made, given, folder)
    return spark.read.parquet(f"{folder}/tables/flag_table").select("filter_key", "flag", "lines")

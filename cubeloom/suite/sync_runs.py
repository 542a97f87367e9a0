"""The sync run over one table per market segment and order priority.

Segment M is unchanged, A holds no periods yet, the rest all but the latest one.
``F5`` is described without periods, the measure of ``B2`` can't be read, ``H1``
counts as weekly, and the last three tables of the catalog are beyond the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sync
from ..session import scratch_path, stored
from ..sources import layout, sync_run
from . import frames
from ._registry import query

MAX_TABLES, MAX_ROWS = 22, 500


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """Outcomes, next state and the folder of the period files."""
    rows = frames.segment_rows(spark, sf_dir)
    tables = stored(rows.groupBy("table_id").agg(F.max("day").cast("string").alias("updated")), "tables")
    quarters = stored(rows.select("table_id", "tid").distinct(), "quarters")
    segment = F.substring("table_id", 1, 1)

    # one row per table
    catalog = tables.withColumn("pos", F.row_number().over(Window.orderBy("table_id")))
    state = tables.where(segment.isin("M", "H")).select(
        "table_id", F.when(segment == "M", F.col("updated")).otherwise("earlier").alias("updated"), F.lit("quarterly").alias("frequency")
    )
    codes = F.when(F.col("table_id") == "F5", F.array().cast("array<string>")).otherwise(F.sort_array(F.collect_list("tid")))
    described = quarters.groupBy("table_id").agg(codes.alias("codes")).select(
        "table_id", F.array(F.struct(F.lit("TID").alias("id"), F.transform("codes", lambda c: F.struct(c.alias("id"), c.alias("text"))).alias("values"))).alias("variables")
    )
    overrides = spark.createDataFrame([("H1", "weekly")], "table_id string, frequency string")

    root = scratch_path(spark, "synced")
    latest = quarters.groupBy("table_id").agg(F.max("tid").alias("tid"))
    held = rows.where(segment != "A").drop("day").join(latest, ["table_id", "tid"], "left_anti")
    layout.write_periods(held, root, version=1)

    def fetch(batches: DataFrame) -> DataFrame:
        return rows.drop("day").join(batches.select("table_id", "tid"), ["table_id", "tid"], "left_semi")

    outcomes, after = sync_run.run(
        spark, catalog, state, described, overrides, root, fetch, max_tables=MAX_TABLES, max_rows=MAX_ROWS, version=2
    )
    return outcomes, after, root


@query("sync_run", "SELECT table_id, updated, status, reason, frequency, periods_fetched, rows_written, files_written, bootstrap FROM segment_outcomes")
def sync_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0]


@query(
    "sync_run_report",
    """
    SELECT COUNT(*) AS tables_total, COUNT(*) FILTER (WHERE status = 'synced') AS tables_synced,
           COUNT(*) FILTER (WHERE status = 'skipped') AS tables_skipped, COUNT(*) FILTER (WHERE status = 'failed') AS tables_failed
    FROM segment_outcomes
    """,
)
def sync_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_report(_run(spark, sf_dir)[0])


@query(
    "sync_run_state",
    """
    SELECT table_id, updated, frequency FROM segment_outcomes WHERE status = 'synced'
    UNION ALL SELECT table_id, CASE WHEN table_id[1] = 'M' THEN CAST(MAX(day) AS VARCHAR) ELSE 'earlier' END, 'quarterly' FROM segment_rows
    WHERE table_id[1] IN ('M', 'H') AND table_id NOT IN (SELECT table_id FROM segment_outcomes WHERE status = 'synced') GROUP BY table_id
    """,
)
def sync_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1]


@query(
    "sync_run_files",
    """
    SELECT r.table_id, r.status, r.tid, r.indhold FROM segment_rows r JOIN segment_quarters q ON q.table_id = r.table_id AND q.tid = r.tid
    WHERE (r.table_id[1] <> 'A' AND q.rk > 1) OR r.table_id IN (SELECT table_id FROM segment_outcomes WHERE status = 'synced')
    """,
)
def sync_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see afterwards: failed tables are as before."""
    return layout.read_periods(spark, _run(spark, sf_dir)[2]).select("table_id", "status", "tid", "indhold")

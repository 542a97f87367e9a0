"""Sources, sinks and the period layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean
from ..sources import files, layout, tables
from ..session import scratch_path, stored
from ..streaming.period_feed import replace_periods, stream_files
from . import frames
from ._registry import query
from .cleaning import dims_clean
from .joins import dbl

_ROW = ["table_id", "omrade", "status", "tid", "indhold"]


def _written(spark: SparkSession, sf_dir: str) -> str:
    """All fact tables in the period layout, with one requested quarter that has no rows."""
    root = scratch_path(spark, "periods")
    facts = frames.fact_tables(spark, sf_dir)
    asked = frames.table_quarters(spark, sf_dir).select("table_id", "tid")
    empty = asked.select("table_id", F.lit("1901:1903/4").alias("tid")).distinct()
    layout.write_periods(facts, root, requested=asked.unionByName(empty), version=1)
    return root


@query(
    "write_periods",
    "SELECT table_id, tid, COUNT(*) AS rows FROM fact_tables GROUP BY table_id, tid UNION ALL SELECT DISTINCT table_id, '1901:1903/4', 0 FROM fact_tables",
)
def write_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.manifest(spark, _written(spark, sf_dir))


@query("write_report", "SELECT COUNT(*) AS rows_written, COUNT(DISTINCT (table_id, tid)) + COUNT(DISTINCT table_id) AS files_written FROM fact_tables")
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.write_report(layout.manifest(spark, _written(spark, sf_dir)))


@query("read_periods", "SELECT table_id, omrade, status, tid, indhold FROM fact_tables")
def read_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.read_periods(spark, _written(spark, sf_dir)).select(*_ROW)


@query(
    "scan_periods",
    "SELECT f.table_id, omrade, status, f.tid, indhold FROM fact_tables f JOIN table_quarters q ON q.table_id = f.table_id AND q.tid = f.tid WHERE q.rk IN (1, 3)",
)
def scan_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = frames.table_quarters(spark, sf_dir).where(F.col("rk").isin(1, 3)).select("table_id", "tid")
    wanted = wanted.unionByName(wanted.select("table_id", F.lit("2099K1").alias("tid")).distinct())
    return layout.load_periods(spark, _written(spark, sf_dir), wanted)[0].select(*_ROW)


@query("scan_periods_missing", "SELECT DISTINCT table_id, '2099K1' AS tid FROM fact_tables")
def scan_periods_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = frames.table_quarters(spark, sf_dir).select("table_id", "tid")
    wanted = wanted.unionByName(wanted.select("table_id", F.lit("2099K1").alias("tid")).distinct())
    return layout.load_periods(spark, _written(spark, sf_dir), wanted)[1]


@query("scan_columns", "SELECT l_returnflag AS code, COUNT(*) AS n FROM lineitem GROUP BY 1")
def scan_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = frames.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("code"))
    return column.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_bulk_csv",
    """
    SELECT omrade AS "OMRÅDE", status AS "STATUS", tid AS "TID", CASE WHEN indhold <> '..' THEN CAST(REPLACE(indhold, ',', '.') AS DOUBLE) END AS "INDHOLD" FROM fact_raw
    """,
)
def read_bulk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bulk")
    names = ["OMRÅDE", "STATUS", "TID", "INDHOLD"]
    frames.fact_raw(spark, sf_dir).toDF(*names).write.csv(path, sep=";", header=True)
    return files.read_bulk_csv(spark, path, names, decimals=("INDHOLD",))


def _mixed_bulk(spark: SparkSession, sf_dir: str) -> str:
    """Bulk files of one cube: one column order per order state, and a unit in the measures of state P."""
    path, raw = scratch_path(spark, "mixed-bulk"), frames.fact_raw(spark, sf_dir)
    orders = {"F": ["omrade", "status", "tid", "indhold"], "O": ["tid", "indhold", "note", "omrade", "status"], "P": ["indhold", "omrade", "tid", "status"]}
    for state, names in orders.items():
        rows = raw.where(F.col("status") == state).withColumn("note", F.lit("a;b"))
        unit = F.when(F.col("indhold") == "..", F.col("indhold")).otherwise(F.concat("indhold", F.lit(" kr")))
        rows = rows.withColumn("indhold", unit) if state == "P" else rows
        rows.select(*[F.col(c).alias(c.upper()) for c in names]).write.mode("append").csv(path, sep=";", header=True)
    return path


_BULK = ["omrade", "status", "tid", "indhold"]


@query(
    "read_bulk_mixed",
    """
    SELECT omrade, status, tid, CASE WHEN indhold <> '..' THEN CAST(REPLACE(indhold, ',', '.') AS DOUBLE) END AS indhold FROM fact_raw
    WHERE status <> 'P' OR indhold = '..'
    """,
)
def read_bulk_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_bulk(spark, _mixed_bulk(spark, sf_dir), _BULK, ("indhold",))[0]


@query(
    "read_bulk_rejects",
    """
    SELECT indhold || ' kr;' || omrade || ';' || tid || ';P' AS line, 'not a measure: ' || indhold || ' kr' AS reason FROM fact_raw
    WHERE status = 'P' AND indhold <> '..'
    """,
)
def read_bulk_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_bulk(spark, _mixed_bulk(spark, sf_dir), _BULK, ("indhold",))[1].select("line", "reason")


@query(
    "period_manifest",
    """
    SELECT q.table_id, q.tid, CAST(COUNT(s.tid) AS BIGINT) AS rows FROM (SELECT DISTINCT table_id, tid FROM fact_tables) q
    LEFT JOIN stored_facts s ON s.table_id = q.table_id AND s.tid = q.tid GROUP BY q.table_id, q.tid
    """,
)
def period_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import loaded_facts

    quarters = stored(frames.table_quarters(spark, sf_dir), "quarters")
    counts = loaded_facts(spark, sf_dir, quarters).groupBy("table_id", "tid").agg(F.count(F.lit(1)).alias("rows"))
    return layout.period_manifest(counts, quarters)


@query("local_periods", "SELECT DISTINCT table_id, tid FROM disk_manifest ORDER BY table_id, tid")
def local_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.local_periods(frames.disk_manifest(frames.table_quarters(spark, sf_dir)))


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old files: two sources per table that share periods."""
    facts = frames.fact_tables(spark, sf_dir)
    source = F.concat(F.lit("partition_"), F.when(F.col("status") == "P", "2").otherwise("1"), F.lit(".parquet"))
    return facts.withColumn("source", source)


@query(
    "migrate_layout",
    """
    SELECT table_id, source, CAST(SUM(n) AS BIGINT) AS rows_total, COUNT(*) AS tids_total, COUNT(*) FILTER (WHERE NOT present) AS files_written,
           COUNT(*) FILTER (WHERE present) AS files_skipped_existing
    FROM (SELECT table_id, source, n, rk > 20 OR source > MIN(source) OVER (PARTITION BY table_id, tid) AS present FROM (
          SELECT f.table_id, 'partition_' || CASE WHEN status = 'P' THEN '2' ELSE '1' END || '.parquet' AS source, f.tid, COUNT(*) AS n, q.rk
          FROM fact_tables f JOIN table_quarters q ON q.table_id = f.table_id AND q.tid = f.tid GROUP BY ALL))
    GROUP BY table_id, source
    """,
)
def migrate_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "migrated")
    old = frames.table_quarters(spark, sf_dir).where(F.col("rk") > 20).select("table_id", "tid")
    layout.write_periods(frames.fact_tables(spark, sf_dir).join(old, ["table_id", "tid"], "left_semi"), root, version=1)
    return layout.migrate_layout(_legacy(spark, sf_dir), root)


@query(
    "pending_tables",
    "SELECT DISTINCT LOWER(table_id) AS table_id FROM fact_tables WHERE table_id NOT IN (SELECT table_id FROM stored_facts)",
)
def pending_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import loaded_facts

    quarters = stored(frames.table_quarters(spark, sf_dir), "quarters")
    return tables.pending_tables(frames.fact_tables(spark, sf_dir), loaded_facts(spark, sf_dir, quarters))


@query(
    "load_fact",
    """
    SELECT CAST(omrade AS VARCHAR) AS omrade, status, CAST(SUBSTR(omrade, 2) AS SMALLINT) AS alder, tid_date AS tid, CAST(indhold AS DOUBLE) AS indhold FROM fact_clean
    """,
)
def load_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = frames.fact_raw(spark, sf_dir).withColumn("ALDER", F.substring("omrade", 2, 2))
    return tables.load_fact(tables.fact_columns(clean.process_fact(raw, keys=[])), scratch_path(spark, "fact"))


@query(
    "load_fact_ranges",
    """
    SELECT status, CAST(EXTRACT(YEAR FROM tid_date) AS INTEGER) AS tid_lo, CAST(EXTRACT(YEAR FROM tid_date) + 2 AS INTEGER) AS tid_hi,
           CAST(CAST(SUBSTR(omrade, 2) AS INTEGER) * 5 AS INTEGER) AS alder_lo, CAST(CAST(SUBSTR(omrade, 2) AS INTEGER) * 5 + 5 AS INTEGER) AS alder_hi,
           CAST(indhold AS DOUBLE) AS indhold FROM fact_clean
    """,
)
def load_fact_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-year periods and five-year ages: both load as ranges."""
    low, year = F.substring("omrade", 2, 2).cast("int") * 5, F.substring("TID", 1, 4).cast("int")
    raw = frames.fact_raw(spark, sf_dir).withColumns(
        {"ALDER": F.concat_ws("-", low, low + 4), "TID": F.concat_ws(":", year, year + 1)}
    )
    loaded = tables.load_fact(tables.fact_columns(clean.process_fact(raw, keys=[])), scratch_path(spark, "fact"))
    ends = [F.col(c)[e].alias(f"{c}_{e}") for c in ("tid", "alder") for e in ("lo", "hi")]
    return loaded.select("status", *ends, "indhold")


@query(
    "load_fact_text",
    """
    SELECT omrade, status, 'after ' || EXTRACT(YEAR FROM tid_date) AS tid, 'group ' || SUBSTR(omrade, 2) AS alder, CAST(indhold AS DOUBLE) AS indhold FROM fact_clean
    """,
)
def load_fact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and ages that are neither dates nor numbers stay text."""
    raw = frames.fact_raw(spark, sf_dir).withColumns(
        {"ALDER": F.concat(F.lit("group "), F.substring("omrade", 2, 2)), "TID": F.concat(F.lit("after "), F.substring("TID", 1, 4))}
    )
    return tables.load_fact(tables.fact_columns(clean.process_fact(raw, keys=[])), scratch_path(spark, "fact"))


@query(
    "load_dim",
    "SELECT CAST(kode AS BIGINT) AS kode, CAST(niveau AS SMALLINT) AS niveau, titel, CAST(parent_kode AS BIGINT) AS parent_kode FROM dims_clean WHERE dim_id = 'kn'",
)
def load_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = dims_clean(spark, sf_dir, "kn")
    number = {"kode": F.col("kode").cast("bigint"), "parent_kode": F.col("parent_kode").cast("bigint")}
    return tables.load_dim(tree.withColumns(number), scratch_path(spark, "dim"))


@query("dim_values", "SELECT DISTINCT dim_id, kode, niveau, titel, parent_kode FROM dims_clean")
def dim_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.catalog import dim_values as values

    return values(dims_clean(spark, sf_dir))


@query(
    "stream_periods",
    """
    SELECT o_orderstatus AS table_id, CAST(EXTRACT(YEAR FROM o_orderdate) AS VARCHAR) AS tid, COUNT(*) AS rows, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS indhold
    FROM orders GROUP BY 1, 2
    """,
)
def stream_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order file as a stream whose periods are replaced as they arrive."""
    root = scratch_path(spark, "feed")
    orders = stream_files(spark, sf_dir, frames.table(spark, sf_dir, "orders"), "orders.parquet")
    rows = orders.select(
        F.col("o_orderstatus").alias("table_id"), F.year("o_orderdate").cast("string").alias("tid"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("indhold"),
    )
    replace_periods(rows, root, scratch_path(spark, "feed-ckpt")).awaitTermination()
    current = layout.read_periods(spark, root)
    return current.groupBy("table_id", "tid").agg(F.count(F.lit(1)).alias("rows"), dbl(F.sum("indhold")))

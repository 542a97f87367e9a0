"""Period semantics and incremental sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import int_range, range_text
from ..operators import delta, sync
from ..operators.clean import clean_measure
from ..session import scratch_path, stored
from ..sources import delta_files, layout
from . import frames
from ._registry import query


@query("infer_frequency", "SELECT table_id, sample, frequency FROM frequency_of")
def infer_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.infer_frequency(frames.period_lists_open(spark, sf_dir))


@query(
    "resolve_frequency",
    """
    SELECT f.table_id, COALESCE(o.frequency, f.frequency) AS frequency, o.frequency IS NOT NULL AS overridden
    FROM frequency_of f LEFT JOIN (SELECT * FROM frequency_overrides WHERE frequency IN
      ('daily','weekly','monthly','quarterly','half_yearly','yearly','other')) o ON o.table_id = f.table_id
    """,
)
def resolve_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.resolve_frequency(frames.period_lists_open(spark, sf_dir), frames.frequency_overrides(spark, sf_dir))


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = stored(frames.period_lists(spark, sf_dir), "lists")
    frequencies = sync.resolve_frequency(lists, frames.frequency_overrides(spark, sf_dir))
    return sync.pick_periods(lists, frames.local_periods_held(spark, sf_dir), frequencies)


@query("pick_periods", "SELECT table_id, pos, tid, reason FROM picked_periods")
def pick_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _picked(spark, sf_dir)


@query(
    "estimate_rows",
    """
    SELECT table_id, MAX(CASE WHEN variable = 'Tid' THEN n END) AS n_periods,
           GREATEST(1, CAST(CEIL(PRODUCT(n) / MAX(CASE WHEN variable = 'Tid' THEN n END)) AS BIGINT)) AS rows_per_period
    FROM (SELECT table_id, variable, COUNT(*) AS n FROM meta_values GROUP BY table_id, variable) GROUP BY table_id
    """,
)
def estimate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.estimate_rows(frames.metadata(spark, sf_dir))


@query(
    "period_batches",
    """
    SELECT p.table_id, pos, tid,
           CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY p.table_id ORDER BY pos) - 1) /
                GREATEST(1, FLOOR(2000 / rows_per_period))) AS BIGINT) AS batch
    FROM picked_periods p
    JOIN (SELECT table_id, GREATEST(1, COUNT(*) * 7) AS rows_per_period FROM period_lists GROUP BY table_id) e ON e.table_id = p.table_id
    """,
)
def period_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimates = (
        frames.period_lists(spark, sf_dir)
        .groupBy("table_id")
        .agg(F.greatest(F.lit(1), F.count(F.lit(1)) * 7).alias("rows_per_period"))
    )
    return sync.period_batches(stored(_picked(spark, sf_dir), "picked"), estimates, max_rows=2000)


@query("metadata_periods", "SELECT table_id, pos, id AS tid FROM meta_values WHERE variable = 'Tid'")
def metadata_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.metadata_periods(frames.metadata(spark, sf_dir))


@query("metadata_problems", "SELECT table_id, 'no period values' AS message FROM (SELECT DISTINCT table_id FROM period_lists_open WHERE tid = '')")
def metadata_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that end in an empty code stand for descriptions without periods."""
    lists = frames.period_lists_open(spark, sf_dir)
    whole = lists.groupBy("table_id").agg(F.sort_array(F.collect_list("tid")).alias("codes"), F.max(F.col("tid") == "").alias("open"))
    codes = F.when(F.col("open"), F.array().cast("array<string>")).otherwise(F.col("codes"))
    meta = whole.select("table_id", F.array(F.struct(F.lit("Tid").alias("id"), codes.alias("values"))).alias("variables"))
    return sync.metadata_problems(meta)


@query(
    "changed_tables",
    """
    SELECT c.table_id, c.updated, s.updated AS previous FROM table_catalog c LEFT JOIN table_state s ON s.table_id = c.table_id
    WHERE c.updated IS DISTINCT FROM s.updated
    """,
)
def changed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.changed_tables(frames.table_catalog(spark, sf_dir), frames.table_state(spark, sf_dir))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = frames.table_catalog(spark, sf_dir)
    changed = sync.changed_tables(catalog, frames.table_state(spark, sf_dir)).select("table_id", F.lit(True).alias("_c"))
    status = (
        F.when(F.col("_c").isNull(), "skipped")
        .when(F.col("c_acctbal") < 0, "failed")
        .otherwise("synced")
    )
    owner = frames.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("table_id"), "c_acctbal"
    )
    return catalog.join(changed, "table_id", "left").join(owner, "table_id").select(
        "table_id", "updated", F.lit("monthly").alias("frequency"), status.alias("status")
    )


@query(
    "sync_report",
    """
    SELECT COUNT(*) AS tables_total, COUNT(*) FILTER (WHERE status = 'synced') AS tables_synced,
           COUNT(*) FILTER (WHERE status = 'skipped') AS tables_skipped, COUNT(*) FILTER (WHERE status = 'failed') AS tables_failed
    FROM sync_outcomes
    """,
)
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_report(_outcomes(spark, sf_dir))


@query(
    "sync_state",
    """
    SELECT table_id, updated, frequency FROM table_state WHERE table_id NOT IN (SELECT table_id FROM sync_outcomes WHERE status = 'synced')
    UNION ALL SELECT table_id, updated, frequency FROM sync_outcomes WHERE status = 'synced'
    """,
)
def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.advance_state(frames.table_state(spark, sf_dir), _outcomes(spark, sf_dir))


@query(
    "period_to_date",
    "SELECT * FROM period_stored",
)
def period_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = delta.clean_periods(frames.period_lists(spark, sf_dir), pos="pos")
    return cleaned.select(
        "table_id", "pos", "tid", "tid_form", F.col("tid_date").cast("string").alias("tid_date"),
        F.col("tid_range.lo").alias("lo"), F.col("tid_range.hi").alias("hi"), "tid_text",
    )


@query(
    "int_range",
    """
    SELECT p_partkey, age_text, lo, hi, '[' || lo || ',' || COALESCE(CAST(hi AS VARCHAR), '') || ')' AS age_range
    FROM (SELECT p_partkey,
      CASE WHEN b >= 45 THEN b || '-' WHEN b >= 40 THEN b || 'OV' ELSE ' ' || b || '-' || (b + 4) END AS age_text,
      b AS lo, CASE WHEN b < 40 THEN b + 5 END AS hi
      FROM (SELECT p_partkey, (p_size // 5) * 5 AS b FROM part))
    """,
)
def int_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = (F.floor(F.col("p_size") / 5) * 5).cast("int")
    text = (
        F.when(low >= 45, F.concat(low.cast("string"), F.lit("-")))
        .when(low >= 40, F.concat(low.cast("string"), F.lit("OV")))
        .otherwise(F.concat(F.lit(" "), low.cast("string"), F.lit("-"), (low + 4).cast("string")))
    )
    ages = frames.table(spark, sf_dir, "part").select("p_partkey", text.alias("age_text"))
    ranged = ages.withColumn("r", int_range(F.col("age_text")))
    return ranged.select("p_partkey", "age_text", "r.lo", "r.hi", range_text(F.col("r")).alias("age_range"))


@query(
    "normalize_periods",
    """
    SELECT table_id, MIN(pos) AS pos, tid_text FROM (
      SELECT table_id, pos, tid_text FROM changed_quarters UNION ALL SELECT table_id, pos + 10, tid_text FROM changed_quarters)
    GROUP BY table_id, tid_text
    """,
)
def normalize_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = frames.changed_quarters(_quarters(spark, sf_dir))
    twice = once.unionByName(once.withColumn("pos", F.col("pos") + 10))
    return delta.normalize_periods(twice)


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters per table as a stored list; what is on disk, changed and loaded follows from it."""
    return stored(frames.table_quarters(spark, sf_dir), "quarters")


def _clean_facts(raw: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    return clean_measure(delta.clean_periods(raw, codes=codes)).where(F.col("indhold").isNotNull())


def _reloaded(raw: DataFrame, codes: DataFrame) -> DataFrame:
    return _clean_facts(raw, codes).withColumn("indhold", F.col("indhold") + 1)


def loaded_facts(spark: SparkSession, sf_dir: str, quarters: DataFrame) -> DataFrame:
    """Loaded tables: the two latest quarters are not there yet, and F3 is not loaded."""
    latest = quarters.where(F.col("rk") <= 2).select("table_id", "tid")
    raw = frames.fact_tables(spark, sf_dir).where(F.col("table_id") != "F3")
    return _clean_facts(raw.join(latest, ["table_id", "tid"], "left_anti"))


def reloaded_facts(spark: SparkSession, sf_dir: str, quarters: DataFrame, wanted: DataFrame) -> DataFrame:
    """Disk rows of the wanted raw periods, cleaned; the others are left out before anything is cleaned."""
    on_disk = frames.disk_manifest(quarters)
    keys = wanted.select("table_id", "tid").join(on_disk, ["table_id", "tid"], "left_semi")
    return _reloaded(frames.fact_tables(spark, sf_dir).join(keys, ["table_id", "tid"], "left_semi"), on_disk)


_FACT = ["table_id", "omrade", "status", "tid_text", "indhold"]


_DELTA_SQL = """
    SELECT table_id, omrade, status, tid_text, indhold FROM stored_facts
    WHERE table_id = 'F5' OR (table_id, tid_text) NOT IN (SELECT (table_id, tid_text) FROM changed_quarters)
    UNION ALL
    SELECT table_id, omrade, status, tid_text, indhold FROM reloaded_facts
    WHERE (table_id, tid_text) IN (SELECT (table_id, tid_text) FROM changed_quarters)
    """


@query("apply_delta", _DELTA_SQL)
def apply_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = _quarters(spark, sf_dir)
    changed = delta.loadable_changes(frames.changed_quarters(quarters), frames.disk_manifest(quarters))
    keys = delta.normalize_periods(changed)
    target = loaded_facts(spark, sf_dir, quarters).select(*_FACT)
    return delta.apply_delta(target, reloaded_facts(spark, sf_dir, quarters, changed), keys)


def _on_disk(spark: SparkSession, sf_dir: str, quarters: DataFrame) -> tuple[str, str]:
    """Raw and stored tables in the period layout."""
    raw_root, stored_root = scratch_path(spark, "raw"), scratch_path(spark, "stored-periods")
    raw = frames.fact_tables(spark, sf_dir).join(frames.disk_manifest(quarters), ["table_id", "tid"], "left_semi")
    layout.write_periods(raw, raw_root, version=1)
    facts = loaded_facts(spark, sf_dir, quarters)
    layout.write_periods(facts.select("table_id", "omrade", "status", F.col("tid_text").alias("tid"), "indhold"), stored_root, version=1)
    return raw_root, stored_root


@query("apply_delta_on_disk", _DELTA_SQL)
def apply_delta_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the period layout: only the changed periods are read, cleaned and written."""
    quarters = _quarters(spark, sf_dir)
    raw_root, stored_root = _on_disk(spark, sf_dir, quarters)
    delta_files.apply_delta(spark, raw_root, stored_root, frames.changed_quarters(quarters), _reloaded, version=2)
    return layout.read_periods(spark, stored_root).withColumnRenamed("tid", "tid_text")


_REPORT_SQL = """
    SELECT c.table_id, CASE WHEN c.table_id = 'F5' THEN 'skipped' ELSE 'applied' END AS status,
           CASE WHEN c.table_id = 'F5' THEN 'no_partition_data' END AS reason,
           (SELECT COUNT(*) FROM stored_facts s JOIN changed_quarters q ON q.table_id = s.table_id AND q.tid_text = s.tid_text
            WHERE s.table_id = c.table_id AND c.table_id <> 'F5') AS deleted_rows,
           (SELECT COUNT(*) FROM reloaded_facts s JOIN changed_quarters q ON q.table_id = s.table_id AND q.tid_text = s.tid_text
            WHERE s.table_id = c.table_id AND c.table_id <> 'F5') AS inserted_rows,
           (SELECT COUNT(*) FROM changed_quarters q LEFT JOIN disk_manifest m ON m.table_id = q.table_id AND m.tid = q.tid
            WHERE q.table_id = c.table_id AND m.tid IS NULL) AS missing_periods
    FROM (SELECT DISTINCT table_id FROM changed_quarters) c
    """


@query("delta_report", _REPORT_SQL)
def delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = _quarters(spark, sf_dir)
    changed = frames.changed_quarters(quarters)
    fresh = reloaded_facts(spark, sf_dir, quarters, changed)
    return delta.delta_report(loaded_facts(spark, sf_dir, quarters), fresh, changed, frames.disk_manifest(quarters))


@query("delta_report_on_disk", _REPORT_SQL)
def delta_report_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted rows are told from the manifest, inserted ones from the write."""
    quarters = _quarters(spark, sf_dir)
    raw_root, stored_root = _on_disk(spark, sf_dir, quarters)
    return delta_files.apply_delta(spark, raw_root, stored_root, frames.changed_quarters(quarters), _reloaded, version=2)


@query(
    "missing_periods",
    """
    SELECT table_id, tid, CAST(MAKE_DATE(CAST(SUBSTR(tid, 1, 4) AS BIGINT), CAST(SUBSTR(tid, 6, 1) AS BIGINT) * 3 - 2, 1) AS VARCHAR) AS tid_text
    FROM disk_manifest WHERE (table_id, tid) NOT IN (SELECT DISTINCT (table_id, tid) FROM stored_facts)
    """,
)
def missing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = _quarters(spark, sf_dir)
    return delta.missing_periods(frames.disk_manifest(quarters), loaded_facts(spark, sf_dir, quarters))


@query(
    "backfill_plan",
    """
    SELECT m.table_id, CASE WHEN l.table_id IS NULL THEN 'create' WHEN COUNT(*) > COUNT(s.tid) THEN 'backfill' ELSE 'none' END AS action,
           COUNT(*) AS disk_periods, COUNT(*) - COUNT(s.tid) AS periods_to_load
    FROM disk_manifest m
    LEFT JOIN (SELECT DISTINCT table_id FROM stored_facts) l ON l.table_id = m.table_id
    LEFT JOIN (SELECT DISTINCT table_id, tid FROM stored_facts) s ON s.table_id = m.table_id AND s.tid = m.tid
    GROUP BY m.table_id, l.table_id
    """,
)
def backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = _quarters(spark, sf_dir)
    return delta.backfill_plan(frames.disk_manifest(quarters), loaded_facts(spark, sf_dir, quarters))


_BACKFILL_SQL = """
    SELECT table_id, omrade, status, tid_text, indhold FROM stored_facts
    UNION ALL
    SELECT r.table_id, r.omrade, r.status, r.tid_text, r.indhold FROM reloaded_facts r
    WHERE (r.table_id, r.tid_text) NOT IN (SELECT DISTINCT (table_id, tid_text) FROM stored_facts)
    """


@query("backfill", _BACKFILL_SQL)
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = _quarters(spark, sf_dir)
    loaded = stored(loaded_facts(spark, sf_dir, quarters).select(*_FACT), "loaded")
    return delta.backfill(loaded, frames.disk_manifest(quarters), frames.fact_tables(spark, sf_dir), _reloaded)


@query("backfill_on_disk", _BACKFILL_SQL)
def backfill_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarters = _quarters(spark, sf_dir)
    raw_root, stored_root = _on_disk(spark, sf_dir, quarters)
    delta_files.backfill(spark, raw_root, stored_root, _reloaded, version=2)
    return layout.read_periods(spark, stored_root).withColumnRenamed("tid", "tid_text")


@query(
    "period_extent",
    """
    SELECT table_id, CASE WHEN table_id LIKE 'SPAN%' THEN CAST(MIN(lo) AS VARCHAR) ELSE MIN(tid_text) END AS min_tid,
           CASE WHEN table_id LIKE 'SPAN%' THEN CAST(MAX(hi) AS VARCHAR) ELSE MAX(tid_text) END AS max_tid
    FROM period_stored GROUP BY table_id
    """,
)
def period_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.period_extent(delta.clean_periods(frames.period_lists(spark, sf_dir), pos="pos"))


@query(
    "bootstrap_state",
    """
    SELECT p.table_id, 'bootstrapped' AS status, COALESCE(o.frequency, f.frequency) AS frequency, COUNT(*) AS period_count,
           COALESCE(n.n_name, 'earlier') AS updated
    FROM period_lists p JOIN frequency_of f ON f.table_id = p.table_id
    LEFT JOIN (SELECT * FROM frequency_overrides WHERE frequency = 'weekly') o ON o.table_id = p.table_id
    LEFT JOIN nation n ON p.table_id = 'MONTH' || n.n_nationkey
    GROUP BY p.table_id, o.frequency, f.frequency, n.n_name
    """,
)
def bootstrap_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = frames.period_lists(spark, sf_dir)
    catalog = frames.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("MONTH"), F.col("n_nationkey").cast("string")).alias("table_id"), F.col("n_name").alias("updated")
    )
    previous = lists.select("table_id").distinct().withColumn("updated", F.lit("earlier"))
    return sync.bootstrap_state(lists, frames.frequency_overrides(spark, sf_dir), catalog, previous)

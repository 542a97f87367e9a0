"""The sync run: every changed table of the catalog in one job, each failing alone.

What goes wrong with a table is a row, never an error of the query: a
description without periods, a source that gives an error, an unreadable
measure, a period that wasn't asked for. A failed table keeps its period files
and its state; the others are published together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sync
from ..operators.clean import measure_problem
from ..session import stored
from . import layout

OUTCOME = ["table_id", "updated", "status", "reason", "frequency", "periods_fetched", "rows_written", "files_written", "bootstrap"]


def run(
    spark: SparkSession,
    catalog: DataFrame,
    state: DataFrame,
    descriptions: DataFrame,
    overrides: DataFrame,
    root: str,
    fetch: Callable[[DataFrame], DataFrame],
    max_tables: int | None = None,
    max_rows: int = sync.MAX_ROWS_PER_BATCH,
    version: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Bring the period files below ``root`` up to date; outcomes per table and the next state.

    ``catalog`` is ``(pos, table_id, updated)``; the first ``max_tables`` by
    ``pos`` are looked at. ``state`` is ``(table_id, updated, frequency)``,
    ``descriptions`` ``(table_id, variables)``. ``fetch`` gets the periods to load
    as ``(table_id, pos, tid, batch)``, a batch being one request of at most
    ``max_rows`` expected rows, and gives raw rows with ``table_id``, ``tid`` and
    ``indhold`` as text; an ``error`` column, where there is one, names what
    kept a table or batch from being read.

    Outcomes are ``synced``, ``skipped`` (``unchanged``, ``no_periods``) or
    ``failed`` with the first message by text order. Fetched rows are stored once.
    """
    looked_at = catalog if max_tables is None else catalog.orderBy("pos").limit(max_tables)
    looked_at = stored(looked_at.select("table_id", "updated"), "catalog")
    changed = stored(sync.changed_tables(looked_at, state).select("table_id"), "changed")

    told = descriptions.join(changed, "table_id", "left_semi")
    undescribed = changed.join(descriptions.select("table_id"), "table_id", "left_anti").select("table_id", F.lit("no description").alias("message"))
    wrong = stored(sync.metadata_problems(told).unionByName(undescribed), "undescribed")
    described = told.join(wrong.select("table_id"), "table_id", "left_anti")
    lists = stored(sync.metadata_periods(described), "lists")
    frequencies = stored(sync.resolve_frequency(lists, overrides), "frequencies")
    held = stored(layout.manifest(spark, root), "held")
    picked = sync.pick_periods(lists, held, frequencies)
    picked = stored(sync.period_batches(stored(picked, "picked"), sync.estimate_rows(described), max_rows), "batches")

    got = fetch(picked)
    if "error" not in got.columns:
        got = got.withColumn("error", F.lit(None).cast("string"))
    asked = picked.select("table_id", "tid", F.lit(True).alias("_asked"))
    checked = got.join(asked, layout.KEYS, "left")
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("_asked").isNull(), F.concat(F.lit("period not asked for: "), F.coalesce("tid", F.lit("none"))))
        .otherwise(measure_problem(F.col("indhold")))
    )
    fetched = stored(checked.withColumn("_problem", problem).drop("_asked", "error"), "fetched")
    broken = fetched.where("_problem is not null").groupBy("table_id").agg(F.min("_problem").alias("message"))
    failed = stored(wrong.unionByName(broken.join(changed, "table_id", "left_semi")), "failed")

    good = picked.join(failed.select("table_id"), "table_id", "left_anti")
    rows = fetched.where("_problem is null").drop("_problem").join(good.select(*layout.KEYS), layout.KEYS, "left_semi")
    written = layout.write_periods(rows, root, requested=good, version=version)

    counts = written.groupBy("table_id").agg(F.sum("rows").alias("rows_written"), F.count_if(F.col("rows") > 0).alias("files_written"))
    periods = picked.groupBy("table_id").agg(F.count(F.lit(1)).alias("periods_fetched"))
    present = held.select("table_id").distinct().withColumn("_held", F.lit(True))
    each = (
        looked_at.join(changed.withColumn("_changed", F.lit(True)), "table_id", "left")
        .join(failed, "table_id", "left")
        .join(frequencies.select("table_id", "frequency"), "table_id", "left")
        .join(periods, "table_id", "left")
        .join(counts, "table_id", "left")
        .join(present, "table_id", "left")
    )
    status = (
        F.when(F.col("_changed").isNull(), "skipped").when(F.col("message").isNotNull(), "failed")
        .when(F.col("periods_fetched").isNull(), "skipped").otherwise("synced")
    )
    reason = (
        F.when(F.col("_changed").isNull(), "unchanged").when(F.col("message").isNotNull(), F.col("message"))
        .when(F.col("periods_fetched").isNull(), "no_periods")
    )
    synced = F.col("status") == "synced"
    outcomes = each.withColumn("status", status).select(
        "table_id", "updated", "status", reason.alias("reason"), F.when(F.col("_changed").isNotNull(), F.col("frequency")).alias("frequency"),
        *[F.when(synced, F.coalesce(c, F.lit(0).cast("bigint"))).alias(c) for c in ("periods_fetched", "rows_written", "files_written")],
        F.when(synced, F.col("_held").isNull()).alias("bootstrap"),
    )
    outcomes = stored(outcomes.select(*OUTCOME), "outcomes")
    return outcomes, sync.advance_state(state, outcomes)

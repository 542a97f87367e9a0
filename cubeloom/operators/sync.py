"""Incremental sync: what changed, which periods to fetch, in which batches.

Every function works on all tables at once; ``table_id`` is the leading key
and ``pos`` the 0-based place of a period in its table's published order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import REVISION_WINDOW, frequency, revision_window
from ..plans.ordered import row_numbers

MAX_ROWS_PER_BATCH = 50_000_000  # fixed value


def infer_frequency(periods: DataFrame) -> DataFrame:
    """``(table_id, sample, frequency)`` from the last non-empty code of each table."""
    filled = F.col("tid").isNotNull() & (F.col("tid") != "")
    last = F.max(F.when(filled, F.struct("pos", "tid")))
    return (
        periods.groupBy("table_id")
        .agg(F.coalesce(last["tid"], F.lit("")).alias("sample"))
        .withColumn("frequency", frequency(F.col("sample")))
    )


def resolve_frequency(periods: DataFrame, overrides: DataFrame) -> DataFrame:
    """Inferred frequency, replaced where ``overrides(table_id, frequency)`` names a known one."""
    known = overrides.where(F.col("frequency").isin(*REVISION_WINDOW)).select(
        "table_id", F.col("frequency").alias("override")
    )
    return (
        infer_frequency(periods)
        .join(known, "table_id", "left")
        .select(
            "table_id",
            F.coalesce("override", "frequency").alias("frequency"),
            F.col("override").isNotNull().alias("overridden"),
        )
    )


def pick_periods(remote: DataFrame, local: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Periods to fetch, in remote order, with the reason.

    ``bootstrap``: nothing is held locally. ``new``: not held. ``revision``: one
    of the last K of the remote list. Positions are dense, so "the last K" is a
    comparison with the list length and needs no ordered window.
    """
    sizes = remote.groupBy("table_id").agg((F.max("pos") + 1).alias("_n"))
    held_tables = local.select("table_id").distinct().withColumn("_any", F.lit(True))
    held = local.select("table_id", "tid").distinct().withColumn("_held", F.lit(True))
    per_table = (
        sizes.join(held_tables, "table_id", "left")
        .join(frequencies.select("table_id", "frequency"), "table_id", "left")
        .withColumn("_from", F.col("_n") - revision_window(F.coalesce("frequency", F.lit("other"))))
    )
    marked = remote.join(held, ["table_id", "tid"], "left").join(per_table, "table_id")
    reason = (
        F.when(F.col("_any").isNull(), "bootstrap")
        .when(F.col("_held").isNull(), "new")
        .when(F.col("pos") >= F.col("_from"), "revision")
    )
    return (
        marked.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("table_id", "pos", "tid", "reason")
    )


def _is_period(v: Column) -> Column:
    return F.lower(v["id"]) == "tid"


def metadata_periods(meta: DataFrame) -> DataFrame:
    """``(table_id, pos, tid)`` from nested descriptions; values are objects or scalars."""
    variables = meta.schema["variables"].dataType.elementType
    value_type = variables["values"].dataType.elementType
    exploded = meta.select(
        "table_id", F.posexplode(F.get(F.filter("variables", _is_period), F.lit(0))["values"]).alias("pos", "value")
    )
    code = F.col("value")["id"] if isinstance(value_type, T.StructType) else F.col("value")
    return exploded.select("table_id", F.col("pos").cast("bigint").alias("pos"), code.cast("string").alias("tid"))


def metadata_problems(meta: DataFrame) -> DataFrame:
    """Tables whose description has no period variable, or one without values."""
    found = F.filter("variables", _is_period)
    message = F.when(F.size(found) == 0, "no period variable").when(
        F.coalesce(F.size(F.get(found, F.lit(0))["values"]), F.lit(0)) <= 0, "no period values"
    )
    return meta.select("table_id", message.alias("message")).where(F.col("message").isNotNull())


def estimate_rows(meta: DataFrame) -> DataFrame:
    """Expected rows per period: product of the code-list lengths over the period count."""
    lengths = F.transform("variables", lambda v: F.greatest(F.size(v["values"]), F.lit(0)).cast("double"))
    total = F.aggregate(lengths, F.lit(1.0), lambda acc, n: acc * n)
    periods = F.coalesce(F.size(F.get(F.filter("variables", _is_period), F.lit(0))["values"]), F.lit(0))
    per_period = F.ceil(total / F.greatest(F.lit(1), periods))
    return meta.select(
        "table_id",
        F.greatest(periods, F.lit(0)).cast("bigint").alias("n_periods"),
        F.greatest(F.lit(1), per_period).cast("bigint").alias("rows_per_period"),
    )


def period_batches(picked: DataFrame, estimates: DataFrame, max_rows: int = MAX_ROWS_PER_BATCH) -> DataFrame:
    """Number the picked periods into fetch batches of at most ``max_rows`` expected rows."""
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(max_rows) / F.col("rows_per_period")))
    return (
        row_numbers(picked, ["table_id"], "pos", "_rn")
        .join(estimates.select("table_id", "rows_per_period"), "table_id")
        .select("table_id", "pos", "tid", F.floor((F.col("_rn") - 1) / per_batch).cast("bigint").alias("batch"))
    )


def changed_tables(catalog: DataFrame, state: DataFrame) -> DataFrame:
    """Catalog rows whose ``updated`` stamp differs from the state; null equals null."""
    seen = state.select("table_id", F.col("updated").alias("_seen"))
    return (
        catalog.join(seen, "table_id", "left")
        .where(~F.col("updated").eqNullSafe(F.col("_seen")))
        .select("table_id", "updated", F.col("_seen").alias("previous"))
    )


def sync_report(outcomes: DataFrame) -> DataFrame:
    """One row: tables in total, synced, skipped and failed."""

    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return outcomes.agg(
        F.count(F.lit(1)).alias("tables_total"),
        count("synced").alias("tables_synced"),
        count("skipped").alias("tables_skipped"),
        count("failed").alias("tables_failed"),
    )


def advance_state(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """State after a run: only synced tables move to their new stamp and frequency."""
    now = F.struct("updated", "frequency").alias("_now")
    moved = outcomes.where(F.col("status") == "synced").select("table_id", now)
    before = state.select("table_id", F.struct("updated", "frequency").alias("_before"))
    return before.join(moved, "table_id", "full_outer").select("table_id", F.coalesce("_now", "_before").alias("s")).select(
        "table_id", "s.updated", "s.frequency"
    )


def bootstrap_state(
    manifest: DataFrame, overrides: DataFrame, catalog: DataFrame, previous: DataFrame
) -> DataFrame:
    """First state of tables whose period files are already present.

    The frequency comes from the largest code, because file names are listed in
    sorted order; the stamp from the catalog, else from the previous state.
    """
    held = manifest.groupBy("table_id").agg(
        F.count_distinct("tid").alias("period_count"), F.max(F.when(F.col("tid") != "", F.col("tid"))).alias("_last")
    )
    known = overrides.where(F.col("frequency").isin(*REVISION_WINDOW)).select(
        "table_id", F.col("frequency").alias("_override")
    )
    return (
        held.join(known, "table_id", "left")
        .join(catalog.select("table_id", F.col("updated").alias("_now")), "table_id", "left")
        .join(previous.select("table_id", F.col("updated").alias("_before")), "table_id", "left")
        .select(
            "table_id",
            F.lit("bootstrapped").alias("status"),
            F.coalesce("_override", frequency(F.coalesce("_last", F.lit("")))).alias("frequency"),
            "period_count",
            F.coalesce("_now", "_before").alias("updated"),
        )
    )

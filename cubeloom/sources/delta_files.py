"""Keeping stored period files current from raw period files, by the periods that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta
from ..session import stored
from . import layout


def apply_delta(
    spark: SparkSession, raw_root: str, stored_root: str, changed: DataFrame, clean: delta.Clean, version: int | None = None
) -> DataFrame:
    """Replace the changed periods of the stored files by what the raw files hold; the report per table.

    ``changed`` has raw codes ``(table_id, pos, tid)``. Only directories of changed
    periods are read, cleaned and written. ``clean`` gives rows with ``tid_text``,
    which names the stored period. Rows deleted are known from the manifest, rows
    inserted from the write, so no stored row is read. A table without any
    changed period among the raw files is skipped.
    """
    held = stored(layout.manifest(spark, raw_root).where("rows > 0").select(*layout.KEYS), "held")
    changed = stored(changed.select("table_id", "pos", "tid"), "changed")
    loadable = stored(delta.loadable_changes(changed, held), "loadable")
    keys = stored(
        delta.clean_periods(loadable, codes=held.unionByName(loadable.select(*layout.KEYS)).distinct())
        .select("table_id", F.col("tid_text").alias("tid")).distinct(),
        "keys",
    )
    before = stored(layout.manifest(spark, stored_root).join(keys, layout.KEYS, "left_semi"), "before")
    raw, _ = layout.load_periods(spark, raw_root, loadable)
    rows = clean(raw, held)
    rows = rows.select(*[F.col("tid_text").alias("tid") if c == "tid" else F.col(c) for c in rows.columns if not c.startswith("tid_")])
    written = layout.write_periods(rows, stored_root, requested=keys, version=version)
    return delta.report(changed, held, before, written)


def backfill(spark: SparkSession, raw_root: str, stored_root: str, clean: delta.Clean, version: int | None = None) -> DataFrame:
    """Load the raw periods that the stored files lack; ``table_id, tid, rows`` of what was added."""
    held = stored(layout.manifest(spark, raw_root).where("rows > 0").select(*layout.KEYS), "held")
    there = layout.manifest(spark, stored_root).select("table_id", F.col("tid").alias("tid_text"))
    absent = stored(delta.missing_periods(held, there), "absent")
    raw, _ = layout.load_periods(spark, raw_root, absent)
    rows = clean(raw, held)
    rows = rows.select(*[F.col("tid_text").alias("tid") if c == "tid" else F.col(c) for c in rows.columns if not c.startswith("tid_")])
    asked = absent.select("table_id", F.col("tid_text").alias("tid"))
    return layout.write_periods(rows, stored_root, requested=asked, version=version)

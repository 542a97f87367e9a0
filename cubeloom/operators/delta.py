"""Stored form of periods, and keeping stored tables current by replacing periods.

Stored facts carry ``tid_text``, the text form of the stored period, which is
the key that periods are compared on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import DATE_FORMS, FIRST_YEAR, LAST_YEAR, period_date, period_form, period_span, period_text
from ..plans.lookup import distinct_codes, join_lookup
from ..session import stored


#: Cleans raw rows of some periods, given ``(table_id, tid)`` of all periods of their tables.
Clean = Callable[[DataFrame, DataFrame], DataFrame]


def series_forms(codes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per table: the form of its first non-null code, from its distinct codes.

    Without positions the smallest code stands in for the first, so the answer
    does not depend on how rows are spread over partitions.
    """
    code = F.col("tid").cast("string")
    if "_pos" not in codes.columns:
        first = F.min(code)
    else:
        first = F.min(F.when(code.isNotNull(), F.struct(F.col("_pos").alias("p"), code.alias("c"))))["c"]
    if isinstance(codes.schema["tid"].dataType, T.IntegralType):
        year = first.try_cast("bigint")
        form = F.when((year > FIRST_YEAR) & (year < LAST_YEAR), "year").otherwise(
            F.raise_error(F.concat(F.lit("not a year: "), F.coalesce(first, F.lit("null")))).cast("string")
        )
        form = F.when(first.isNotNull(), form)
    else:
        form = period_form(first)
    return codes.groupBy(*keys).agg(form.alias("tid_form"))


def period_lookup(codes: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """Every distinct code with its form, date, range and stored text."""
    forms = series_forms(codes, keys)
    joined = codes.join(forms, keys, "left") if keys else codes.withColumn("tid_form", forms.scalar())
    code, form = F.col("tid").cast("string"), F.col("tid_form")
    parsed = joined.withColumns({"tid_date": period_date(code, form), "tid_range": period_span(code, form)})
    day, span = F.col("tid_date"), F.col("tid_range")
    bad = code.isNotNull() & ((form.isin(*DATE_FORMS) & day.isNull()) | ((form == "span") & span.isNull()))
    text = period_text(code, form, day, span)
    if not strict:
        out = parsed.withColumns({"tid_text": text, "tid_rejected": F.coalesce(bad, F.lit(False))})
    else:
        message = F.concat(F.lit("period "), code, F.lit(" does not fit form "), form)
        out = parsed.withColumn("tid_text", F.when(bad, F.raise_error(message).cast("string")).otherwise(text))
    return out.drop("_pos")


def clean_periods(
    df: DataFrame, keys: list[str] | None = None, pos: str | None = None, strict: bool = True, codes: DataFrame | None = None
) -> DataFrame:
    """Add ``tid_form, tid_date, tid_range, tid_text``; one form holds for a whole table.

    A code that does not fit its table's form raises in strict mode; otherwise
    the row is kept with ``tid_rejected`` true. Codes are read once per distinct
    code; the rows only look them up. Where ``df`` has some periods of its tables
    only, ``codes`` (such as a manifest) has all of them, so that the form is
    that of the whole table.
    """
    on = [*(["table_id"] if keys is None else keys), "tid"]
    codes = stored(distinct_codes(df if codes is None else codes, on, pos), "codes")
    return join_lookup(df, stored(period_lookup(codes, on[:-1], strict), "periods"), on)


def normalize_periods(changed: DataFrame) -> DataFrame:
    """Changed raw codes ``(table_id, pos, tid)`` in stored form, first occurrence kept."""
    return (
        clean_periods(changed, pos="pos")
        .groupBy("table_id", "tid_text")
        .agg(F.min("pos").alias("pos"))
        .select("table_id", "pos", "tid_text")
    )


def loadable_changes(changed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Changes of tables with at least one of the changed periods on disk; the rest are skipped."""
    present = changed.join(manifest.select("table_id", "tid").distinct(), ["table_id", "tid"], "left_semi")
    return changed.join(present.select("table_id").distinct(), "table_id", "left_semi")


def apply_delta(target: DataFrame, reloaded: DataFrame, changed: DataFrame) -> DataFrame:
    """Target with every changed period replaced by its reloaded rows.

    ``changed`` is ``(table_id, tid_text)``. ``reloaded`` is already cleaned.
    """
    keys = ["table_id", "tid_text"]
    kept = target.join(changed.select(*keys).distinct(), keys, "left_anti")
    fresh = reloaded.join(changed.select(*keys).distinct(), keys, "left_semi")
    return kept.unionByName(fresh.select(*kept.columns))


def delta_report(target: DataFrame, reloaded: DataFrame, changed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per table: status, rows deleted and inserted, changed periods without a file.

    ``changed`` holds the raw codes ``(table_id, pos, tid)``. Only rows of changed periods are counted.
    """
    keys = stored(normalize_periods(loadable_changes(changed, manifest)).select("table_id", "tid_text"), "keys")

    def rows(df: DataFrame) -> DataFrame:
        hit = df.select("table_id", "tid_text").join(keys, ["table_id", "tid_text"], "left_semi")
        return hit.groupBy("table_id").agg(F.count(F.lit(1)).alias("rows"))

    return report(changed, manifest, rows(target), rows(reloaded))


def report(changed: DataFrame, manifest: DataFrame, deleted: DataFrame, inserted: DataFrame) -> DataFrame:
    """The report of a delta from counts ``(table_id, rows)`` of what was deleted and inserted."""
    held = manifest.select("table_id", "tid").distinct().withColumn("_held", F.lit(1))
    disk = (
        changed.select("table_id", "tid")
        .distinct()
        .join(held, ["table_id", "tid"], "left")
        .groupBy("table_id")
        .agg(F.count("_held").alias("_found"), F.count_if(F.col("_held").isNull()).alias("missing_periods"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        disk.join(deleted.groupBy("table_id").agg(F.sum("rows").alias("_deleted")), "table_id", "left")
        .join(inserted.groupBy("table_id").agg(F.sum("rows").alias("_inserted")), "table_id", "left")
        .select(
            "table_id",
            F.when(F.col("_found") > 0, "applied").otherwise("skipped").alias("status"),
            F.when(F.col("_found") == 0, "no_partition_data").alias("reason"),
            F.coalesce("_deleted", zero).alias("deleted_rows"),
            F.coalesce("_inserted", zero).alias("inserted_rows"),
            "missing_periods",
        )
    )


def missing_periods(manifest: DataFrame, loaded: DataFrame) -> DataFrame:
    """Raw periods on disk whose stored form is absent from the loaded table."""
    have = loaded.select("table_id", "tid_text").distinct()
    return (
        clean_periods(manifest.select("table_id", "tid").distinct())
        .join(have, ["table_id", "tid_text"], "left_anti")
        .select("table_id", "tid", "tid_text")
    )


def backfill_plan(manifest: DataFrame, loaded: DataFrame) -> DataFrame:
    """Per table on disk: ``create`` it, ``backfill`` it, or ``none``, with period counts."""
    disk = manifest.groupBy("table_id").agg(F.count_distinct("tid").alias("disk_periods"))
    known = loaded.select("table_id").distinct().withColumn("_loaded", F.lit(True))
    absent = missing_periods(manifest, loaded).groupBy("table_id").agg(F.count(F.lit(1)).alias("_absent"))
    gap = F.coalesce("_absent", F.lit(0).cast("bigint"))
    return (
        disk.join(known, "table_id", "left")
        .join(absent, "table_id", "left")
        .select(
            "table_id",
            F.when(F.col("_loaded").isNull(), "create").when(gap > 0, "backfill").otherwise("none").alias("action"),
            "disk_periods",
            gap.alias("periods_to_load"),
        )
    )


def backfill(loaded: DataFrame, manifest: DataFrame, raw: DataFrame, clean: Clean) -> DataFrame:
    """Stored facts with the absent periods of every table added from the raw rows.

    What is absent is told from the manifest first, so only those raw rows are
    cleaned; ``clean`` gets them and the manifest with all codes.
    """
    absent = stored(missing_periods(manifest, loaded), "absent")
    rows = raw.join(absent.select("table_id", "tid"), ["table_id", "tid"], "left_semi")
    return apply_delta(loaded, clean(rows, manifest), absent.select("table_id", "tid_text"))


def period_extent(facts: DataFrame) -> DataFrame:
    """First and last stored period per table; ranges give their lower and upper bounds."""
    span = F.col("tid_range")

    def pick(date_part: Column, range_part: Column, text_part: Column) -> Column:
        return F.coalesce(date_part.cast("string"), range_part.cast("string"), text_part)

    plain = F.when(F.col("tid_date").isNull() & span.isNull(), F.col("tid_text"))
    # an open upper bound has no largest value, as in max(upper(...)): null is skipped
    return facts.groupBy("table_id").agg(
        pick(F.min("tid_date"), F.min(span["lo"]), F.min(plain)).alias("min_tid"),
        pick(F.max("tid_date"), F.max(span["hi"]), F.max(plain)).alias("max_tid"),
    )

"""Parameterised query sets: named SQL, filters, outputs, validation, snapshots."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date
from functools import partial, reduce
from typing import Any
from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clean import dates_to_timestamps

# How a parameter is written (a second colon before the name is a cast), and how many options are
# shown beside a value that is not one of them.
PARAMETER = re.compile(r"(?<!:):(\w+)")
SAMPLE_VALUES = 5


# ---- filters ------------------------------------------------------------


@dataclass(frozen=True)
class Parameter:
    """One named value that a reader may set: ``choice``, ``day`` or ``flag``."""

    name: str
    kind: str
    default: Any = None
    options: str | None = None


def choice(name: str, default: str = "all", options: str | None = None) -> tuple[Parameter, ...]:
    """One of the values that the query ``options`` lists."""
    return (Parameter(name, "choice", default, options),)


def day_range(name: str, first: str | None = None, last: str | None = None) -> tuple[Parameter, ...]:
    """``<name>_from`` and ``<name>_to``; an empty day is no bound."""
    return (Parameter(f"{name}_from", "day", first), Parameter(f"{name}_to", "day", last))


def flag(name: str, default: bool = False) -> tuple[Parameter, ...]:
    return (Parameter(name, "flag", default),)


_READ: dict[str, Callable[[str], Any]] = {"choice": str, "day": lambda text: text or None, "flag": lambda text: text.lower() == "true"}


def filter_key(given: Mapping[str, str]) -> str:
    """Canonical key of filter values: pairs sorted and URL-encoded, ``_`` if there are none."""
    pairs = sorted((k, v) for k, v in given.items() if k)
    return urlencode(pairs) if pairs else "_"


# ---- the set ------------------------------------------------------------


@dataclass(frozen=True)
class Metric:
    """A one-row frame ``value, label, format, change, change_label``."""

    frame: DataFrame


def metric(
    frame: DataFrame, value: str, label: str, format: str = "number",
    change: str | None = None, change_label: str | None = None,
) -> Metric:
    return Metric(
        frame.select(
            F.col(value).alias("value"),
            F.lit(label).alias("label"),
            F.lit(format).alias("format"),
            (F.col(change) if change else F.lit(None)).cast("double").alias("change"),
            F.lit(change_label).cast("string").alias("change_label"),
        )
    )


@dataclass(frozen=True)
class Output:
    """A table or metric made from the results of the queries it needs, in this order."""

    needs: tuple[str, ...]
    make: Callable[..., DataFrame | Metric]


@dataclass(frozen=True)
class QuerySet:
    """Named SQL texts over named frames, with parameters and outputs."""

    name: str
    tables: Mapping[str, DataFrame]
    queries: Mapping[str, str]
    outputs: Mapping[str, Output] = field(default_factory=dict)
    parameters: tuple[Parameter, ...] = ()
    types: Mapping[str, type] = field(default_factory=dict)

    def __post_init__(self) -> None:
        asked = {p.options for p in self.parameters if p.options} | {n for o in self.outputs.values() for n in o.needs}
        if unknown := sorted(asked - set(self.queries)):
            raise ValueError(f"no query of the set: {', '.join(unknown)}")

    def filter_values(self, given: Mapping[str, str]) -> dict[str, Any]:
        """The value of every parameter: as given, read by its kind, or its default."""
        return {p.name: _READ[p.kind](given[p.name]) if given.get(p.name) is not None else p.default for p in self.parameters}


def extract_params(text: str) -> set[str]:
    return set(PARAMETER.findall(text))


def bind_value(name: str, value: Any, kind: type | None = None) -> Any:
    """Value to bind: ``all`` is no filter; names holding date, from or to are dates.

    The rule on names also catches words such as ``total``; ``kind`` overrides it.
    """
    if value is None or value == "all":
        return None
    if kind is None:
        if isinstance(value, bool):
            return value
        kind = date if any(mark in name for mark in ("date", "from", "to")) else str
    if kind is date:
        return value if isinstance(value, date) else date.fromisoformat(str(value))
    return value if isinstance(value, kind) else kind(value)


def bound_args(text: str, filters: Mapping[str, Any], types: Mapping[str, type] | None = None) -> dict[str, Any]:
    """Arguments for exactly the parameters the text names; those without a filter are null."""
    types = types or {}
    return {p: bind_value(p, filters.get(p), types.get(p)) for p in extract_params(text)}


def register_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Free SQL over the warehouse, handed to Spark as it is."""
    register_tables(spark, tables or {})
    return spark.sql(text)


Results = dict[tuple[str, str], DataFrame]


def run_query(
    spark: SparkSession, qs: QuerySet, name: str, filters: Mapping[str, Any], kept: Results | None = None
) -> DataFrame:
    """One named query with its filters bound; dates come back as timestamps.

    ``kept`` holds persisted results by text and filters, so outputs that share
    a query share its run. Its owner releases them.
    """
    text = qs.queries[name]
    key = (text, repr(sorted(filters.items(), key=lambda item: item[0])))
    if kept is not None and key in kept:
        return kept[key]
    register_tables(spark, qs.tables)
    result = dates_to_timestamps(spark.sql(text, args=bound_args(text, filters, qs.types)))
    if kept is not None:
        result = kept[key] = result.persist()
    return result


def release(kept: Results) -> None:
    for result in kept.values():
        result.unpersist()
    kept.clear()


def option_list(options: DataFrame) -> DataFrame:
    """``(value, label)`` as text: null value to empty, label falls back to the value."""
    columns = options.columns
    value = F.coalesce(F.col(columns[0]).cast("string"), F.lit(""))
    label = F.coalesce(F.col(columns[1]).cast("string"), value) if len(columns) > 1 else value
    return options.select(value.alias("value"), label.alias("label"))


def run_output(
    spark: SparkSession, qs: QuerySet, name: str, filters: Mapping[str, Any], kept: Results | None = None
) -> DataFrame | Metric:
    output = qs.outputs[name]
    return output.make(*[run_query(spark, qs, query, filters, kept) for query in output.needs])


# ---- validation ---------------------------------------------------------

_CHECKED = "kind string, name string, found bigint, problem string"


def _look(kind: str, name: str, result: Callable[[], DataFrame | Metric]) -> tuple[str, str, int | None, str | None]:
    """What one check found: rows of a query, whether a table has any, whether a metric has a value."""
    try:
        made = result()
        if isinstance(made, Metric):
            return "metric", name, made.frame.where(F.trim(F.col("value").cast("string")) != "").limit(1).count(), None
        return ("query", name, made.count(), None) if kind == "query" else ("table", name, made.limit(1).count(), None)
    except Exception as exc:  # noqa: BLE001 - output functions are user code
        return kind, name, None, str(exc)


def validate_set(spark: SparkSession, qs: QuerySet, given: Mapping[str, str]) -> DataFrame:
    """Run everything; one row per query and output with rows, status and message.

    What finds nothing is an error while no parameter is set and a warning
    otherwise. A failure is reported and does not stop the run. Only counts reach
    the driver.
    """
    filters = qs.filter_values(given)
    kept: Results = {}
    checks = [("query", name, partial(run_query, spark, qs, name, filters, kept)) for name in qs.queries]
    checks += [("output", name, partial(run_output, spark, qs, name, filters, kept)) for name in qs.outputs]
    try:
        looked = spark.createDataFrame([_look(*check) for check in checks], _CHECKED)
    finally:
        release(kept)
    nothing = F.col("found") == 0
    blame = "warning" if filters != qs.filter_values({}) else "error"
    return looked.select(
        "kind", "name", F.when(F.col("kind") == "query", F.col("found")).alias("rows"),
        F.when(F.col("problem").isNotNull(), "error").when(nothing, blame).otherwise("ok").alias("status"),
        F.coalesce("problem", F.when(nothing, F.format_string("%s %s came out empty", "kind", "name"))).alias("message"),
    )


def invalid_filter_values(options: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen values that are not offered, each with the first few that are.

    ``options`` is ``(filter_name, pos, value)`` in the order of the list,
    ``chosen`` is ``(filter_name, value, default)``. Missing, empty and default
    values are not checked.
    """
    value = F.col("value")
    checked = chosen.where(value.isNotNull() & (value != "") & ~value.eqNullSafe(F.col("default")))
    offered = options.groupBy("filter_name", "value").agg(F.min("pos").alias("pos"))
    wrong = checked.join(offered, ["filter_name", "value"], "left_anti")
    order = Window.partitionBy("filter_name").orderBy("pos", "value")
    first = offered.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= SAMPLE_VALUES)
    samples = first.groupBy("filter_name").agg(F.array_sort(F.collect_list(F.struct("_rn", "value"))).alias("_first"))
    shown = samples.select("filter_name", F.array_join(F.col("_first.value"), ", ").alias("sample_allowed_values"))
    return wrong.join(shown, "filter_name", "left").select("filter_name", "value", "sample_allowed_values")


# ---- snapshots ----------------------------------------------------------


def snapshot(spark: SparkSession, qs: QuerySet, given: Mapping[str, str], folder: str) -> str:
    """Write every output under its filter key and return the key.

    Tables go to ``<folder>/tables/<output>/filter_key=...``, all metrics to
    ``<folder>/metrics/filter_key=...``. A new snapshot replaces its own key
    only, also where an output has become empty.
    """
    key, filters = filter_key(given), qs.filter_values(given)
    kept: Results = {}
    try:
        made = {name: run_output(spark, qs, name, filters, kept) for name in qs.outputs}
        metrics = [
            m.frame.withColumn("value", F.col("value").cast("string")).withColumn("name", F.lit(name))
            for name, m in made.items() if isinstance(m, Metric)
        ]
        if metrics:
            _replace(reduce(DataFrame.unionByName, metrics), f"{folder}/metrics", key)
        for name, result in made.items():
            if not isinstance(result, Metric):
                _replace(result, f"{folder}/tables/{name}", key)
    finally:
        release(kept)
    return key


def _replace(frame: DataFrame, path: str, key: str) -> None:
    """The key has a directory of its own, which is overwritten as a whole."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/filter_key={quote(key, safe='')}")

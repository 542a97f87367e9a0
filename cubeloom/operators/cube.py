"""Cube queries that do not count twice, and the series built on them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import dense_index

MAX_CELLS = 1_000_000  # fixed value: cells allowed in one plain request


# ---- totals -------------------------------------------------------------


def pin_totals(facts: DataFrame, totals: dict[str, str], targets: tuple[str, ...] = ()) -> DataFrame:
    """Keep the total row of every dimension but ``targets``, whose total row is dropped."""
    keep = [F.col(c) != t if c in targets else F.col(c) == t for c, t in totals.items()]
    return facts.where(reduce(lambda a, b: a & b, keep))


def leaves_only(facts: DataFrame, totals: dict[str, str]) -> DataFrame:
    """Rows without any in-line total; they may be summed freely."""
    return pin_totals(facts, totals, tuple(totals))


def pin_totals_by_table(facts: DataFrame, totals: DataFrame, columns: list[str], targets: list[str]) -> DataFrame:
    """As ``pin_totals`` over many tables; ``totals`` is ``(table_id, column_name, code)``.

    A column without a total code in a table is left alone there.
    """
    wide = totals.groupBy("table_id").agg(
        *[F.max(F.when(F.col("column_name") == c, F.col("code"))).alias(f"_total_{c}") for c in columns]
    )
    joined = facts.join(wide, "table_id", "left")
    for c in columns:
        is_total = F.col(c) == F.col(f"_total_{c}")
        joined = joined.where(F.col(f"_total_{c}").isNull() | (~is_total if c in targets else is_total))
    return joined.drop(*[f"_total_{c}" for c in columns])


def additivity_check(facts: DataFrame, column: str, total: str, keys: list[str]) -> DataFrame:
    """Stated total against the sum of its parts, both from one pass."""
    is_total = F.col(column) == total
    return (
        facts.groupBy(*keys)
        .agg(
            F.sum(F.when(is_total, F.col("indhold"))).alias("stated"),
            F.sum(F.when(~is_total, F.col("indhold"))).alias("parts"),
        )
        .withColumn("difference", F.abs(F.col("stated") - F.col("parts")))
    )


# ---- aggregates ---------------------------------------------------------


def conditional_share(facts: DataFrame, keys: list[str], column: str, part: str, whole: str) -> DataFrame:
    """Percentage of ``part`` in ``whole``; null where the whole is zero or absent."""
    sums = facts.groupBy(*keys).agg(
        F.sum(F.when(F.col(column) == part, F.col("indhold"))).alias("part"),
        F.sum(F.when(F.col(column) == whole, F.col("indhold"))).alias("whole"),
    )
    return sums.withColumn("share", F.try_divide(F.col("part").cast("double") * 100, F.col("whole").cast("double")))


def net_change(facts: DataFrame, keys: list[str], column: str, plus: str) -> DataFrame:
    """Measure of ``plus`` counted up, of every other code counted down."""
    signed = F.when(F.col(column) == plus, F.col("indhold")).otherwise(-F.col("indhold"))
    return facts.groupBy(*keys).agg(F.sum(signed).alias("net"))


def band(column: Column, width: int, top: int) -> Column:
    """``0-4``, ``5-9`` and so on, then ``top+``."""
    low = (F.floor(column / width) * width).cast("int")
    return F.when(column >= top, F.lit(f"{top}+")).otherwise(
        F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))
    )


def code_shape(
    column: str,
    length: int | None = None,
    like: str | None = None,
    not_like: str | None = None,
    among: tuple[str, ...] | None = None,
    not_among: tuple[str, ...] | None = None,
) -> Column:
    """Filter on how codes are written; all given conditions hold together."""
    c = F.col(column)
    tests = []
    if length is not None:
        tests.append(F.length(c) == length)
    if like is not None:
        tests.append(c.like(like))
    if not_like is not None:
        tests.append(~c.like(not_like))
    if among is not None:
        tests.append(c.isin(*among))
    if not_among is not None:
        tests.append(~c.isin(*not_among))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def disambiguate_rows(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Larger and smaller of the rows that share a key."""
    return facts.groupBy(*keys).agg(
        F.max("indhold").alias("larger"), F.min("indhold").alias("smaller"), F.count(F.lit(1)).alias("n")
    )


def category_ratio(facts: DataFrame, keys: list[str], column: str, upper: str, lower: str) -> DataFrame:
    """Ratio of two categories of one dimension."""
    picked = facts.groupBy(*keys).agg(
        F.max(F.when(F.col(column) == upper, F.col("indhold"))).alias("upper"),
        F.max(F.when(F.col(column) == lower, F.col("indhold"))).alias("lower"),
    )
    return picked.withColumn("ratio", F.try_divide(F.col("upper").cast("double"), F.col("lower").cast("double")))


def pivot_bands(facts: DataFrame, row: str, column: str, codes: list[str]) -> DataFrame:
    """Rows by columns; the codes are given, so no pass is spent on finding them."""
    return facts.groupBy(row).pivot(column, codes).agg(F.sum("indhold"))


def indicator_correlation(left: DataFrame, right: DataFrame, keys: list[str], over: list[str]) -> DataFrame:
    """Correlation over ``keys`` of two measures, one value per ``over``."""
    both = left.withColumnRenamed("indhold", "a").join(right.withColumnRenamed("indhold", "b"), [*over, *keys])
    return both.groupBy(*over).agg(
        F.corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("correlation"), F.count(F.lit(1)).alias("n")
    )


# ---- series -------------------------------------------------------------


def with_change(series: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Add ``previous`` and the ratio ``change``. Series are summed, so one holds one row per period."""
    before = Window.partitionBy(*keys).orderBy(period)
    added = series.withColumn("previous", F.lag(value).over(before))
    now, then = F.col(value).cast("double"), F.col("previous").cast("double")
    return added.withColumn("change", F.try_divide(now - then, then))


def latest_with_change(series: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """The last period of every series with its value and change."""
    changed = with_change(series, keys, period, value)
    last = F.max_by(F.struct(period, value, "previous", "change"), period).alias("r")
    return changed.groupBy(*keys).agg(last).select(*keys, "r.*")


def indexed_series(series: DataFrame, keys: list[str], period: str, value: str, base: str | None = None) -> DataFrame:
    """Series as an index, 100 at ``base`` or at each series' first period."""
    chosen = F.min_by(value, period) if base is None else F.max(F.when(F.col(period) == base, F.col(value)))
    bases = series.groupBy(*keys).agg(chosen.alias("_base"))
    ratio = F.try_divide(F.col(value).cast("double") * 100, F.col("_base").cast("double"))
    return series.join(bases, keys).withColumn("index_value", ratio).drop("_base")


def top_bottom_n(rows: DataFrame, keys: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The ``n`` largest and ``n`` smallest of each group, with side and rank.

    ``row_number() <= n`` lets Spark cut every partition to ``n`` rows per group
    before the shuffle, so a very large group does not travel.
    """
    sides = []
    for side, order in (("top", F.desc(value)), ("bottom", F.asc(value))):
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie)))
        sides.append(ranked.where(F.col("rank") <= n).withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


def union_periods(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, columns by name; a column a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ---- cube requests ------------------------------------------------------


def selects(column: Column, choice: str) -> Column:
    """One selected value: ``*``, a wildcard such as ``*K1``, a code, or bounds ``>=a<=b``."""
    bounds = re.findall(r"(>=|<=|>|<)([^<>=]+)", choice)
    if bounds:
        ops = {">=": column.__ge__, "<=": column.__le__, ">": column.__gt__, "<": column.__lt__}
        return reduce(lambda a, b: a & b, [ops[op](F.lit(code)) for op, code in bounds])
    if "*" in choice:
        return column.rlike("^" + ".*".join(re.escape(part) for part in choice.split("*")) + "$")
    return column == choice


def select_codes(codes: DataFrame, column: str, choices: list[str]) -> DataFrame:
    """Rows whose code any of the choices selects; choices do not limit each other."""
    return codes.where(reduce(lambda a, b: a | b, [selects(F.col(column), c) for c in choices]))


NTH_RULE = re.compile(r"^([+-]|first|last)?\((?:(-?\d*)n)?\s*([+-]?\d+)?\)$")


def nth_periods(periods: DataFrame, rules: list[str]) -> DataFrame:
    """Periods picked by position: ``(1)`` latest, ``(-n+3)`` latest three, ``-(1)`` oldest.

    ``an+b`` picks the positions it reaches for n = 0, 1, 2, ... Positions count
    from the latest unless the rule starts with ``-`` or ``first``.
    """
    sizes = periods.groupBy("table_id").agg((F.max("pos") + 1).alias("_n"))
    joined = periods.join(sizes, "table_id")
    tests = []
    for rule in rules:
        found = NTH_RULE.match(rule.replace(" ", ""))
        if not found:
            raise ValueError(f"not a period rule: {rule}")
        end, step, offset = found.groups()
        place = F.col("pos") + 1 if end in ("-", "first") else F.col("_n") - F.col("pos")
        a = 0 if step is None else int({"": "1", "-": "-1"}.get(step, step))
        b = int(offset or 0)
        if a == 0:
            tests.append(place == b)
        else:
            gap = place - b
            tests.append((F.pmod(gap, F.lit(abs(a))) == 0) & ((gap >= 0) if a > 0 else (gap <= 0)))
    return joined.where(reduce(lambda x, y: x | y, tests)).select("table_id", "pos", "tid")


def code_arithmetic(
    facts: DataFrame, keys: list[str], column: str, operation: str, codes: list[str], new_code: str
) -> DataFrame:
    """``sum`` over codes, or ``subtract``, ``multiply``, ``divide`` of exactly two, as a new code."""
    if operation != "sum" and len(codes) != 2:
        raise ValueError(f"{operation} takes exactly two codes")
    chosen = facts.where(F.col(column).isin(*codes))
    if operation == "sum":
        out = chosen.groupBy(*keys).agg(F.sum("indhold").alias("indhold"))
    else:
        pair = chosen.groupBy(*keys).agg(
            *[F.sum(F.when(F.col(column) == c, F.col("indhold"))).cast("double").alias(n) for c, n in zip(codes, "ab")]
        )
        a, b = F.col("a"), F.col("b")
        value = {"subtract": a - b, "multiply": a * b, "divide": F.try_divide(a, b)}[operation]
        out = pair.select(*keys, value.alias("indhold"))
    return out.withColumn(column, F.lit(new_code))


def percent_of_base(
    facts: DataFrame, keys: list[str], column: str, base: str | None = None, per: int = 100
) -> DataFrame:
    """Share of all chosen values of ``column``, or of one base value, inside each key.

    The denominators are an aggregate joined back, not a window, so a long key
    is never held in one task.
    """
    whole = F.sum("indhold") if base is None else F.sum(F.when(F.col(column) == base, F.col("indhold")))
    bases = facts.groupBy(*keys).agg(whole.alias("_base"))
    ratio = F.try_divide(F.col("indhold").cast("double") * per, F.col("_base").cast("double"))
    return facts.join(bases, keys).withColumn("share", ratio).drop("_base")


def add_as_new_value(shares: DataFrame, content: str, original: str, computed: str) -> DataFrame:
    """Original and computed values as rows, told apart by the column ``content``."""
    both = F.explode(
        F.array(
            F.struct(F.lit(original).alias("k"), F.col("indhold").cast("double").alias("v")),
            F.struct(F.lit(computed).alias("k"), F.col("share").alias("v")),
        )
    )
    rest = [c for c in shares.columns if c not in ("indhold", "share")]
    return shares.select(*rest, both.alias("b")).select(*rest, F.col("b.k").alias(content), F.col("b.v").alias("indhold"))


def densify_cube(facts: DataFrame, columns: list[str], withheld: DataFrame | None = None) -> DataFrame:
    """Every combination of the codes in use; an absent combination is 0.

    The grid is laid out by number: codes are numbered per column, each row
    counts through the next column's numbers and looks its code up by equality.
    ``withheld`` holds combinations that are present without a number; they stay null.
    """
    grid = facts.select(columns[0]).distinct()
    for column in columns[1:]:
        numbered = dense_index(facts, column, "_i")
        last = numbered.agg(F.max("_i")).scalar()
        grid = grid.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).join(numbered, "_i").drop("_i")
    full = grid.join(facts.select(*columns, "indhold"), columns, "left")
    if withheld is None:
        return full.withColumn("indhold", F.coalesce("indhold", F.lit(0)))
    held = withheld.select(*columns).distinct().withColumn("_held", F.lit(True))
    filled = F.when(F.col("_held").isNull(), F.coalesce("indhold", F.lit(0))).otherwise(F.col("indhold"))
    return full.join(held, columns, "left").withColumn("indhold", filled).drop("_held")


def cell_estimate(selected: DataFrame) -> DataFrame:
    """Cells of a request: product of the selected code counts times the number of fields.

    ``selected`` is ``(table_id, column_name, code)``; the measure is one more field.
    """
    counts = selected.groupBy("table_id", "column_name").agg(F.count_distinct("code").alias("n"))
    per_table = counts.groupBy("table_id").agg(
        F.round(F.product("n")).cast("bigint").alias("rows"), (F.count(F.lit(1)) + 1).alias("fields")
    )
    cells = F.col("rows") * F.col("fields")
    return per_table.withColumns({"cells": cells, "allowed": cells <= MAX_CELLS})

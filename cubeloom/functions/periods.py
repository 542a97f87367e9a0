"""Period codes: frequency, form, start date, half-open ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code shapes in the order they are tried, and the number of
# latest periods that are fetched again because they may have been revised.
FREQUENCY_SHAPES = {
    "daily": r"^\d{4}M\d{2}D\d{2}$",
    "weekly": r"^\d{4}U\d{2}$",
    "monthly": r"^\d{4}M\d{2}$",
    "quarterly": r"^\d{4}K[1-4]$",
    "half_yearly": r"^\d{4}H[12]$",
    "yearly": r"^\d{4}$",
}
REVISION_WINDOW = {
    "daily": 7,
    "weekly": 4,
    "monthly": 3,
    "quarterly": 2,
    "half_yearly": 2,
    "yearly": 2,
    "other": 2,
}
FIRST_YEAR, LAST_YEAR = 1700, 2150  # both exclusive

RANGE = "struct<lo:int,hi:int>"


def frequency(code: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, shape in FREQUENCY_SHAPES.items():
        out = out.when(code.rlike(shape), F.lit(name))
    return out.otherwise("other")


def revision_window(freq: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, size in REVISION_WINDOW.items():
        out = out.when(freq == name, F.lit(size))
    return out


def period_form(code: Column) -> Column:
    """How a series is written, judged from one of its codes."""
    year = F.when(code.rlike(r"^\d+$"), code.try_cast("bigint"))
    return (
        F.when(code.contains("K"), "quarter")
        .when(code.contains("M") & code.contains("D"), "day")
        .when(code.contains("H"), "half")
        .when(code.contains("M"), "month")
        .when(code.contains(":"), "span")
        .when((year > FIRST_YEAR) & (year < LAST_YEAR), "year")
        .otherwise("text")
    )


# How a code must look under each dated form.
DATED_SHAPES = {
    "quarter": r"\d{4}K[1-4]",
    "day": r"\d{4}M\d{1,2}D\d{1,2}",
    "half": r"\d{4}H[12]",
    "month": r"\d{4}M\d{1,2}",
    "year": r"\d{4}",
}


DATE_FORMS = tuple(DATED_SHAPES)


def period_date(code: Column, form: Column) -> Column:
    """First day of the period, null where the code does not fit the form."""
    shapes = "|".join(f"{name} {shape}" for name, shape in DATED_SHAPES.items())
    fits = F.concat(form, F.lit(" "), code).rlike(f"^({shapes})$")
    part = F.nullif(F.regexp_extract(code, r"^\d{4}[KMH](\d{1,2})", 1), F.lit("")).cast("int")
    month = F.coalesce(
        part * F.when(form == "quarter", 3).when(form == "half", 6).otherwise(1)
        - F.when(form == "quarter", 2).when(form == "half", 5).otherwise(0),
        F.lit(1),
    )
    day = F.coalesce(F.nullif(F.regexp_extract(code, r"D(\d{1,2})$", 1), F.lit("")), F.lit("1"))
    # through text: an impossible day gives null where make_date would fail
    iso = F.concat_ws("-", F.substring(code, 1, 4), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(fits, F.try_to_date(iso, "yyyy-MM-dd"))


def int_range(text: Column) -> Column:
    """``20-24`` to [20, 25); ``100-`` and ``85OV`` to [85, open). Null if it does not fit."""
    shape = r"^\s*(\d+)\s*-\s*(\d*)\s*$"
    plain = F.replace(text, F.lit("OV"), F.lit("-"))
    lo = F.nullif(F.regexp_extract(plain, shape, 1), F.lit("")).try_cast("int")
    top = F.regexp_extract(plain, shape, 2)
    hi = F.when(top != "", top.try_cast("int") + 1)
    fits = lo.isNotNull() & ((top == "") | (hi.isNotNull() & (lo < hi)))
    return F.when(fits, F.struct(lo.alias("lo"), hi.alias("hi")))


def int_range_strict(text: Column) -> Column:
    """As ``int_range``, but text that does not fit ends the query."""
    got = int_range(text)
    bad = text.isNotNull() & got.isNull()
    return F.when(~bad, got).otherwise(
        F.when(bad, F.raise_error(F.concat(F.lit("not an integer range: "), text)).cast(RANGE))
    )


def period_span(code: Column, form: Column) -> Column:
    """``2021:2023`` to [2021, 2024), null for every other form."""
    return F.when(form == "span", int_range(F.replace(code, F.lit(":"), F.lit("-"))))


def range_text(value: Column) -> Column:
    """Canonical text of a half-open range."""
    upper = F.coalesce(value["hi"].cast("string"), F.lit(""))
    return F.when(
        value.isNotNull(), F.concat(F.lit("["), value["lo"].cast("string"), F.lit(","), upper, F.lit(")"))
    )


def parse_range_text(text: Column) -> Column:
    """Inverse of ``range_text``."""
    shape = r"^\s*\[\s*(-?\d+)\s*,\s*(-?\d+)?\s*\)\s*$"
    lo = F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).try_cast("int")
    hi = F.nullif(F.regexp_extract(text, shape, 2), F.lit("")).try_cast("int")
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def contains_point(value: Column, point: Column) -> Column:
    return (value["lo"] <= point) & (value["hi"].isNull() | (point < value["hi"]))


def overlaps(a: Column, b: Column) -> Column:
    return (a["hi"].isNull() | (b["lo"] < a["hi"])) & (b["hi"].isNull() | (a["lo"] < b["hi"]))


def period_text(code: Column, form: Column, day: Column, span: Column) -> Column:
    """The text a stored period has: ISO date, range text, or the code itself."""
    return F.when(form.isin(*DATE_FORMS), day.cast("string")).when(form == "span", range_text(span)).otherwise(code)

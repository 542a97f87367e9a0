"""Text functions: column names, value lists, excerpts, number display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters replaced in column names.
LETTERS = {"å": "a", "ø": "o", "æ": "ae"}


def plain_name(name: str) -> str:
    name = name.lower()
    for letter, plain in LETTERS.items():
        name = name.replace(letter, plain)
    return name


def plain_name_column(name: Column) -> Column:
    """``plain_name`` for names held as data."""
    out = F.lower(name)
    for letter, plain in LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def _rounded(value: Column, places: int) -> Column:
    # on the decimal form, half to even, as the display it matches
    return F.bround(value.cast("decimal(38,12)"), places)


def _signed(value: Column, rounded: Column, shown: Column) -> Column:
    """A small negative keeps its sign when it rounds to zero."""
    return F.when((value < 0) & (rounded == 0), F.concat(F.lit("-"), shown)).otherwise(shown)


def _fixed(value: Column, places: int) -> Column:
    rounded = _rounded(value, places)
    return _signed(value, rounded, F.format_string(f"%.{places}f", rounded.cast("double")))


def _whole(value: Column) -> Column:
    rounded = _rounded(value, 0)
    return _signed(value, rounded, F.format_number(rounded, 0))


def abbreviated(value: Column) -> Column:
    """K, M and B with one decimal; below a thousand a whole number."""
    size = F.abs(value)
    return (
        F.when(size >= 1e9, F.concat(_fixed(value / 1e9, 1), F.lit("B")))
        .when(size >= 1e6, F.concat(_fixed(value / 1e6, 1), F.lit("M")))
        .when(size >= 1e3, F.concat(_fixed(value / 1e3, 1), F.lit("K")))
        .otherwise(_whole(value))
    )


def format_value(value: Column, fmt: Column) -> Column:
    """``currency``, ``percent`` or plain number. Text is shown as it is by the caller."""
    return (
        F.when(fmt == "currency", F.concat(abbreviated(value), F.lit(" kr.")))
        .when(fmt == "percent", F.concat(_fixed(value * 100, 1), F.lit("%")))
        .otherwise(abbreviated(value))
    )


def change_text(change: Column) -> Column:
    """``↑ +12.0%`` or ``↓ -3.1%``; null stays null."""
    shown = F.concat(_fixed(change * 100, 1), F.lit("%"))
    return F.when(change >= 0, F.concat(F.lit("↑ +"), shown)).when(change < 0, F.concat(F.lit("↓ "), shown))


def value_list_text(values: Column, most: int = 10, ends: int = 5, size: Column | None = None) -> Column:
    """All values if at most ``most``, else the first and last ``ends``.

    ``size`` is the length of the whole list where ``values`` holds only its ends.
    """
    shown = F.concat(
        F.array_join(F.slice(values, 1, ends), ", "), F.lit(" ... "), F.array_join(F.slice(values, -ends, ends), ", ")
    )
    return F.when((F.size(values) if size is None else size) <= most, F.array_join(values, ", ")).otherwise(shown)


def excerpt(text: Column, size: int) -> Column:
    """White space collapsed, cut at ``size`` with ``...``; ``_None_`` when nothing is left."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    cut = F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, size), F.lit("...")))
    return F.when(F.coalesce(flat, F.lit("")) == "", "_None_").otherwise(cut)


def truncated(text: Column, size: int) -> Column:
    """Cut at ``size`` with the total length noted."""
    note = F.format_string("... (%d total chars)", F.length(text))
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size), note))

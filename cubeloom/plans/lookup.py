"""Work per distinct code instead of per row.

Codes repeat: a column of a fact table has few of them, whatever the number of
rows. What a code means is worked out once per code, stored, and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_codes(df: DataFrame, on: list[str], pos: str | None = None) -> DataFrame:
    """Distinct ``on`` values, with the first position of each where there is one."""
    if pos is None:
        return df.select(*on).distinct()
    return df.groupBy(*on).agg(F.min(pos).alias("_pos"))


def join_lookup(df: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with the other columns of ``lookup``; null codes find the entry of null."""
    named = lookup.select(*[F.col(c).alias(f"_key_{c}") if c in on else F.col(c) for c in lookup.columns])
    same: Column = reduce(lambda a, b: a & b, [df[c].eqNullSafe(named[f"_key_{c}"]) for c in on])
    return df.join(named, same, "left").drop(*[f"_key_{c}" for c in on])

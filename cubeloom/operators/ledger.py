"""Usage ledger: amounts, posting once, balances, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

USAGE_COUNTS = ["requests", "input_tokens", "cache_write_tokens", "cache_read_tokens", "output_tokens"]


def charge_amounts(usage: DataFrame, rate: Column) -> DataFrame:
    """Add ``amount``: cost times rate, two decimals, half up. Rows without any usage are dropped."""
    used = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in USAGE_COUNTS if c in usage.columns]) > 0
    cost = F.col("usd_cost").cast("decimal(18,8)")
    amount = F.round(cost * rate.cast("decimal(12,6)"), 2).cast("decimal(12,2)")
    return usage.where(used).withColumn("amount", amount)


def post_once(charges: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key; a null key is shared with nobody, so each row without a key stays.

    A minimum per key is combined before the shuffle; a window is not.
    """
    rest = [c for c in charges.columns if c != key]
    first = F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_first")
    keyed = charges.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, F.col("_first._row.*"))
    return keyed.unionByName(charges.where(F.col(key).isNull()).select(key, *rest))


def accepted_credits(credits: DataFrame, keys: tuple[str, str], order: str) -> DataFrame:
    """Credits taken in order, each refused if an accepted one shares either key.

    A refused credit blocks nothing, so this is no plain "first per key". In each
    round a credit that is the earliest left at both of its keys is accepted and
    what shares a key with it is refused; the rest goes on. The result is that
    of the sequential rule. Rounds work on minima per key, so a key that holds
    many credits costs no more than others. Where each credit depends on the one
    before, a chain of n credits takes n / 2 rounds by the nature of the rule.
    A null key is shared with nobody. ``order`` is unique.
    """
    first, second = keys
    named = credits.select(F.col(first).alias("_a"), F.col(second).alias("_b"), F.col(order).alias("_o"))
    free = named.where("_a is null and _b is null").select("_o")
    # of credits with the same two keys only the earliest can be accepted
    left = named.where("_a is not null or _b is not null").groupBy("_a", "_b").agg(F.min("_o").alias("_o"))
    accepted = free
    while True:
        left = stored(left, "credits")
        low_a = left.where("_a is not null").groupBy("_a").agg(F.min("_o").alias("_low_a"))
        low_b = left.where("_b is not null").groupBy("_b").agg(F.min("_o").alias("_low_b"))
        earliest = F.coalesce(F.col("_o") == F.col("_low_a"), F.lit(True)) & F.coalesce(F.col("_o") == F.col("_low_b"), F.lit(True))
        marked = left.join(low_a, "_a", "left").join(low_b, "_b", "left").select("_a", "_b", "_o", earliest.alias("_won"))
        marked = stored(marked, "round")
        won, lost = marked.where("_won"), marked.where("not _won")
        accepted = accepted.unionByName(won.select("_o"))
        if lost.isEmpty():
            break
        left = lost.join(won.select("_a").distinct(), "_a", "left_anti").join(won.select("_b").distinct(), "_b", "left_anti")
        left = left.select("_a", "_b", "_o")
    return credits.join(accepted.select(F.col("_o").alias(order)), order, "left_semi")


def balances(charges: DataFrame, credits: DataFrame) -> DataFrame:
    """Credits less charges per user, and whether anything is left."""
    moves = credits.select("user_id", F.col("amount")).unionByName(charges.select("user_id", (-F.col("amount")).alias("amount")))
    return moves.groupBy("user_id").agg(F.sum("amount").alias("balance")).withColumn("positive", F.col("balance") > 0)


def upsert_rows(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with ``new`` on top: only the columns ``new`` has are changed, also to null.

    A key is unique on each side.
    """
    columns = existing.columns
    supplied = [c for c in new.columns if c not in keys]
    incoming = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in supplied]).withColumn("_in", F.lit(True))
    merged = existing.join(incoming, keys, "full_outer")
    value = {
        c: F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in supplied else F.col(c) for c in columns
    }
    return merged.select(*[v.alias(c) for c, v in value.items()])

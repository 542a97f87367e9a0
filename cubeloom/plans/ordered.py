"""Running values over very long ordered groups.

A plain window keeps one group in one task, so a key that holds a third of
all rows ends up on one core. Here a group is cut into buckets along its
order. Each bucket is scanned on its own, a small summary row per bucket is
carried forward, and the two are added up. The result equals the plain
window; the largest task holds one bucket or one group's bucket summaries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

BUCKET_ROWS = 1 << 16
_BUCKET = "_bucket"


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    inclusive: bool = True,
    depth: int = 1,
) -> DataFrame:
    """Add running sums and last non-null values to ``df``.

    ``bucket`` must not decrease along ``order``. ``keys`` must not be null.
    With ``inclusive=False`` the row itself is left out. Where ``order`` has
    wide gaps, a group may have nearly as many buckets as rows; ``depth=2``
    then carries the summaries on in buckets of their own.
    """
    sums, lasts = sums or {}, lasts or {}
    slot = f"{_BUCKET}{depth}"
    staged = df.withColumn(slot, bucket)

    def stamped(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order], value.alias("_v")))

    totals = staged.groupBy(*keys, slot).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(stamped(c)).alias(f"_t_{n}") for n, c in lasts.items()],
    )
    if depth > 1:
        carried = running(
            totals, keys, [slot], F.floor(F.col(slot) / BUCKET_ROWS),
            sums={f"_c_{n}": F.col(f"_t_{n}") for n in sums},
            lasts={f"_c_{n}": F.col(f"_t_{n}") for n in lasts},
            inclusive=False, depth=depth - 1,
        ).select(*keys, slot, *[f"_c_{n}" for n in (*sums, *lasts)])
    else:
        before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *keys,
            slot,
            *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
            *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in lasts],
        )
    # a group of one bucket has nothing to carry, so only long groups have rows here
    carries = reduce(lambda x, y: x | y, [F.col(f"_c_{n}").isNotNull() for n in (*sums, *lasts)])
    carried = carried.where(carries)
    inside = (
        Window.partitionBy(*keys, slot)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    out = staged.join(carried, [*keys, slot], "left")
    added = {
        n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
        for n, c in sums.items()
    }
    for n, c in lasts.items():
        local = F.last(stamped(c), ignorenulls=True).over(inside)
        added[n] = F.coalesce(local, F.col(f"_c_{n}"))["_v"]
    return out.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def stretches(df: DataFrame, keys: list[str], order: list[str], size: int, name: str, rows: int | None = None) -> DataFrame:
    """``df`` of ``size`` rows laid along ``keys`` and ``order`` in stretches of about ``rows`` rows, with the number of its stretch.

    Spark draws the bounds from quantiles, so gaps do not matter: many short
    groups share a stretch and a long one gets as many as it needs. The numbers
    rise along the order and serve ``running`` as buckets. Written once, as two
    passes must see the same bounds.
    """
    parts = max(1, -(-size // (rows or BUCKET_ROWS)))
    laid = df.repartitionByRange(parts, *keys, *order).withColumn(name, F.spark_partition_id())
    return stored(laid, "stretches")


def row_numbers(df: DataFrame, keys: list[str], pos: str, name: str) -> DataFrame:
    """1-based row number by the integer ``pos``, which is unique inside ``keys``."""
    return running(
        df,
        keys,
        [pos],
        F.floor(F.col(pos) / F.lit(BUCKET_ROWS)),
        sums={name: F.lit(1).cast("bigint")},
    )


def dense_index(df: DataFrame, column: str, name: str, buckets: int = 1024) -> DataFrame:
    """Distinct values of ``column`` numbered 0, 1, 2, ... without one global sort.

    Values are numbered inside hash buckets; the only ordered step over
    everything is the running total of ``buckets`` counts.
    """
    values = df.select(column).distinct().withColumn(_BUCKET, F.pmod(F.xxhash64(column), F.lit(buckets)))
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        values.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("_n"))
        .select(_BUCKET, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(_BUCKET).orderBy(column)
    return values.join(starts, _BUCKET).select(
        column, (F.col("_start") + F.row_number().over(inside) - 1).alias(name)
    )

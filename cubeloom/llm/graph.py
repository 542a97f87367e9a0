"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for every end of an edge, the smallest node reachable from it.

    ``edges`` has columns ``a`` and ``b``; nulls and loops are left out. Rounds of
    large-star and small-star turn every component into a star around its
    smallest node; their number grows with the logarithm of the longest chain.
    Smallest neighbours are aggregates, combined before the shuffle, and the join
    back to the edges has one row a node on its other side, so Spark can split a
    hub's edges over tasks. Each round is written to the shared folder.
    """
    ends = edges.where(F.col("a") != F.col("b"))
    ends = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(ends, "edges")
    while not _stars(current):
        current = stored(_small_star(_large_star(current)), "edges")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none. Then that is the smallest of its component."""
    both = edges.select(F.col("a").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("downs"))
    )
    each = both.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return each.where((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("downs") > 0)).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node it sees."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    others = edges.join(low, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.unionByName(low.select("a", F.col("low").alias("b"))).distinct()

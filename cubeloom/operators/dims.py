"""Classifications: codes, parents, keys, ancestors, roll-up.

Rows are ``dim_id, sekvens, kode, niveau, titel``; level 1 is the most
aggregated. A code may recur on another level, so the key of a node is
``(dim_id, kode, niveau)`` and its parent is one level up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import BUCKET_ROWS, running, stretches
from ..session import stored
from .clean import normalize_names

DIM_COLUMNS = ["kode", "niveau", "titel", "parent_kode"]


def code_decision(dims: DataFrame) -> DataFrame:
    """Per dimension: whether all codes are integers once dots are removed, without merging two codes."""
    number = F.replace("kode", F.lit("."), F.lit("")).try_cast("bigint")
    # one row per distinct code first, so a long dimension never meets in one task
    codes = dims.select("dim_id", "niveau", "kode", number.alias("n")).distinct()
    # a null code is no code: it makes the whole column stay text
    per_number = codes.groupBy("dim_id", "niveau", "n").agg(
        F.count(F.lit(1)).alias("same"), F.count_if(F.col("n").isNull()).alias("bad")
    )
    return per_number.groupBy("dim_id").agg(
        ((F.max("same") == 1) & (F.sum("bad") == 0)).alias("kode_is_int")
    )


def dim_code_to_int(dims: DataFrame) -> DataFrame:
    """Add ``kode_is_int`` and ``kode_int``; the text code is kept beside it."""
    number = F.replace("kode", F.lit("."), F.lit("")).try_cast("bigint")
    return dims.join(stored(code_decision(dims), "codes"), "dim_id").withColumn("kode_int", F.when(F.col("kode_is_int"), number))


def derive_parents(dims: DataFrame, bucket_width: int = BUCKET_ROWS) -> DataFrame:
    """Parent of each row from traversal order.

    It is the nearest earlier row one level up, unless a row of a still higher
    level lies between; null at level 1 or when that level is not open.
    ``bucket_width`` is the number of rows handled by one task; ``sekvens`` may
    have gaps of any size.
    """
    size, levels = dims.agg(F.count(F.lit(1)), F.max("niveau")).first()
    levels = int(levels or 1)
    if levels == 1:
        return dims.withColumn("parent_kode", F.lit(None).cast(dims.schema["kode"].dataType))
    seen = {f"_l{n}": F.when(F.col("niveau") == n, F.struct("sekvens", "kode")) for n in range(1, levels)}
    laid = stretches(dims, ["dim_id"], ["sekvens"], size, "_stretch", bucket_width)
    walked = running(laid, ["dim_id"], ["sekvens"], F.col("_stretch"), lasts=seen, inclusive=False)
    parent = F.when(F.lit(False), F.lit(None).cast(dims.schema["kode"].dataType))
    for n in range(2, levels + 1):
        near = F.col(f"_l{n - 1}")
        cuts = [F.col(f"_l{k}")["sekvens"] for k in range(1, n - 1)]
        cut = F.greatest(*cuts) if len(cuts) > 1 else (cuts[0] if cuts else F.lit(None).cast("bigint"))
        open_ = cut.isNull() | (near["sekvens"] > cut)
        parent = parent.when((F.col("niveau") == n) & open_, near["kode"])
    return walked.withColumn("parent_kode", parent).drop("_stretch", *seen)


def process_dim(
    dims: DataFrame,
    drop_level_one: tuple[str, ...] = (),
    bucket_width: int = BUCKET_ROWS,
) -> DataFrame:
    """Names, codes, parents, then ``kode, niveau, titel, parent_kode``; rows without a code go last.

    ``kode`` and ``parent_kode`` are text; ``kode_is_int`` says whether the
    stored form is an integer. ``drop_level_one`` names dimensions that lose
    their first level before anything else, so their level 2 has no parent.
    """
    df = normalize_names(dims)
    if drop_level_one:
        df = df.where(~(F.col("dim_id").isin(*drop_level_one) & (F.col("niveau") == 1)))
    if isinstance(df.schema["kode"].dataType, T.StringType):
        coded = dim_code_to_int(df)
        coded = coded.withColumn("kode", F.coalesce(F.col("kode_int").cast("string"), "kode"))
    else:
        coded = df.withColumn("kode_is_int", F.lit(True)).withColumn("kode", F.col("kode").cast("string"))
    return (
        derive_parents(coded, bucket_width)
        .where(F.col("kode").isNotNull())
        .select("dim_id", *DIM_COLUMNS, "kode_is_int")
    )


def dim_key_choice(dims: DataFrame) -> DataFrame:
    """``kode`` where it is unique in the dimension, else ``kode,niveau``."""
    per_code = dims.groupBy("dim_id", "kode").agg(F.count(F.lit(1)).alias("c"))
    return per_code.groupBy("dim_id").agg(
        F.when(F.max("c") == 1, "kode").otherwise("kode,niveau").alias("primary_key")
    )


def ancestor_closure(dims: DataFrame) -> DataFrame:
    """``(kode, niveau) -> every ancestor`` including itself at distance 0, each pair once.

    By doubling: jumps of n levels joined to all ancestors nearer than n give
    those at n to 2n - 1, and two jumps in a row are one of 2n, so the rounds
    grow with the logarithm of the depth. Each level is one up, so the loop
    ends, and the level in the key keeps equal codes apart.
    """
    key, end = ["dim_id", "kode", "niveau"], ["dim_id", "ancestor_kode", "ancestor_niveau"]
    nodes = stored(dims.select(*key, "parent_kode").distinct(), "nodes")
    several = not nodes.groupBy(*key).count().where(F.col("count") > 1).isEmpty()

    def onward(jumps: DataFrame, pairs: DataFrame) -> DataFrame:
        ends = pairs.select("dim_id", *[F.col(c).alias(f"ancestor_{c}") for c in key[1:]], *[F.col(c).alias(f"_{c}") for c in end[1:]])
        met = jumps.join(ends, end).select(*key, *[F.col(f"_{c}").alias(c) for c in end[1:]])
        # only a node with two parents reaches an ancestor by two ways
        return met.distinct() if several else met

    itself = nodes.select(*key, F.col("kode").alias("ancestor_kode"), F.col("niveau").alias("ancestor_niveau")).distinct()
    found = itself
    jumps = nodes.where("parent_kode is not null").select(
        *key, F.col("parent_kode").alias("ancestor_kode"), (F.col("niveau") - 1).alias("ancestor_niveau")
    )
    while True:
        further, twice = onward(jumps, found), stored(onward(jumps, jumps), "jumps")
        if twice.isEmpty():
            return found.unionByName(further)
        found, jumps = found.unionByName(stored(further, "ancestors")), twice


def hierarchy_rollup(facts: DataFrame, dims: DataFrame, column: str, from_level: int, to_level: int) -> DataFrame:
    """Measure of ``column`` summed at ``to_level`` by climbing parent by parent.

    Facts are summed per code before the first join, so the climb moves as many
    rows as the classification has codes.
    """
    per_code = facts.groupBy(F.col(column).cast("string").alias("_code")).agg(F.sum("indhold").alias("indhold"))
    node = dims.select(F.col("kode").cast("string").alias("_k"), "niveau", "titel", F.col("parent_kode").cast("string").alias("_p"))
    detail = node.where(F.col("niveau") == from_level)
    moved = per_code.join(detail, F.col("_code") == F.col("_k")).select("_k", "titel", "_p", "indhold")
    for level in range(from_level - 1, to_level - 1, -1):
        above = node.where(F.col("niveau") == level)
        moved = (
            moved.groupBy(F.col("_p").alias("_up"))
            .agg(F.sum("indhold").alias("indhold"))
            .join(above, F.col("_up") == F.col("_k"))
            .select("_k", "titel", "_p", "indhold")
        )
    return moved.groupBy(F.col("_k").alias("kode"), "titel").agg(F.sum("indhold").alias("indhold"))


def observed_levels(code_values: DataFrame, dims: DataFrame, links: DataFrame) -> DataFrame:
    """Levels present for each linked fact column, from distinct codes.

    ``code_values`` is ``(table_id, column_name, id)``; ``links`` is
    ``(table_id, column_name, dim_id)``. Codes are compared as text.
    """
    codes = code_values.select("table_id", "column_name", F.col("id").cast("string").alias("kode")).distinct()
    node = dims.select("dim_id", F.col("kode").cast("string").alias("kode"), "niveau").distinct()
    found = (
        codes.join(links.select("table_id", "column_name", "dim_id"), ["table_id", "column_name"])
        .join(node, ["dim_id", "kode"])
        .select("table_id", "column_name", "dim_id", "niveau")
        .distinct()
    )
    # the levels of one classification: a handful
    return found.groupBy("table_id", "column_name", "dim_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set("niveau")), lambda n: n.cast("string")), ",").alias("levels")
    )

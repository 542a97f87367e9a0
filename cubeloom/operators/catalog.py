"""The catalog: code lists, look-ups, table profiles, subjects, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_name_column, value_list_text
from ..session import stored
from .dims import ancestor_closure, observed_levels
from .joins import STORED_TYPES, dim_values_for_table, spark_family, stored_type
from .search import discover_links, fuzzy_top

INTEGER_TYPES = ("integer", "smallint", "bigint")
FLOAT_TYPES = ("double precision", "numeric", "real")
PERIOD_COLUMN = "tid"
MOST_SHOWN, ENDS_SHOWN = 20, 5  # fixed values


def dim_values(dims: DataFrame) -> DataFrame:
    """Distinct classification rows in the order they are listed."""
    rows = dims.select("dim_id", "kode", "niveau", "titel", "parent_kode").distinct()
    return rows.orderBy("dim_id", "niveau", "kode", F.col("parent_kode").asc_nulls_last())


def column_values(meta: DataFrame) -> DataFrame:
    """``(table_id, column_name, pos, id, text)`` of every variable of every table."""
    variables = meta.select("table_id", F.explode("variables").alias("v"))
    values = variables.select("table_id", plain_name_column(F.col("v.id")).alias("column_name"), F.posexplode("v.values").alias("pos", "x"))
    return values.select("table_id", "column_name", F.col("pos").cast("bigint").alias("pos"), F.col("x.id").alias("id"), F.col("x.text").alias("text"))


def write_column_values(values: DataFrame, path: str) -> None:
    """Code lists on disk, one directory per table; a table's new lists replace all its old ones."""
    (
        values.hint("rebalance", "table_id")
        .sortWithinPartitions("table_id", "column_name")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("table_id")
        .parquet(path)
    )


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value)``: distinct non-null values of several columns in one pass, as text."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return df.select(cells.alias("v")).select("v.*").where(F.col("value").isNotNull()).distinct()


def column_lookup(
    values: DataFrame,
    n: int = 5,
    query: str | None = None,
    for_table: str | None = None,
    used: DataFrame | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """First ``n`` codes of a list, or its ``n`` best matches for ``query``.

    ``values`` is ``(dim_id, kode, niveau, titel, parent_kode)`` of one
    classification or ``(pos, id, text)`` of one column. With ``for_table`` only
    codes that occur in that table remain, in the linked column or, without a link,
    in the one that fits best.
    """
    is_dim = "kode" in values.columns
    code, label = ("kode", "titel") if is_dim else ("id", "text")
    if for_table is not None:
        mine = links.where(F.col("table_id") == for_table).select("table_id", "dim_id", "column_name")
        asked = values.select(F.lit(for_table).alias("table_id"), "dim_id").distinct()
        unlinked = stored(asked.join(mine, ["table_id", "dim_id"], "left_anti"), "unlinked")
        guessed = discover_links(unlinked, used.where(F.col("table_id") == for_table), values)
        mine = mine.unionByName(guessed.where("column_name is not null").drop("rule"))
        values = dim_values_for_table(values, used, mine).drop("table_id")
    if query is None:
        order = ["niveau", "kode"] if is_dim else ["pos"]
        return values.orderBy(*order).limit(n).select(code, label)
    ranked = fuzzy_top(values.select(F.col(code).cast("string").alias("code"), F.col(label).alias("label")), [query], n)
    return ranked.select(F.col("code").alias(code), F.col("label").alias(label), "rank")


def typed_value_map(values: DataFrame, types: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Code lists with ids in the type of the stored column.

    If one id of a column does not fit, the whole column keeps text. The period
    and linked columns carry no map.
    """
    open_ = values.where(F.col("column_name") != PERIOD_COLUMN)
    if linked is not None:
        open_ = open_.join(linked.select("table_id", "column_name").distinct(), ["table_id", "column_name"], "left_anti")
    typed = open_.join(types.select("table_id", "column_name", "column_type"), ["table_id", "column_name"], "left")
    whole, real = F.col("column_type").isin(*INTEGER_TYPES), F.col("column_type").isin(*FLOAT_TYPES)
    as_int, as_real = F.col("id").try_cast("bigint"), F.col("id").try_cast("double")
    fits = F.when(whole, as_int.isNotNull()).when(real, as_real.isNotNull()).otherwise(F.lit(False))
    kinds = typed.groupBy("table_id", "column_name").agg(
        F.when(F.bool_and(fits & whole), "int").when(F.bool_and(fits & real), "float").otherwise("text").alias("id_kind")
    )
    kind = F.col("id_kind")
    return typed.join(kinds, ["table_id", "column_name"]).select(
        "table_id", "column_name", "pos", "id_kind",
        F.when(kind == "int", as_int).alias("id_int"),
        F.when(kind == "float", as_real).alias("id_float"),
        F.when(kind == "text", F.col("id")).alias("id_text"),
        "text",
    )


def _join_text_column(fact_type: Column, dim_type: Column, column: Column) -> Column:
    """``join_text`` for types held as data."""
    families = F.create_map(*[F.lit(x) for name in STORED_TYPES for x in (name, spark_family(stored_type(name)))])
    kinds = [F.coalesce(families[F.lower(F.trim(F.regexp_replace(t, r"\(.*\)", "")))], F.lit("other")) for t in (fact_type, dim_type)]

    def cast(kind: Column, partner: Column) -> Column:
        return F.when((kind != partner) & (kind != "text"), "::text").otherwise("")

    return F.concat(column, cast(*kinds), F.lit("=kode"), cast(*kinds[::-1]))


def value_texts(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """``id=text`` pairs of each code list on one line; of a long list its first and last ones.

    ``pos`` counts from 0 and ``sizes`` has ``n_values``, so the ends are known
    before codes are gathered and no list is gathered whole.
    """
    key, n, pos = ["table_id", "column_name"], F.col("n_values"), F.col("pos")
    shown = values.join(sizes, key).where((n <= MOST_SHOWN) | (pos < ENDS_SHOWN) | (pos >= n - ENDS_SHOWN))
    pair = F.concat(F.coalesce("id", F.lit("")), F.lit("="), F.coalesce("text", F.lit("")))
    gathered = shown.groupBy(*key).agg(F.max("n_values").alias("n"), F.array_sort(F.collect_list(F.struct("pos", pair.alias("pair")))).alias("pairs"))
    return gathered.select(*key, value_list_text(F.col("pairs.pair"), MOST_SHOWN, ENDS_SHOWN, size=F.col("n")).alias("value_text"))


def table_profile(
    meta: DataFrame, values: DataFrame, types: DataFrame, links: DataFrame, dim_types: DataFrame,
    dims: DataFrame, used: DataFrame, extents: DataFrame,
) -> DataFrame:
    """One row per column of every table: its values, a link or a period extent.

    ``types`` is ``(table_id, column_name, column_type)``, ``dim_types`` is
    ``(dim_id, kode_type)``, ``used`` the distinct codes in the facts, ``extents``
    the period extents. All tables are profiled by one set of joins.
    """
    columns = values.groupBy("table_id", "column_name").agg(F.count(F.lit(1)).alias("n_values"))
    described = links.join(dim_types, "dim_id", "left")
    levels = observed_levels(used, dims, links).select("table_id", "column_name", "levels")
    key = ["table_id", "column_name"]
    unlinked = values.where(F.col("column_name") != PERIOD_COLUMN).join(links.select(*key), key, "left_anti")
    joined = (
        columns.join(types, key, "left")
        .join(value_texts(unlinked, columns), key, "left")
        .join(described, key, "left")
        .join(levels, key, "left")
        .join(extents, "table_id", "left")
        .join(meta.select("table_id", F.col("text").alias("description"), "unit"), "table_id", "left")
    )
    is_link, is_period = F.col("dim_id").isNotNull(), F.col("column_name") == PERIOD_COLUMN
    kind = F.when(is_link, "link").when(is_period, "period").otherwise("values")
    join = F.when(is_link, _join_text_column(F.coalesce("column_type", F.lit("")), F.coalesce("kode_type", F.lit("")), F.col("column_name")))
    return joined.select(
        *key, "description", "unit", kind.alias("kind"),
        F.when(kind == "values", F.col("n_values")).alias("n_values"), "value_text",
        "dim_id", join.alias("join"), "join_override", "match_type", "note", "levels",
        F.when(is_period, F.col("min_tid")).alias("min_tid"),
        F.when(is_period, F.col("max_tid")).alias("max_tid"),
    )


def subject_paths(nodes: DataFrame, tables: DataFrame, root: str) -> DataFrame:
    """``(path, table_id)`` of every leaf that has tables, below ``root``.

    ``nodes`` is ``(id, parent_id, description)``, ``tables`` is ``(id, table_id)``.
    One join per level of the tree, until a level is empty; a node met before is
    not entered again. The root's own name is not in the path.
    """
    name = F.replace(F.lower("description"), F.lit(" "), F.lit("_"))
    tree = nodes.select("id", "parent_id", name.alias("part"))
    parents = tree.select(F.col("parent_id").alias("id")).where(F.col("id").isNotNull()).distinct()
    tree = stored(tree, "tree")
    level = stored(tree.where(F.col("parent_id") == root).withColumn("path", F.col("part")), "level")
    found = level
    while not level.isEmpty():
        above = level.select(F.col("id").alias("parent_id"), F.col("path").alias("_up"))
        below = tree.join(above, "parent_id").withColumn("path", F.concat_ws("/", "_up", "part"))
        level = stored(below.join(found.select("id"), "id", "left_anti").select(*found.columns), "level")
        found = found.unionByName(level)
    leaves = found.join(parents, "id", "left_anti")
    return leaves.join(tables, "id").select("path", "table_id")


def subject_listing(paths: DataFrame) -> DataFrame:
    """The two upper levels that have subjects below them."""
    parts = F.split("path", "/")
    deep = paths.where(F.size(parts) > 2)
    return deep.select(F.get(parts, F.lit(0)).alias("root"), F.get(parts, F.lit(1)).alias("mid")).distinct().orderBy("root", "mid")


def level1_coverage(
    used: DataFrame, dims: DataFrame, links: DataFrame, subjects: DataFrame
) -> DataFrame:
    """Top categories each table of a subject covers.

    One row per subject, table and category that any table of the subject
    covers on that classification; ``covered`` tells where tables differ.
    """
    code = dims.withColumn("kode", F.col("kode").cast("string")).withColumn("parent_kode", F.col("parent_kode").cast("string"))
    tops = ancestor_closure(code).where(F.col("ancestor_niveau") == 1).select("dim_id", "kode", F.col("ancestor_kode").alias("top"))
    covers = stored(
        used.join(links.select("table_id", "column_name", "dim_id"), ["table_id", "column_name"])
        .select("table_id", "dim_id", F.col("id").alias("kode"))
        .distinct()
        .join(tops, ["dim_id", "kode"])
        .select("table_id", "dim_id", "top")
        .distinct(),
        "covers",
    )
    mine = subjects.select("path", "table_id").distinct()
    linked = links.select("table_id", "dim_id").distinct()
    per_subject = covers.join(mine, "table_id").select("path", "dim_id", "top").distinct()
    asked = mine.join(linked, "table_id").join(per_subject, ["path", "dim_id"])
    return (
        asked.join(covers.withColumn("_hit", F.lit(True)), ["table_id", "dim_id", "top"], "left")
        .select("path", "table_id", "dim_id", "top", F.col("_hit").isNotNull().alias("covered"))
    )

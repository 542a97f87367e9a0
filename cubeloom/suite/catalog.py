"""Catalog, search and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, delta, search
from ..session import scratch_path, stored
from . import frames
from ._registry import query
from .cleaning import dims_clean
from .joins import fact_codes
from .views import view

view("column_lists", """
SELECT table_id, REPLACE(REPLACE(REPLACE(LOWER(variable), 'å', 'a'), 'ø', 'o'), 'æ', 'ae') AS column_name, pos, id, label AS text FROM meta_values
""")

view("column_types", """
SELECT table_id, column_name, CASE WHEN column_name = 'alder' THEN 'smallint' WHEN column_name = 'status' THEN 'integer'
       WHEN column_name = 'tid' THEN 'date' ELSE 'character varying' END AS column_type
FROM (SELECT DISTINCT table_id, column_name FROM column_lists)
""")

view("subject_nodes", """
SELECT '0' AS id, NULL AS parent_id, 'Root Bank' AS description, NULL AS tab FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'r' || r_regionkey, '0', r_name, NULL FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, REPLACE(n_name, '_', ' '), NULL FROM nation
UNION ALL SELECT DISTINCT 's' || c_nationkey || c_mktsegment, 'n' || c_nationkey, c_mktsegment, 'C' || (c_custkey // 10) FROM customer
""")

view("subject_tables", """
SELECT DISTINCT REPLACE(LOWER(r_name), ' ', '_') || '/' || LOWER(n_name) || '/' || LOWER(c_mktsegment) AS path, 'C' || (c_custkey // 10) AS table_id
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
""")


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table descriptions as stored documents; the catalog reads them several times."""
    return stored(frames.metadata(spark, sf_dir), "metadata")


@query("column_values", "SELECT table_id, column_name, pos, id, text FROM column_lists")
def column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "column-values")
    values = catalog.column_values(frames.metadata(spark, sf_dir))
    catalog.write_column_values(values, path)
    return spark.read.schema(values.schema).parquet(path)


@query(
    "distinct_values",
    """
    SELECT DISTINCT 'l_returnflag' AS column_name, l_returnflag AS value FROM lineitem
    UNION ALL SELECT DISTINCT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem
    UNION ALL SELECT DISTINCT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem
    """,
)
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.distinct_values(frames.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber", "l_suppkey"])


@query(
    "column_lookup",
    """
    SELECT kode, titel FROM (SELECT d.kode, d.titel, d.niveau FROM dims_linked d WHERE d.dim_id = 'geo' AND d.kode IN
      (SELECT id FROM fact_codes WHERE table_id = 'F2' AND column_name = 'omrade') ORDER BY d.niveau, d.kode LIMIT 7)
    """,
)
def column_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    geo = frames.dims_linked(spark, sf_dir).where(F.col("dim_id") == "geo")
    return catalog.column_lookup(
        geo, n=7, for_table="F2", used=fact_codes(spark, sf_dir), links=frames.fact_links(spark, sf_dir)
    )


@query(
    "column_lookup_inferred",
    """
    SELECT kode, titel FROM (SELECT d.kode, d.titel, d.niveau FROM dims_linked d WHERE d.dim_id = 'geo' AND d.kode IN
      (SELECT id FROM fact_codes WHERE table_id = 'F3' AND column_name = 'omrade') ORDER BY d.niveau, d.kode LIMIT 9)
    """,
)
def column_lookup_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without links: the column is found by its codes."""
    geo = frames.dims_linked(spark, sf_dir).where(F.col("dim_id") == "geo")
    links = frames.fact_links(spark, sf_dir).where(F.col("table_id") != "F3")
    return catalog.column_lookup(geo, n=9, for_table="F3", used=fact_codes(spark, sf_dir), links=links)


@query("column_lookup_fuzzy")
def column_lookup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = dims_clean(spark, sf_dir, "kn")
    return catalog.column_lookup(tree, n=5, query="smal rign")


FUZZY_QUERIES = ["smal ring", "bolt blue", "wdget", "large red", "green gear x"]


@query("fuzzy_lookup")
def fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = frames.table(spark, sf_dir, "part")
    labels = part.select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("label"))
    return search.fuzzy_top(labels, FUZZY_QUERIES, 5)


def _types(values: DataFrame) -> DataFrame:
    column = F.col("column_name")
    kind = F.when(column == "alder", "smallint").when(column == "status", "integer").when(column == "tid", "date").otherwise("character varying")
    return values.select("table_id", "column_name").distinct().withColumn("column_type", kind)


@query(
    "typed_value_map",
    """
    SELECT table_id, column_name, pos, CASE WHEN column_name = 'alder' THEN 'int' ELSE 'text' END AS id_kind,
           CASE WHEN column_name = 'alder' THEN CAST(id AS BIGINT) END AS id_int, CAST(NULL AS DOUBLE) AS id_float,
           CASE WHEN column_name <> 'alder' THEN id END AS id_text, text
    FROM column_lists WHERE column_name IN ('alder', 'status')
    """,
)
def typed_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = catalog.column_values(_metadata(spark, sf_dir))
    linked = values.select("table_id", F.lit("omrade").alias("column_name")).distinct()
    return catalog.typed_value_map(values, _types(values), linked)


@query(
    "table_profile",
    """
    SELECT v.table_id, v.column_name, 'description of ' || v.table_id AS description, 'kr.' AS unit,
      CASE v.column_name WHEN 'omrade' THEN 'link' WHEN 'status' THEN 'link' WHEN 'tid' THEN 'period' ELSE 'values' END AS kind,
      CASE WHEN v.column_name = 'alder' THEN COUNT(*) END AS n_values,
      CASE WHEN v.column_name = 'alder' THEN STRING_AGG(id || '=' || text, ', ' ORDER BY pos) END AS value_text,
      CASE v.column_name WHEN 'omrade' THEN 'segments' WHEN 'status' THEN 'states' END AS dim_id,
      CASE v.column_name WHEN 'omrade' THEN 'omrade=kode::text' WHEN 'status' THEN 'status::text=kode' END AS "join", CAST(NULL AS VARCHAR) AS join_override,
      CASE v.column_name WHEN 'omrade' THEN 'approx' WHEN 'status' THEN 'exact' END AS match_type, CASE WHEN v.column_name = 'omrade' THEN 'by segment' END AS note,
      CASE WHEN v.column_name = 'status' THEN CASE WHEN SUM(CASE WHEN id <> 'P' THEN 1 ELSE 0 END) > 0 THEN '1' END WHEN v.column_name = 'omrade' THEN CASE WHEN SUM(CASE WHEN id < 'C' THEN 1 ELSE 0 END) > 0 THEN '1' ELSE '' END
        || CASE WHEN SUM(CASE WHEN id < 'C' THEN 1 ELSE 0 END) > 0 AND SUM(CASE WHEN id >= 'C' THEN 1 ELSE 0 END) > 0 THEN ',' ELSE '' END
        || CASE WHEN SUM(CASE WHEN id >= 'C' THEN 1 ELSE 0 END) > 0 THEN '2' ELSE '' END END AS levels,
      CASE WHEN v.column_name = 'tid' THEN CAST(MIN(d) AS VARCHAR) END AS min_tid, CASE WHEN v.column_name = 'tid' THEN CAST(MAX(d) AS VARCHAR) END AS max_tid
    FROM (SELECT *, CASE WHEN column_name = 'tid' THEN MAKE_DATE(CAST(SUBSTR(id, 1, 4) AS BIGINT), CAST(SUBSTR(id, 6, 1) AS BIGINT) * 3 - 2, 1) END AS d FROM column_lists) v
    GROUP BY v.table_id, v.column_name
    """,
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = _metadata(spark, sf_dir)
    values = catalog.column_values(meta)
    entries = [("omrade", "segments", "approx", "by segment"), ("status", "states", "exact", None)]
    fields = ("column_name", "dim_id", "match_type", "note")
    linked = F.explode(F.array(*[F.struct(*[F.lit(v).cast("string").alias(f) for f, v in zip(fields, e)]) for e in entries]))
    links = meta.select("table_id", linked.alias("l")).select("table_id", "l.*", F.lit(None).cast("string").alias("join_override"))
    dim_types = spark.createDataFrame([("segments", "integer"), ("states", "character varying")], "dim_id string, kode_type string")
    segment = F.col("c_mktsegment")
    segments = frames.table(spark, sf_dir, "customer").select(segment).distinct().select(
        F.lit("segments").alias("dim_id"), segment.alias("kode"), F.when(segment < "C", 1).otherwise(2).alias("niveau")
    )
    states = frames.dims_linked(spark, sf_dir).where(F.col("dim_id") == "states").select("dim_id", "kode", "niveau")
    dims = stored(segments.unionByName(states), "dims")
    periods = values.where(F.col("column_name") == "tid").select("table_id", "pos", F.col("id").alias("tid"))
    extents = delta.period_extent(delta.clean_periods(periods, pos="pos"))
    return catalog.table_profile(meta, values, _types(values), links, dim_types, dims, values, extents)


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tree of regions, nations and segments, and the tables at its leaves."""
    region, nation = frames.table(spark, sf_dir, "region"), frames.table(spark, sf_dir, "nation")
    customer = frames.table(spark, sf_dir, "customer")
    root = spark.createDataFrame([("0", None, "Root Bank")], "id string, parent_id string, description string")
    upper = region.select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("0").alias("parent_id"), F.col("r_name").alias("description")
    )
    mid = nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"),
        F.replace("n_name", F.lit("_"), F.lit(" ")).alias("description"),
    )
    key = F.col("c_nationkey").cast("string")
    held = customer.select(key.alias("k"), "c_mktsegment", F.concat(F.lit("C"), F.floor(F.col("c_custkey") / 10).cast("string")).alias("t"))
    leaf_id = F.concat(F.lit("s"), F.col("k"), F.col("c_mktsegment")).alias("id")
    leaf = held.select(leaf_id, F.concat(F.lit("n"), F.col("k")).alias("parent_id"), F.col("c_mktsegment").alias("description")).distinct()
    return root.unionByName(upper).unionByName(mid).unionByName(leaf), held.select(leaf_id, F.col("t").alias("table_id")).distinct()


@query("subject_paths", "SELECT path, table_id FROM subject_tables")
def subject_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.subject_paths(*_nodes(spark, sf_dir), "0")


@query("subject_listing", "SELECT DISTINCT SPLIT_PART(path, '/', 1) AS root, SPLIT_PART(path, '/', 2) AS mid FROM subject_tables ORDER BY 1, 2")
def subject_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.subject_listing(catalog.subject_paths(*_nodes(spark, sf_dir), "0"))


@query(
    "level1_coverage",
    """
    WITH c AS (SELECT DISTINCT 'C' || (c_custkey // 10) AS table_id, CAST(81 + n_regionkey AS VARCHAR) AS top FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT a.path, a.table_id, 'geo' AS dim_id, t.top, c.table_id IS NOT NULL AS covered FROM (SELECT DISTINCT path, table_id FROM subject_tables) a
    JOIN (SELECT DISTINCT path, top FROM subject_tables s JOIN c ON c.table_id = s.table_id) t ON t.path = a.path
    LEFT JOIN c ON c.table_id = a.table_id AND c.top = t.top
    """,
)
def level1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of ten customers each under the subjects of their nations and segments; few have customers in every region."""
    table_id = F.concat(F.lit("C"), F.floor(F.col("c_custkey") / 10).cast("string"))
    area = (F.col("c_nationkey") + 101).cast("string")
    used = frames.table(spark, sf_dir, "customer").select(table_id.alias("table_id"), F.lit("omrade").alias("column_name"), area.alias("id")).distinct()
    links = used.select("table_id", "column_name", F.lit("geo").alias("dim_id")).distinct()
    dims = frames.dims_linked(spark, sf_dir).where(F.col("dim_id") == "geo")
    return catalog.level1_coverage(used, dims, links, catalog.subject_paths(*_nodes(spark, sf_dir), "0"))


@query(
    "discover_links",
    """
    SELECT table_id, dim_id, CASE dim_id WHEN 'statusser' THEN 'prefix' WHEN 'omraader' THEN 'name' WHEN 'segments' THEN 'codes' ELSE 'none' END AS rule,
           CASE dim_id WHEN 'statusser' THEN 'status' WHEN 'omraader' THEN 'omrade' WHEN 'segments' THEN 'omrade' END AS column_name
    FROM (SELECT DISTINCT table_id FROM column_lists) CROSS JOIN (SELECT UNNEST(['statusser', 'omraader', 'segments', 'zzz']) AS dim_id)
    """,
)
def discover_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = catalog.column_values(_metadata(spark, sf_dir))
    names = F.explode(F.array(*[F.lit(n) for n in ("statusser", "omraader", "segments", "zzz")]))
    requests = values.select("table_id").distinct().select("table_id", names.alias("dim_id"))
    segments = frames.table(spark, sf_dir, "customer").select(F.lit("segments").alias("dim_id"), F.col("c_mktsegment").alias("kode"))
    nations = frames.table(spark, sf_dir, "nation").select(F.lit("zzz").alias("dim_id"), F.col("n_name").alias("kode"))
    return search.discover_links(requests, values, segments.distinct().unionByName(nations))

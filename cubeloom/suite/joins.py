"""Joins, hierarchies, links and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import contains_point, parse_range_text, range_text
from ..operators import delta, dims, joins
from ..sources.links import parse_links
from ..session import stored
from . import frames
from ._registry import query
from .cleaning import dims_clean


def dbl(column: Column | str, name: str = "indhold") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("double").alias(name)


@query(
    "hierarchy_rollup",
    """
    SELECT t.kode, t.titel, CAST(SUM(f.indhold) AS DOUBLE) AS indhold FROM fact_clean f
    JOIN dim_geo d ON f.omrade = CAST(d.kode AS VARCHAR) AND d.niveau = 2
    JOIN dim_geo t ON t.kode = d.parent_kode AND t.niveau = 1 GROUP BY t.kode, t.titel
    """,
)
def hierarchy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dims.hierarchy_rollup(frames.fact_clean(spark, sf_dir), frames.dim_geo(spark, sf_dir), "omrade", 2, 1)
    return out.select(F.col("kode").cast("bigint").alias("kode"), "titel", dbl("indhold"))


@query(
    "hierarchy_rollup_deep",
    """
    SELECT top.kode, top.titel, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS indhold
    FROM lineitem
    JOIN (SELECT kode, parent_kode, SPLIT_PART(kode, '.', 3) AS pk FROM dims_clean WHERE dim_id = 'prod' AND niveau = 3) d ON CAST(l_partkey AS VARCHAR) = d.pk
    JOIN (SELECT * FROM dims_clean WHERE dim_id = 'prod' AND niveau = 2) m ON m.kode = d.parent_kode
    JOIN (SELECT * FROM dims_clean WHERE dim_id = 'prod' AND niveau = 1) top ON top.kode = m.parent_kode
    GROUP BY top.kode, top.titel
    """,
)
def hierarchy_rollup_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels: part to brand to type. Sums per part come first, then its code."""
    per_part = (
        frames.table(spark, sf_dir, "lineitem").groupBy("l_partkey")
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("indhold"))
    )
    tree = frames.part_tree(spark, sf_dir).where(F.col("niveau") == 3)
    code = F.concat_ws(".", "p_type", F.lpad(F.col("b").cast("string"), 2, "0"), F.col("p_partkey").cast("string"))
    coded = per_part.join(tree.select("p_partkey", code.alias("vare")), F.col("l_partkey") == F.col("p_partkey"))
    # stored before it is climbed, as a loaded classification is
    tree_dim = stored(dims_clean(spark, sf_dir, "prod"), "tree")
    return dims.hierarchy_rollup(coded.select("vare", "indhold"), tree_dim, "vare", 3, 1).select("kode", "titel", dbl("indhold"))


@query(
    "ancestor_closure",
    """
    SELECT dim_id, kode, niveau, kode AS ancestor_kode, niveau AS ancestor_niveau FROM dims_clean
    UNION ALL
    SELECT a.dim_id, a.kode, a.niveau, b.kode, b.niveau FROM dims_clean a JOIN dims_clean b ON b.dim_id = a.dim_id AND b.kode = a.parent_kode AND b.niveau = a.niveau - 1
    UNION ALL
    SELECT a.dim_id, a.kode, a.niveau, c.kode, c.niveau FROM dims_clean a
    JOIN dims_clean b ON b.dim_id = a.dim_id AND b.kode = a.parent_kode AND b.niveau = a.niveau - 1
    JOIN dims_clean c ON c.dim_id = b.dim_id AND c.kode = b.parent_kode AND c.niveau = b.niveau - 1
    """,
)
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.ancestor_closure(dims_clean(spark, sf_dir))


@query(
    "observed_levels",
    """
    SELECT table_id, column_name, dim_id, STRING_AGG(CAST(niveau AS VARCHAR), ',' ORDER BY niveau) AS levels FROM (
      SELECT DISTINCT l.table_id, l.column_name, l.dim_id, d.niveau FROM fact_links l
      JOIN fact_codes c ON c.table_id = l.table_id AND c.column_name = l.column_name JOIN dims_linked d ON d.dim_id = l.dim_id AND d.kode = c.id)
    GROUP BY table_id, column_name, dim_id
    """,
)
def observed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.observed_levels(fact_codes(spark, sf_dir), frames.dims_linked(spark, sf_dir), frames.fact_links(spark, sf_dir))


def fact_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in use, with the in-line total of the area column."""
    facts = frames.fact_tables(spark, sf_dir)
    used = joins.code_values(facts, ["omrade", "status"])
    tables = used.select("table_id").distinct()
    return used.unionByName(tables.select("table_id", F.lit("omrade").alias("column_name"), F.lit("0").alias("id")))


@query(
    "join_dim_level",
    """
    SELECT d.titel, CAST(SUM(f.indhold) AS DOUBLE) AS indhold FROM fact_cube f JOIN dim_geo d ON f.omrade = CAST(d.kode AS VARCHAR)
    WHERE d.niveau = 2 AND f.status = 'TOT' GROUP BY d.titel
    """,
)
def join_dim_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = frames.fact_cube(spark, sf_dir).where(F.col("status") == "TOT")
    named = joins.join_dim(cube, frames.dim_geo(spark, sf_dir), "omrade", level=2)
    return named.groupBy("titel").agg(dbl(F.sum("indhold")))


@query(
    "join_typed",
    """
    SELECT f.omrade, f.status, f.tid, d.niveau, d.titel, CAST(f.indhold AS DOUBLE) AS indhold
    FROM fact_cube f JOIN dim_geo d ON f.omrade = CAST(d.kode AS VARCHAR)
    """,
)
def join_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = joins.join_dim(frames.fact_cube(spark, sf_dir), frames.dim_geo(spark, sf_dir), "omrade")
    return named.select("omrade", "status", "tid", "niveau", "titel", dbl("indhold"))


@query(
    "join_padded",
    """
    SELECT d.titel, COUNT(*) AS n, CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS indhold FROM part
    JOIN (SELECT DISTINCT CAST(p_size AS BIGINT) AS kode, 5 AS niveau, 'size ' || p_size AS titel FROM part
          UNION SELECT DISTINCT CAST(p_size // 10 AS BIGINT), 4, 'sizes from ' || (p_size // 10) * 10 FROM part) d
      ON LPAD(CAST(d.kode AS VARCHAR), 6, '0') = LPAD(CAST(p_size AS VARCHAR), 6, '0') AND d.niveau = 5
    GROUP BY d.titel
    """,
)
def join_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sizes on level 5; the tens above them have codes that sizes have as well."""
    part = frames.table(spark, sf_dir, "part")
    size, ten = F.col("p_size"), F.floor(F.col("p_size") / 10)
    facts = part.select(F.lpad(size.cast("string"), 6, "0").alias("branche"), F.col("p_retailprice").cast("decimal(18,2)").alias("indhold"))
    each = part.select("p_size").distinct()
    sizes = each.select(size.cast("bigint").alias("kode"), F.lit(5).alias("niveau"), F.concat(F.lit("size "), size.cast("string")).alias("titel"))
    tens = each.select(ten.cast("bigint").alias("kode"), F.lit(4).alias("niveau"), F.concat(F.lit("sizes from "), (ten * 10).cast("string")).alias("titel"))
    joined = joins.join_padded(facts, sizes.unionByName(tens.distinct()), "branche", 6, level=5)
    return joined.groupBy("titel").agg(F.count(F.lit(1)).alias("n"), dbl(F.sum("indhold")))


@query(
    "join_override",
    """
    SELECT f.omrade, d.titel, CAST(SUM(f.indhold) AS DOUBLE) AS indhold FROM fact_clean f
    JOIN dim_geo d ON CAST(f.omrade AS BIGINT) - 20 = d.kode AND d.niveau = 1 AND f.status <> d.titel GROUP BY f.omrade, d.titel
    """,
)
def join_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = joins.join_override(
        frames.fact_clean(spark, sf_dir), frames.dim_geo(spark, sf_dir),
        "cast(f.omrade as bigint) - 20 = n.kode and n.niveau = 1 and f.status <> n.titel",
    )
    return joined.groupBy("omrade", "titel").agg(dbl(F.sum("indhold")))


@query(
    "join_keep_unmatched",
    """
    SELECT f.omrade, f.status, f.tid, d.titel, CAST(f.indhold AS DOUBLE) AS indhold FROM fact_cube f
    LEFT JOIN (SELECT * FROM dims_linked WHERE dim_id = 'states') d ON f.status = d.kode AND d.niveau = 1
    """,
)
def join_keep_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classification of states lacks ``P``, and no state is the total."""
    states = frames.dims_linked(spark, sf_dir).where(F.col("dim_id") == "states")
    named = joins.join_dim(frames.fact_cube(spark, sf_dir), states, "status", level=1, how="left")
    return named.select("omrade", "status", "tid", "titel", dbl("indhold"))


@query(
    "dim_values_for_table",
    """
    SELECT c.table_id, d.* FROM dims_linked d JOIN fact_links l ON l.dim_id = d.dim_id
    JOIN fact_codes c ON c.table_id = l.table_id AND c.column_name = l.column_name AND c.id = d.kode
    """,
)
def dim_values_for_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.dim_values_for_table(
        frames.dims_linked(spark, sf_dir), fact_codes(spark, sf_dir), frames.fact_links(spark, sf_dir)
    )


_MISSING = """
SELECT c.table_id, c.column_name, l.dim_id, c.id FROM fact_codes c JOIN fact_links l ON l.table_id = c.table_id AND l.column_name = c.column_name
WHERE NOT EXISTS (SELECT 1 FROM dims_linked d WHERE d.dim_id = l.dim_id AND d.kode = c.id)
"""


@query("missing_codes", _MISSING)
def missing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.missing_codes(fact_codes(spark, sf_dir), frames.dims_linked(spark, sf_dir), frames.fact_links(spark, sf_dir))


@query(
    "check_link",
    f"""
    SELECT l.table_id, l.column_name, l.dim_id, COUNT(m.id) FILTER (WHERE m.id <> '0') = 0 AS ok, COUNT(m.id) AS n_missing, MIN(m.id) AS first_missing
    FROM fact_links l LEFT JOIN ({_MISSING}) m ON m.table_id = l.table_id AND m.column_name = l.column_name
    GROUP BY l.table_id, l.column_name, l.dim_id
    """,
)
def check_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.check_link(fact_codes(spark, sf_dir), frames.dims_linked(spark, sf_dir), frames.fact_links(spark, sf_dir))


@query(
    "code_overlap",
    """
    SELECT l.table_id, l.column_name, l.dim_id, COUNT(*) AS codes, COUNT(d.kode) AS overlap, ROUND(COUNT(d.kode) / COUNT(*), 6) AS overlap_ratio
    FROM fact_links l JOIN fact_codes c ON c.table_id = l.table_id AND c.column_name = l.column_name
    LEFT JOIN dims_linked d ON d.dim_id = l.dim_id AND d.kode = c.id GROUP BY l.table_id, l.column_name, l.dim_id
    """,
)
def code_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.code_overlap(fact_codes(spark, sf_dir), frames.dims_linked(spark, sf_dir), frames.fact_links(spark, sf_dir))


@query(
    "load_links",
    """
    SELECT 'tab' || c_nationkey AS table_id, 'omrade' AS column_name, 'geo' AS dim_id, 'approx' AS match_type,
           'customers ' || COUNT(*) AS note, CAST(NULL AS VARCHAR) AS join_override FROM customer GROUP BY c_nationkey
    UNION ALL SELECT DISTINCT 'tab' || c_nationkey, 'status', 'states', 'exact', CAST(NULL AS VARCHAR), 'f.status = n.kode' FROM customer
    """,
)
def load_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = frames.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    body = F.to_json(
        F.array(
            F.struct(F.lit("OMRÅDE").alias("column"), F.lit(" Geo ").alias("dimension"), F.lit("approx").alias("match_type"),
                     F.concat(F.lit("customers "), F.col("n").cast("string")).alias("note"), F.lit(None).cast("string").alias("join_override")),
            F.struct(F.lit("STATUS").alias("column"), F.lit("states").alias("dimension"), F.lit(None).cast("string").alias("match_type"),
                     F.lit(None).cast("string").alias("note"), F.lit("f.status = n.kode").alias("join_override")),
        )
    )
    return parse_links(counts.select(F.concat(F.lit("TAB"), F.col("c_nationkey").cast("string")).alias("table_id"), body.alias("body")))


@query(
    "boundary_keys",
    """
    SELECT layer, CAST(CASE layer WHEN 'regioner' THEN CAST(kode AS BIGINT) - 1000 WHEN 'politikredse' THEN CAST(kode AS BIGINT) - 1459
        WHEN 'postnumre' THEN CAST(nr AS BIGINT) WHEN 'storkredse' THEN CAST(nummer AS BIGINT) WHEN 'afstemningsomraader' THEN CAST(dagi_id AS BIGINT)
        WHEN 'landsdele' THEN CASE c_custkey % 11 WHEN 8 THEN 10 WHEN 9 THEN 9 ELSE c_custkey % 11 + 1 END
        ELSE CAST(kode AS BIGINT) END AS BIGINT) AS dim_kode, navn, geometry FROM features_raw
    """,
)
def boundary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.boundary_keys(frames.features_raw(spark, sf_dir))


@query(
    "boundary_merge",
    """
    SELECT CAST(f.omrade AS BIGINT) - 9 AS dim_kode, n_name AS navn, 'POINT(' || n_nationkey || ' ' || n_regionkey || ')' AS geometry, f.omrade, f.tid,
           CAST(f.indhold AS DOUBLE) AS indhold
    FROM fact_cube f JOIN nation ON CAST(f.omrade AS BIGINT) - 9 = 92 + n_nationkey WHERE f.status = 'TOT' AND f.omrade <> '0'
    """,
)
def boundary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    layer = frames.table(spark, sf_dir, "nation").select(
        (key + 92).cast("bigint").alias("dim_kode"), F.col("n_name").alias("navn"),
        F.concat(F.lit("POINT("), key.cast("string"), F.lit(" "), F.col("n_regionkey").cast("string"), F.lit(")")).alias("geometry"),
    )
    cube = frames.fact_cube(spark, sf_dir).where(F.col("status") == "TOT")
    merged = joins.boundary_merge(layer, cube, "omrade", offset=9)
    return merged.select("dim_kode", "navn", "geometry", "omrade", "tid", dbl("indhold"))


@query(
    "cross_cube_join",
    """
    SELECT a.omrade, a.tid, CAST(a.v AS DOUBLE) AS ordered, CAST(b.indhold AS DOUBLE) AS shipped
    FROM (SELECT omrade, tid, SUM(indhold) AS v FROM fact_clean GROUP BY omrade, tid) a JOIN fact_supply b ON b.omrade = a.omrade AND b.tid = a.tid
    """,
)
def cross_cube_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = joins.cross_cube_join(
        frames.fact_clean(spark, sf_dir), frames.fact_supply(spark, sf_dir), ["omrade", "tid"], ("ordered", "shipped")
    )
    return both.select("omrade", "tid", dbl("ordered", "ordered"), dbl("shipped", "shipped"))


@query(
    "latest_period",
    """
    SELECT omrade, status, tid, CAST(indhold AS DOUBLE) AS indhold FROM fact_cube WHERE tid = (SELECT MAX(tid) FROM fact_cube)
    """,
)
def latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = joins.latest_period(frames.fact_cube(spark, sf_dir), "tid", frames.fact_clean(spark, sf_dir))
    return latest.select("omrade", "status", "tid", dbl("indhold"))


@query(
    "range_lookup",
    """
    SELECT table_id, tid_text, lo = 2000 AS starts_2000, tid_text = '[1999,2002)' AS is_1999, lo <= 1998 AND 1998 < hi AS holds_1998, '[' || lo || ',' || hi || ')' AS parsed
    FROM period_stored WHERE tid_form = 'span'
    """,
)
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = delta.clean_periods(frames.period_lists(spark, sf_dir), pos="pos").where(F.col("tid_form") == "span")
    span = F.col("tid_range")
    return spans.select(
        "table_id", "tid_text", (span["lo"] == 2000).alias("starts_2000"), (F.col("tid_text") == "[1999,2002)").alias("is_1999"),
        contains_point(span, F.lit(1998)).alias("holds_1998"), range_text(parse_range_text(F.col("tid_text"))).alias("parsed"),
    )


_BANDS = "SELECT n_name AS band, n_nationkey * 2 AS lo, CASE WHEN n_nationkey < 24 THEN n_nationkey * 2 + 5 END AS hi FROM nation"


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    span = F.struct((key * 2).alias("lo"), F.when(key < 24, key * 2 + 5).alias("hi"))
    return frames.table(spark, sf_dir, "nation").select(F.col("n_name").alias("band"), span.alias("span"))


@query(
    "range_join",
    f"""
    SELECT p_partkey, p_size, band FROM part JOIN ({_BANDS}) ON lo <= p_size AND (hi IS NULL OR p_size < hi)
    """,
)
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = frames.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return joins.range_join(points, "p_size", _bands(spark, sf_dir), "span").select("p_partkey", "p_size", "band")


@query(
    "range_join_wide",
    """
    SELECT o_orderkey, l.lo FROM orders JOIN (
      SELECT DISTINCT o_custkey * 40 AS lo,
        CASE WHEN o_custkey % 50 > 0 AND o_custkey NOT IN (SELECT MAX(o_custkey) FROM orders GROUP BY o_orderpriority) THEN o_custkey * 40 + 60 END AS hi
      FROM orders) l
      ON lo <= o_orderkey AND (hi IS NULL OR o_orderkey < hi)
    """,
)
def range_join_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range over order keys for each customer; every fiftieth customer's and those of the last customer of each priority are open."""
    orders, low = frames.table(spark, sf_dir, "orders"), F.col("o_custkey") * 40
    last = orders.groupBy("o_orderpriority").agg(F.max("o_custkey").alias("o_custkey")).select("o_custkey").distinct().withColumn("open", F.lit(True))
    marked = orders.select("o_custkey").distinct().join(last, "o_custkey", "left")
    closed = (F.col("o_custkey") % 50 > 0) & F.col("open").isNull()
    ranges = marked.select(F.struct(low.alias("lo"), F.when(closed, low + 60).alias("hi")).alias("span"))
    found = joins.range_join(orders.select("o_orderkey"), "o_orderkey", ranges, "span")
    return found.select("o_orderkey", F.col("span.lo").alias("lo"))


@query(
    "range_overlap",
    f"""
    SELECT p_partkey, p_size, band FROM part JOIN ({_BANDS}) ON lo < p_size + 3 AND (hi IS NULL OR p_size < hi)
    """,
)
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    spans = frames.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.struct(size.alias("lo"), (size + 3).alias("hi")).alias("own"))
    return joins.range_overlap_join(spans, "own", _bands(spark, sf_dir), "span").select("p_partkey", "p_size", "band")

"""Cleaning, typing and classification building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import range_text
from ..functions.text import plain_name_column
from ..operators import clean, dims
from . import frames
from ._registry import query


@query(
    "normalize_names",
    """
    SELECT table_id, variable, REPLACE(REPLACE(REPLACE(LOWER(variable), 'å', 'a'), 'ø', 'o'), 'æ', 'ae') AS column_name
    FROM (SELECT DISTINCT table_id, variable FROM meta_values)
    """,
)
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    variables = frames.metadata(spark, sf_dir).select("table_id", F.explode("variables.id").alias("variable"))
    return variables.withColumn("column_name", plain_name_column(F.col("variable")))


@query(
    "clean_age",
    """
    SELECT p_partkey, table_id, alder,
           CASE table_id WHEN 'single' THEN 'int' WHEN 'bands' THEN 'range' ELSE 'text' END AS alder_form,
           CASE WHEN table_id = 'single' THEN CAST(REPLACE(alder, '-', '') AS INTEGER) END AS alder_int,
           CASE WHEN table_id = 'bands' THEN CASE WHEN alder LIKE '%OV' THEN '[' || REPLACE(alder, 'OV', '') || ',)'
             ELSE '[' || SPLIT_PART(alder, '-', 1) || ',' || (CAST(SPLIT_PART(alder, '-', 2) AS BIGINT) + 1) || ')' END END AS alder_range,
           CASE WHEN table_id IN ('total', 'holes') THEN alder END AS alder_text
    FROM age_rows
    """,
)
def clean_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    aged = clean.clean_age(frames.age_rows(spark, sf_dir))
    return aged.withColumn("alder_range", range_text(F.col("alder_range")))


@query(
    "clean_age_numbers",
    """
    SELECT p_partkey, table_id, CASE WHEN top > 1000 THEN 'text' ELSE 'int' END AS alder_form,
           CASE WHEN top <= 1000 THEN CAST(alder AS INTEGER) END AS alder_int,
           CASE WHEN top > 1000 THEN CAST(alder AS VARCHAR) END AS alder_text
    FROM (SELECT p_partkey, 'P' || (p_partkey // 500) AS table_id, p_partkey AS alder,
                 MAX(p_partkey) OVER (PARTITION BY p_partkey // 500) AS top FROM part)
    """,
)
def clean_age_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = frames.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("P"), F.floor(key / 500).cast("string")).alias("table_id"), key.alias("alder")
    )
    return clean.clean_age(rows).select("p_partkey", "table_id", "alder_form", "alder_int", "alder_text")


@query("clean_measure", "SELECT omrade, status, tid, CASE WHEN indhold <> '..' THEN CAST(REPLACE(indhold, ',', '.') AS DOUBLE) END AS indhold FROM fact_raw")
def clean_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_measure(frames.fact_raw(spark, sf_dir))


@query(
    "process_fact",
    """
    SELECT table_id, omrade, status, CAST(tid_date AS VARCHAR) AS tid_text, CAST(SUBSTR(status_age, 2) AS INTEGER) AS alder_int, indhold
    FROM (SELECT table_id, omrade, status, CAST(tid_text AS DATE) AS tid_date, 'x' || SUBSTR(omrade, 2) AS status_age, indhold FROM fact_tables_clean)
    """,
)
def process_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = frames.fact_tables(spark, sf_dir).select(
        F.col("table_id").alias("TABLE_ID"),
        F.col("omrade").alias("OMRÅDE"),
        F.col("status").alias("STATUS"),
        F.substring("omrade", 2, 2).alias("ALDER"),
        F.col("tid").alias("TID"),
        F.col("indhold").alias("INDHOLD"),
    )
    return clean.process_fact(raw).select("table_id", "omrade", "status", "tid_text", "alder_int", "indhold")


@query("withheld_cells", "SELECT omrade, status, tid, COUNT(*) AS n FROM fact_raw WHERE indhold = '..' GROUP BY omrade, status, tid")
def withheld_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = clean.withheld_cells(frames.fact_raw(spark, sf_dir))
    return held.groupBy("omrade", "status", "tid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dim_code_to_int",
    """
    SELECT r.dim_id, r.niveau, r.kode, d.kode_is_int, CASE WHEN d.kode_is_int THEN CAST(REPLACE(r.kode, '.', '') AS BIGINT) END AS kode_int
    FROM dims_raw r JOIN dim_decision d ON d.dim_id = r.dim_id
    """,
)
def dim_code_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = dims.dim_code_to_int(frames.dims_raw(spark, sf_dir))
    return coded.select("dim_id", "niveau", "kode", "kode_is_int", "kode_int")


@query("derive_parents", "SELECT dim_id, sekvens, kode, niveau, parent_kode FROM dims_parented")
def derive_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dims.derive_parents(frames.dims_raw(spark, sf_dir))
    return found.select("dim_id", "sekvens", "kode", "niveau", "parent_kode")


def dims_clean(spark: SparkSession, sf_dir: str, dim_id: str | None = None) -> DataFrame:
    """All classifications cleaned, or one of them."""
    raw = frames.dims_raw(spark, sf_dir)
    return dims.process_dim(raw if dim_id is None else raw.where(F.col("dim_id") == dim_id))


@query(
    "process_dim",
    """
    SELECT dim_id, kode, niveau, titel, CASE WHEN dim_id = 'kn' AND niveau = 2 THEN NULL ELSE parent_kode END AS parent_kode, kode_is_int
    FROM dims_clean WHERE NOT (dim_id = 'kn' AND niveau = 1)
    """,
)
def process_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.process_dim(frames.dims_raw(spark, sf_dir), drop_level_one=("kn",))


@query(
    "infer_types",
    """
    SELECT 'orders' AS table_id, column_name, column_type FROM (
      SELECT UNNEST(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS column_name,
        UNNEST([CASE WHEN MAX(o_orderkey) < 32768 THEN 'smallint' WHEN MAX(o_orderkey) < 2147483648 THEN 'integer' ELSE 'bigint' END,
          CASE WHEN MAX(o_custkey) < 32768 THEN 'smallint' WHEN MAX(o_custkey) < 2147483648 THEN 'integer' ELSE 'bigint' END,
          'varchar(' || MAX(LENGTH(o_orderstatus)) || ')', 'double precision', 'timestamp without time zone',
          'varchar(' || MAX(LENGTH(o_orderpriority)) || ')']) AS column_type FROM orders)
    UNION ALL
    SELECT 'part', column_name, column_type FROM (
      SELECT UNNEST(['p_partkey', 'alder', 'tid', 'day', 'small']) AS column_name,
        UNNEST([CASE WHEN MAX(p_partkey) < 32768 THEN 'smallint' ELSE 'integer' END, 'int4range', 'varchar(' || MAX(LENGTH(p_name)) || ')', 'date', 'boolean']) AS column_type FROM part)
    """,
)
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = clean.infer_types(frames.table(spark, sf_dir, "orders")).withColumn("table_id", F.lit("orders"))
    size = F.col("p_size")
    part = frames.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(size >= 40, "[40,)").otherwise(F.format_string("[%d,%d)", size, size + 5)).alias("alder"),
        F.col("p_name").alias("tid"),
        F.date_add(F.lit("2000-01-01").cast("date"), size).alias("day"),
        (size < 10).alias("small"),
    )
    return orders.unionByName(clean.infer_types(part).withColumn("table_id", F.lit("part")))


@query(
    "dim_key_choice",
    """
    SELECT dim_id, CASE WHEN MAX(c) = 1 THEN 'kode' ELSE 'kode,niveau' END AS primary_key FROM (
      SELECT dim_id, kode, COUNT(*) AS c FROM (
        SELECT dim_id, kode FROM dims_clean UNION ALL
        SELECT 'cross', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'cross', CAST(r_regionkey AS VARCHAR) FROM region)
      GROUP BY dim_id, kode) GROUP BY dim_id
    """,
)
def dim_key_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cross = frames.table(spark, sf_dir, "nation").select(F.lit("cross").alias("dim_id"), F.col("n_nationkey").cast("string").alias("kode"))
    cross = cross.unionByName(
        frames.table(spark, sf_dir, "region").select(F.lit("cross").alias("dim_id"), F.col("r_regionkey").cast("string").alias("kode"))
    )
    return dims.dim_key_choice(dims_clean(spark, sf_dir).select("dim_id", "kode").unionByName(cross))


@query(
    "dates_to_timestamps",
    "SELECT o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, COUNT(*) AS n FROM orders GROUP BY 1, 2",
)
def dates_to_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = (
        frames.table(spark, sf_dir, "orders")
        .groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return clean.dates_to_timestamps(daily)


@query(
    "drop_rules",
    """
    SELECT omrade, status, tid, indhold FROM fact_raw
    WHERE omrade NOT IN (SELECT CAST(101 + n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 2) AND status <> 'P'
    """,
)
def drop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = frames.dim_geo(spark, sf_dir).where((F.col("niveau") == 2) & (F.col("parent_kode") == 83))
    area = codes.select(
        F.lit("omrade").alias("fact_column"), F.lit("geo").alias("dimension_table"), F.array(F.col("kode").cast("string")).alias("drop_values")
    )
    fixed = spark.createDataFrame([("status", "status", ["P"])], area.schema)
    return clean.drop_rules(frames.fact_raw(spark, sf_dir), area.unionByName(fixed), ["omrade", "status"])


@query("drop_totals", "SELECT omrade, status, tid, CAST(indhold AS DOUBLE) AS indhold FROM fact_cube WHERE status <> 'TOT' AND omrade <> '0'")
def drop_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = frames.fact_cube(spark, sf_dir).select("omrade", "status", "tid", F.col("indhold").cast("double").alias("indhold"))
    return clean.drop_totals(cube, (*clean.TOTAL_CODES, "0"))

"""The same cube model as DataFrames over the given parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its file footers are read for the schema once, not per use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def dim_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "region").select(
        (F.lit(81) + F.col("r_regionkey")).cast("bigint").alias("kode"),
        F.lit(1).alias("niveau"),
        F.col("r_name").alias("titel"),
        F.lit(None).cast("bigint").alias("parent_kode"),
        (F.col("r_regionkey") * 1000).cast("bigint").alias("sekvens"),
    )
    leaf = table(spark, sf_dir, "nation").select(
        (F.lit(101) + F.col("n_nationkey")).cast("bigint").alias("kode"),
        F.lit(2).alias("niveau"),
        F.col("n_name").alias("titel"),
        (F.lit(81) + F.col("n_regionkey")).cast("bigint").alias("parent_kode"),
        (F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).cast("bigint").alias("sekvens"),
    )
    return top.unionByName(leaf)


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


def quarter_code(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("K"), F.quarter(day).cast("string"))


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def fact_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned cube: text codes, quarter codes, decimal comma, ``..`` for unknown."""
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return customer_orders(spark, sf_dir).select(
        (F.lit(101) + F.col("c_nationkey")).cast("string").alias("omrade"),
        F.col("o_orderstatus").alias("status"),
        quarter_code(F.col("o_orderdate")).alias("tid"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(".."))
        .otherwise(F.replace(price, F.lit("."), F.lit(",")))
        .alias("indhold"),
    )


def fact_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fact_raw(spark, sf_dir).where(F.col("indhold") != "..")
    return raw.select(
        "omrade",
        "status",
        "tid",
        F.make_date(
            F.substring("tid", 1, 4).cast("int"), F.substring("tid", 6, 1).cast("int") * 3 - 2, F.lit(1)
        ).alias("tid_date"),
        F.replace("indhold", F.lit(","), F.lit(".")).cast("decimal(18,2)").alias("indhold"),
    )


def fact_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned cube with in-line totals ``omrade='0'`` and ``status='TOT'``.

    The finest cells are summed first, so the four-fold expansion of the cube
    runs over cells and not over source rows.
    """
    cells = (
        fact_clean(spark, sf_dir).groupBy("omrade", "status", "tid", "tid_date").agg(F.sum("indhold").alias("indhold"))
    )
    both = F.explode(F.array(F.struct("omrade", "status"),
                             F.struct(F.lit("0").alias("omrade"), "status"),
                             F.struct("omrade", F.lit("TOT").alias("status")),
                             F.struct(F.lit("0").alias("omrade"), F.lit("TOT").alias("status"))))
    return (
        cells.select(both.alias("k"), "tid", "tid_date", "indhold")
        .groupBy(F.col("k.omrade").alias("omrade"), F.col("k.status").alias("status"), "tid", "tid_date")
        .agg(F.sum("indhold").alias("indhold"))
    )


def fact_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second cube: shipped value by supplier nation and quarter."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .groupBy(
            (F.lit(101) + F.col("s_nationkey")).cast("string").alias("omrade"),
            quarter_code(F.col("l_shipdate")).alias("tid"),
        )
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("indhold"))
    )


def period_codes(dated: DataFrame) -> DataFrame:
    """Distinct codes of ``(c_nationkey, o_orderdate)`` rows in every period form."""
    days = dated.select("c_nationkey", F.to_date("o_orderdate").alias("d")).distinct()
    d = F.col("d")
    y, m = F.year(d).cast("string"), F.month(d)
    forms = {
        "DAY": F.concat(y, F.lit("M"), _two(m), F.lit("D"), _two(F.dayofmonth(d))),
        "WEEK": F.concat(y, F.lit("U"), _two(F.weekofyear(d))),
        "MONTH": F.concat(y, F.lit("M"), _two(m)),
        "QUARTER": quarter_code(d),
        "HALF": F.concat(y, F.lit("H"), F.when(m <= 6, "1").otherwise("2")),
        "YEAR": y,
        "SPLIT": F.concat(y, F.lit("/"), (F.year(d) + 1).cast("string")),
        "SPAN": F.concat(y, F.lit(":"), (F.year(d) + 2).cast("string")),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("tid")) for k, v in forms.items()]))
    table_id = F.concat(F.col("p.form"), F.col("c_nationkey").cast("string")).alias("table_id")
    return days.select("c_nationkey", pairs.alias("p")).select(table_id, F.col("p.tid").alias("tid")).distinct()


def period_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per nation and period form, with its codes in order."""
    # distinct codes of one table: bounded by the calendar
    order = Window.partitionBy("table_id").orderBy("tid")
    position = (F.row_number().over(order) - 1).cast("bigint")
    return period_codes(customer_orders(spark, sf_dir)).select("table_id", position.alias("pos"), "tid")


def nations_of(spark: SparkSession, sf_dir: str, region: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").where(F.col("r_name") == region)
    nation = table(spark, sf_dir, "nation")
    return nation.join(regions, nation.n_regionkey == regions.r_regionkey).select("n_nationkey")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested table descriptions, one per nation: ``table_id, text, unit, variables``."""
    pairs = F.explode(
        F.array(
            F.struct(F.lit("OMRÅDE").alias("variable"), F.col("c_mktsegment").alias("id")),
            F.struct(F.lit("STATUS").alias("variable"), F.col("o_orderstatus").alias("id")),
            F.struct(F.lit("ALDER").alias("variable"), F.col("month").alias("id")),
            F.struct(F.lit("Tid").alias("variable"), F.col("quarter").alias("id")),
        )
    )
    day = F.col("o_orderdate")
    # distinct before the four-fold expansion: bounded by the calendar
    seen = customer_orders(spark, sf_dir).select(
        "c_nationkey", "c_mktsegment", "o_orderstatus", F.month(day).cast("string").alias("month"), quarter_code(day).alias("quarter")
    ).distinct()
    from_orders = seen.select("c_nationkey", pairs.alias("p"))
    from_customers = table(spark, sf_dir, "customer").select(
        "c_nationkey", F.struct(F.lit("OMRÅDE").alias("variable"), F.col("c_mktsegment").alias("id")).alias("p")
    )
    values = (
        from_orders.unionByName(from_customers)
        .select(F.concat(F.lit("TAB"), F.col("c_nationkey").cast("string")).alias("table_id"), "p.variable", "p.id")
        .distinct()
    )
    # a description is one document, so its code lists are arrays by definition
    variables = values.groupBy("table_id", "variable").agg(
        F.sort_array(F.collect_list(F.struct("id", F.concat(F.lit("label "), F.col("id")).alias("text")))).alias("values")
    )
    return variables.groupBy("table_id").agg(
        F.concat(F.lit("description of "), F.col("table_id")).alias("text"),
        F.lit("kr.").alias("unit"),
        F.sort_array(
            F.collect_list(F.struct(F.col("variable").alias("id"), F.lower("variable").alias("text"), "values"))
        ).alias("variables"),
    )


def table_number(table_id: Column) -> Column:
    return F.regexp_extract(table_id, "[0-9]+$", 0).cast("int")


def _nation_of_table() -> Column:
    return table_number(F.col("table_id")) == F.col("n_nationkey")


def period_lists_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period lists; those of African nations end in an empty code."""
    lists = period_lists(spark, sf_dir)
    blank = (
        lists.join(nations_of(spark, sf_dir, "AFRICA"), _nation_of_table(), "left_semi")
        .groupBy("table_id")
        .agg((F.max("pos") + 1).alias("pos"))
        .withColumn("tid", F.lit(""))
    )
    return lists.unionByName(blank)


def frequency_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly tables of American nations count as weekly; those of European ones name no known frequency."""
    key = F.col("n_nationkey").cast("string")
    known = nations_of(spark, sf_dir, "AMERICA").select(F.concat(F.lit("MONTH"), key).alias("table_id"), F.lit("weekly").alias("frequency"))
    unknown = nations_of(spark, sf_dir, "EUROPE").select(F.concat(F.lit("YEAR"), key).alias("table_id"), F.lit("hourly").alias("frequency"))
    return known.unionByName(unknown)


def local_periods_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods held: those with a closed order; Asian nations hold nothing yet."""
    closed = period_codes(customer_orders(spark, sf_dir).where(F.col("o_orderstatus") == "F"))
    return closed.join(nations_of(spark, sf_dir, "ASIA"), _nation_of_table(), "left_anti")


def table_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog row per customer, stamped with the latest order date."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("d"))
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey")
        .join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("table_id"), F.col("d").cast("string").alias("updated"))
    )


def table_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") != "P")
        .groupBy("o_custkey")
        .agg(F.max(F.to_date("o_orderdate")).cast("string").alias("updated"))
        .select(
            F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("table_id"),
            "updated",
            F.lit("quarterly").alias("frequency"),
        )
    )


def fact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cubes of several tables, one per order priority."""
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return customer_orders(spark, sf_dir).select(
        F.concat(F.lit("F"), F.substring("o_orderpriority", 1, 1)).alias("table_id"),
        (F.lit(101) + F.col("c_nationkey")).cast("string").alias("omrade"),
        F.col("o_orderstatus").alias("status"),
        quarter_code(F.col("o_orderdate")).alias("tid"),
        F.when(F.col("o_orderkey") % 97 == 0, F.lit(".."))
        .otherwise(F.replace(price, F.lit("."), F.lit(",")))
        .alias("indhold"),
    )


def table_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of each table with their rank from the latest; bounded by the calendar."""
    latest_first = Window.partitionBy("table_id").orderBy(F.desc("tid"))
    return fact_tables(spark, sf_dir).select("table_id", "tid").distinct().withColumn("rk", F.row_number().over(latest_first))


def disk_manifest(quarters: DataFrame) -> DataFrame:
    """Quarters on disk: none of table F5, and not the latest of F4."""
    gone = (F.col("table_id") == "F5") | ((F.col("table_id") == "F4") & (F.col("rk") == 1))
    return quarters.where(~gone).select("table_id", "tid")


def changed_quarters(quarters: DataFrame) -> DataFrame:
    """The four latest quarters of each table."""
    return quarters.where(F.col("rk") <= 4).select("table_id", (4 - F.col("rk")).cast("bigint").alias("pos"), "tid")


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of one table per market segment and order priority; those of segment B and priority 2 have a unit in the measure."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    price = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    table_id = F.concat(F.substring("c_mktsegment", 1, 1), F.substring("o_orderpriority", 1, 1))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        table_id.alias("table_id"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"),
        quarter_code(F.col("o_orderdate")).alias("tid"), F.when(table_id == "B2", F.concat(price, F.lit(" kr"))).otherwise(price).alias("indhold"),
    )


def part_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, brand and part as a three-level tree with its traversal order."""
    kind = F.ascii("p_type").cast("bigint") * 26 + F.ascii(F.substring("p_type", 2, 1))
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("bigint") + 1
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", kind.alias("t"), brand.alias("b")
    )
    root = (F.col("t") * 100 + F.col("b")) * 1_000_000_000
    zero = F.lit(0).cast("bigint")
    leaves = part.select(
        F.lit(3).alias("niveau"), "p_type", "t", "b", "p_partkey", F.col("p_name").alias("titel"),
        (root + F.col("p_partkey") + 1).alias("seq"),
    )
    brands = part.select(
        F.lit(2).alias("niveau"), "p_type", "t", "b", zero.alias("p_partkey"), F.col("p_brand").alias("titel"), root.alias("seq")
    ).distinct()
    types = part.select(
        F.lit(1).alias("niveau"), "p_type", "t", zero.alias("b"), zero.alias("p_partkey"), F.col("p_type").alias("titel"),
        (F.col("t") * 100 * 1_000_000_000).alias("seq"),
    ).distinct()
    return leaves.unionByName(brands).unionByName(types)


def dims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned classifications; codes are text."""
    geo = dim_geo(spark, sf_dir)
    code = F.col("kode").cast("string").alias("kode")
    plain = geo.select(F.lit("geo").alias("dim_id"), "sekvens", code, "niveau", "titel")
    gap = geo.select(F.lit("gap").alias("dim_id"), "sekvens", code, (F.col("niveau") * 2 - 1).alias("niveau"), "titel")
    key = F.col("n_nationkey")
    dotted = F.concat(F.floor(key / 10).cast("string"), F.lit("."), (key % 10).cast("string"))
    nation = table(spark, sf_dir, "nation")
    amb = nation.select(
        F.lit("amb").alias("dim_id"), (key * 2).cast("bigint").alias("sekvens"), key.cast("string").alias("kode"),
        F.lit(1).alias("niveau"), F.col("n_name").alias("titel"),
    ).unionByName(
        nation.select(
            F.lit("amb").alias("dim_id"), (key * 2 + 1).cast("bigint").alias("sekvens"), dotted.alias("kode"),
            F.lit(1).alias("niveau"), F.col("n_name").alias("titel"),
        )
    )
    tree = part_tree(spark, sf_dir)
    brand = F.lpad(F.col("b").cast("string"), 2, "0")

    def codes(top: Column, leaf: Column) -> Column:
        return (
            F.when(F.col("niveau") == 1, top)
            .when(F.col("niveau") == 2, F.concat(top, F.lit("."), brand))
            .otherwise(F.concat(top, F.lit("."), brand, F.lit("."), leaf))
        )

    key = F.col("p_partkey").cast("string")
    named = tree.select(F.lit("prod").alias("dim_id"), F.col("seq").alias("sekvens"), codes(F.col("p_type"), key).alias("kode"), "niveau", "titel")
    numbered = tree.select(
        F.lit("kn").alias("dim_id"), F.col("seq").alias("sekvens"),
        codes(F.col("t").cast("string"), F.lpad(key, 12, "0")).alias("kode"), "niveau", "titel",
    )
    return plain.unionByName(gap).unionByName(amb).unionByName(named).unionByName(numbered)


def age_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parts under four age codings: single years, bands, bands with a total, with holes."""
    size = F.col("p_size")
    low = (F.floor(size / 5) * 5).cast("int")
    band = F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string"))
    year = size.cast("string")
    codings = F.array(
        F.struct(F.lit("single").alias("t"), F.when(size >= 40, "40-").otherwise(year).alias("a")),
        F.struct(F.lit("bands").alias("t"), F.when(size >= 40, "40OV").otherwise(band).alias("a")),
        F.struct(F.lit("total").alias("t"), F.when(size == 7, "IALT").otherwise(band).alias("a")),
        F.struct(F.lit("holes").alias("t"), F.when(size != 9, year).alias("a")),
    )
    exploded = table(spark, sf_dir, "part").select("p_partkey", F.explode(codings).alias("c"))
    return exploded.select("p_partkey", F.col("c.t").alias("table_id"), F.col("c.a").alias("alder"))


def fact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.explode(
        F.array(
            F.struct(F.lit("omrade").alias("column_name"), F.lit("geo").alias("dim_id")),
            F.struct(F.lit("status").alias("column_name"), F.lit("states").alias("dim_id")),
        )
    )
    return fact_tables(spark, sf_dir).select("table_id").distinct().select("table_id", pairs.alias("p")).select("table_id", "p.*")


def dims_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area classification and one of order states that lacks ``P``."""
    text = "string"
    geo = dim_geo(spark, sf_dir).select(
        F.lit("geo").alias("dim_id"), F.col("kode").cast(text).alias("kode"), "niveau", "titel", F.col("parent_kode").cast(text).alias("parent_kode")
    )
    states = table(spark, sf_dir, "orders").select("o_orderstatus").distinct().where(F.col("o_orderstatus") != "P")
    return geo.unionByName(
        states.select(
            F.lit("states").alias("dim_id"), F.col("o_orderstatus").alias("kode"), F.lit(1).alias("niveau"),
            F.concat(F.lit("state "), F.col("o_orderstatus")).alias("titel"), F.lit(None).cast(text).alias("parent_kode"),
        )
    )


def features_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary features of ten layers, one per customer."""
    from ..functions.layers import NUTS3_CODES

    names = ["kommuner", "regioner", "landsdele", "politikredse", "retskredse", "sogne", "postnumre", "storkredse",
             "valgkredse", "afstemningsomraader"]
    key = F.col("c_custkey")
    codes = F.array(*[F.lit(n) for n in NUTS3_CODES])
    return table(spark, sf_dir, "customer").select(
        F.get(F.array(*[F.lit(n) for n in names]), (key % 10).cast("int")).alias("layer"),
        (key + 1000).cast("string").alias("kode"),
        (key + 2).cast("string").alias("nr"),
        (key + 3).cast("string").alias("nummer"),
        (key + 4).cast("string").alias("dagi_id"),
        F.get(codes, (key % 11).cast("int")).alias("nuts3"),
        F.col("c_name").alias("navn"),
        F.concat(F.lit("POINT("), F.col("c_nationkey").cast("string"), F.lit(" "), key.cast("string"), F.lit(")")).alias("geometry"),
    )

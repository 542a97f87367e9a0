import json
import random

from pyspark.sql import functions as F

from diff import compare, duck

from cubeloom.operators import catalog, dims, joins, search
from cubeloom.sources.links import load_links, parse_links
from cubeloom.suite import all_oracles, all_queries

DIMS = "dim_id string, kode bigint, niveau int, titel string, parent_kode bigint"
VALUES = "table_id string, column_name string, id string"
LINKS = "table_id string, column_name string, dim_id string"


def offences(spark):
    return spark.createDataFrame(
        [("overtraedtype", 1, 1, "Straffelov", None), ("overtraedtype", 2, 1, "Faerdselslov", None), ("overtraedtype", 3, 1, "Saerlov", None)], DIMS
    )


def test_join_text():
    assert joins.join_text("overtraed", "character varying", "integer", "f", "n") == "f.overtraed=n.kode::text"
    assert joins.join_text("a", "integer", "smallint") == "a=kode"
    assert joins.join_text("a", "integer", "varchar(3)") == "a::text=kode"
    assert joins.join_text("a", "date", "integer") == "a::text=kode::text"
    assert joins.join_text("a", "text", "character varying") == "a=kode"


def test_total_codes_do_not_break_typed_joins(spark, rows):
    facts = spark.createDataFrame([("TOT", 1.0), ("1", 2.0)], "overtraed string, indhold double")
    assert rows(joins.join_dim(facts, offences(spark), "overtraed"), "overtraed", "titel") == [("1", "Straffelov")]
    left = joins.join_dim(facts, offences(spark), "overtraed", how="left")
    assert rows(left, "overtraed", "titel") == [("1", "Straffelov"), ("TOT", None)]


def test_override_and_padding(spark, rows):
    facts = spark.createDataFrame([("000001", 5), ("000009", 6)], "code string, v int")
    assert rows(joins.join_padded(facts, offences(spark), "code", 6), "v", "titel") == [(5, "Straffelov")]
    got = joins.join_override(facts, offences(spark), "cast(f.code as int) + 1 = n.kode and f.v < 6")
    assert rows(got, "v", "titel") == [(5, "Faerdselslov")]


def test_dim_values_for_table_and_link_check(spark, rows):
    values = spark.createDataFrame([("t", "overtraed", c) for c in ("TOT", "1", "3")] + [("u", "overtraed", "0"), ("u", "overtraed", "2")], VALUES)
    links = spark.createDataFrame([("t", "overtraed", "overtraedtype"), ("u", "overtraed", "overtraedtype")], LINKS)
    assert rows(joins.dim_values_for_table(offences(spark), values, links), "table_id", "kode") == [("t", 1), ("t", 3), ("u", 2)]
    assert rows(joins.check_link(values, offences(spark), links), "table_id", "ok", "n_missing", "first_missing") == [
        ("t", False, 1, "TOT"), ("u", True, 1, "0")
    ]


def test_column_lookup(spark):
    dim = offences(spark)
    values = spark.createDataFrame([("t", "overtraed", c) for c in ("TOT", "1", "3")], VALUES)
    links = spark.createDataFrame([("t", "overtraed", "overtraedtype")], LINKS)
    every = catalog.column_lookup(dim, n=5)
    assert [r.kode for r in every.collect()] == [1, 2, 3]
    mine = catalog.column_lookup(dim, for_table="t", used=values, links=links)
    assert [r.kode for r in mine.collect()] == [1, 3]
    assert catalog.column_lookup(dim, n=1, query="straf", for_table="t", used=values, links=links).collect()[0].titel == "Straffelov"
    column = spark.createDataFrame([(0, "TOT", "I alt"), (1, "1", "Et")], "pos bigint, id string, text string")
    assert [r.id for r in catalog.column_lookup(column, n=1).collect()] == ["TOT"]


def test_discovery_rules(spark, rows):
    values = spark.createDataFrame(
        [("t", "overtraed", c) for c in ("TOT", "1", "2", "3")] + [("t", "kon", c) for c in ("TOT", "M", "K")] + [("u", "type", "1"), ("u", "art", "9")], VALUES
    )
    requests = spark.createDataFrame([("t", "overtraedtype"), ("t", "kones"), ("t", "vertraed"), ("u", "overtraedtype"), ("u", "nothing")], "table_id string, dim_id string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows(search.discover_links(requests, values, offences(spark)))}
    assert got == {
        ("t", "overtraedtype"): ("prefix", "overtraed"), ("t", "kones"): ("prefix", "kon"), ("t", "vertraed"): ("name", "overtraed"),
        ("u", "overtraedtype"): ("codes", "type"), ("u", "nothing"): ("none", None),
    }


def test_links_defaults_and_files(spark, rows, tmp_path):
    entries = [{"column": "OMRÅDE", "dimension": " NUTS "}, {"column": "kon", "dimension": "x", "match_type": "approx", "note": "n", "join_override": "f.a=n.kode"}]
    docs = spark.createDataFrame([("T1", json.dumps(entries)), ("T2", "[]")], "table_id string, body string")
    want = [("t1", "kon", "x", "approx", "n", "f.a=n.kode"), ("t1", "omrade", "nuts", "exact", None, None)]
    assert rows(parse_links(docs)) == want
    (tmp_path / "T1.json").write_text(json.dumps(entries, indent=1))
    assert rows(load_links(spark, str(tmp_path))) == want


def test_levels_and_rollup_any_depth(spark, rows):
    tree = spark.createDataFrame(
        [("g", 84, 1, "Region", None), ("g", 1, 2, "Part", 84), ("g", 2, 2, "Rest", 84), ("g", 101, 3, "City", 1), ("g", 147, 3, "Town", 1), ("g", 1, 3, "One", 2)], DIMS
    )
    facts = spark.createDataFrame([("101", 5), ("147", 6), ("1", 7), ("TOT", 99)], "omrade string, indhold int")
    assert rows(dims.hierarchy_rollup(facts, tree, "omrade", 3, 1), "titel", "indhold") == [("Region", 18)]
    assert rows(dims.hierarchy_rollup(facts, tree, "omrade", 3, 2), "titel", "indhold") == [("Part", 11), ("Rest", 7)]
    assert rows(dims.hierarchy_rollup(facts, tree, "omrade", 3, 3), "titel", "indhold") == [("City", 5), ("One", 7), ("Town", 6)]
    used = spark.createDataFrame([("t", "omrade", "84"), ("t", "omrade", "101")], VALUES)
    links = spark.createDataFrame([("t", "omrade", "g")], LINKS)
    assert rows(dims.observed_levels(used, tree, links), "levels") == [("1,3",)]


def test_range_joins_equal_brute_force(spark, rows):
    import random

    rnd = random.Random(1)
    spans = [(i, rnd.randint(0, 60), rnd.choice([None, rnd.randint(1, 30)])) for i in range(40)]
    spans = [(i, lo, None if size is None else lo + size) for i, lo, size in spans]
    points = [(i, rnd.randint(0, 80)) for i in range(60)]
    ranges = spark.createDataFrame([(i, (lo, hi)) for i, lo, hi in spans], "r int, span struct<lo:int,hi:int>")
    others = ranges.select(F.col("r").alias("q"), F.col("span").alias("other"))
    pts = spark.createDataFrame(points, "p int, x int")
    inside = lambda lo, hi, x: lo <= x and (hi is None or x < hi)
    want = sorted((p, r) for p, x in points for r, lo, hi in spans if inside(lo, hi, x))
    meet = lambda a, b: (a[2] is None or b[1] < a[2]) and (b[2] is None or a[1] < b[2])
    both = sorted((a[0], b[0]) for a in spans for b in spans if meet(a, b))
    assert sorted(rows(joins.range_join(pts, "x", ranges, "span"), "p", "r")) == want
    assert sorted(rows(joins.range_overlap_join(ranges, "span", others, "other"), "r", "q")) == both
    far = spark.createDataFrame([(1, (-5, None)), (2, (10**9, 2 * 10**9)), (3, (7, 7))], "r int, span struct<lo:int,hi:int>")
    pts = spark.createDataFrame([(1, -6), (2, -5), (3, 10**9 - 1), (4, 10**9), (5, 2 * 10**9), (6, 7)], "p int, x int")
    assert sorted(rows(joins.range_join(pts, "x", far, "span"), "p", "r")) == [(2, 1), (3, 1), (4, 1), (4, 2), (5, 1), (6, 1)]
    assert rows(joins.range_join(pts, "x", far.where("r = 3"), "span"), "p") == []


def test_boundaries(spark, rows):
    features = spark.createDataFrame(
        [("regioner", "1084", None, None, None, None, "H", "g"), ("landsdele", None, None, None, None, "DK041", "F", "g"), ("politikredse", "1460", None, None, None, None, "P", "g"),
         ("postnumre", None, "1050", None, None, None, "K", "g"), ("unknown", "1", None, None, None, None, "?", "g")],
        "layer string, kode string, nr string, nummer string, dagi_id string, nuts3 string, navn string, geometry string",
    )
    assert rows(joins.boundary_keys(features), "layer", "dim_kode") == [
        ("landsdele", 10), ("politikredse", 1), ("postnumre", 1050), ("regioner", 84), ("unknown", None)
    ]
    layer = spark.createDataFrame([(1, "A", "g"), (2, "B", "g")], "dim_kode bigint, navn string, geometry string")
    facts = spark.createDataFrame([("0", 9), ("10", 1), ("11", 2)], "omrade string, indhold int")
    assert rows(joins.boundary_merge(layer, facts, "omrade", offset=9), "navn", "indhold") == [("A", 1), ("B", 2)]


def test_typed_value_map_falls_back_per_column(spark, rows):
    values = spark.createDataFrame(
        [("t", "alder", 0, "0", "zero"), ("t", "alder", 1, "IALT", "all"), ("t", "n", 0, "7", "seven"), ("t", "tid", 0, "2024", ""), ("t", "dim", 0, "1", "")],
        "table_id string, column_name string, pos bigint, id string, text string",
    )
    types = spark.createDataFrame([("t", "alder", "smallint"), ("t", "n", "double precision"), ("t", "dim", "integer")], "table_id string, column_name string, column_type string")
    linked = spark.createDataFrame([("t", "dim")], "table_id string, column_name string")
    assert rows(catalog.typed_value_map(values, types, linked), "column_name", "id_kind", "id_int", "id_float", "id_text") == [
        ("alder", "text", None, None, "0"), ("alder", "text", None, None, "IALT"), ("n", "float", None, 7.0, None)
    ]


def test_range_join_sweeps_hot_points_and_slots(spark, rows, monkeypatch):
    """A third of the points at one place, many ranges over several slots, slots split in parts, small batches."""
    rnd = random.Random(9)
    xs = [50] * 200 + [rnd.randint(-300, 300) for _ in range(400)] + [None]
    spans = [(i, rnd.randint(-300, 300), rnd.choice([None, 0, 1, 5, 400])) for i in range(150)] + [(900, 50, 1), (901, 50, 0), (902, None, 7)]
    points = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "p int, x bigint").repartition(5)
    ranges = spark.createDataFrame([(i, (lo, None if w is None else (lo or 0) + w)) for i, lo, w in spans], "r int, span struct<lo:bigint,hi:bigint>")
    want = sorted(
        (p, i) for p, x in enumerate(xs) for i, lo, w in spans if x is not None and lo is not None and lo <= x and (w is None or x < lo + w)
    )
    monkeypatch.setattr(joins, "SLOT_POINTS", 40)
    for batch in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = joins.range_join(points, "x", ranges, "span")
            assert got.columns == ["p", "x", "r", "span"] and sorted(rows(got, "p", "r")) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert joins.range_join(points.limit(0), "x", ranges, "span").count() == 0
    assert joins.range_join(points, "x", ranges.limit(0), "span").count() == 0


def test_range_join_shuffles_points_once(spark):
    points = spark.range(1000).withColumnRenamed("id", "x")
    ranges = spark.range(9).selectExpr("struct(id * 3 as lo, id * 3 + 700 as hi) as span")
    plan = joins.range_join(points, "x", ranges, "span")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_wide_ranges_of_all_customers_and_open_ones_along_the_axis(spark, tmp_path):
    """Every fiftieth customer's range meets all later orders, other customers' are there too, as in the SQL."""
    customers = [None, 0, 1, 2, 37, 49, 50, 51, 100, 110, 120, 120]
    orders = [(k * 37, customers[k % 12], "AB"[k % 2]) for k in range(200)] + [(None, 50, "A"), (74, 2, "B")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").toPandas().to_parquet(tmp_path / "orders.parquet")
    known = [(c, p) for _, c, p in orders if c is not None]
    last = {max(c for c, p in known if p == mine) for mine in "AB"}
    spans = [(c * 40, None if c % 50 == 0 or c in last else c * 40 + 60) for c in {c for c, _ in known}]
    want = sorted((x, lo) for x, _, _ in orders for lo, hi in spans if x is not None and lo <= x and (hi is None or x < hi))
    sql, query = all_oracles()["range_join_wide"], all_queries()["range_join_wide"]
    assert sorted(tuple(r) for r in query(spark, str(tmp_path)).collect()) == want
    assert compare(spark, duck(str(tmp_path)), query, sql, str(tmp_path))[2] is None
    assert (7363, 2000) in want and (1480, 1480) in want and (1554, 1480) not in want


def test_range_join_emits_more_pairs_than_fit_at_once(spark, rows):
    """Some 110,000 pairs of one batch, cut inside of ranges; many ranges meet nothing."""
    spans = [(i, i % 30, None if i % 3 == 0 else i % 30 + i % 7) for i in range(4000)]
    ranges = spark.createDataFrame([(i, (lo, hi)) for i, lo, hi in spans], "r int, span struct<lo:int,hi:int>")
    points = spark.createDataFrame([(i, i) for i in range(90)], "p int, x int")
    want = sorted((p, i) for p in range(90) for i, lo, hi in spans if lo <= p and (hi is None or p < hi))
    assert len(want) > joins.PAIRS
    assert sorted(rows(joins.range_join(points, "x", ranges, "span"), "p", "r")) == want


def test_range_join_cuts_blocks_of_points(spark, rows):
    """Ranges that start and end before, at and after the edges of blocks, and hold several of them, in whole and in small batches."""
    size, edges = joins.BLOCK, [k * joins.BLOCK + d for k in range(4) for d in (-1, 0, 1)]
    spans = [(lo, hi) for lo in edges for hi in [*edges, None] if hi is None or hi >= lo]
    points = spark.createDataFrame([(x,) for x in range(3 * size + 5)], "x bigint")
    ranges = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "r int, span struct<lo:bigint,hi:bigint>")
    want = [(x, i) for x in range(3 * size + 5) for i, (lo, hi) in enumerate(spans) if lo <= x and (hi is None or x < hi)]
    for batch in (10_000, 100):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert sorted(rows(joins.range_join(points, "x", ranges, "span"), "x", "r")) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_files_of_many_pairs_are_small(spark, tmp_path):
    """Keys of points and ranges come in an order that Parquet packs; a run of all points for each range took 2 bytes a pair."""
    points = spark.range(20_000).select((F.col("id") * 7919 % 20_011 * 1_000_003).alias("key"), F.col("id").alias("x"))
    ranges = spark.range(64).selectExpr("id as r", "struct(id * 3 as lo, cast(null as bigint) as hi) as span")
    joins.range_join(points, "x", ranges, "span").select("key", "r").write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.count() == pairs.distinct().count() == sum(20_000 - 3 * k for k in range(64))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * pairs.count()

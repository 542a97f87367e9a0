import pytest
from pyspark.sql import functions as F

from cubeloom.operators import catalog, cube

CUBE = "omrade string, kon string, tid string, indhold double"
TOTALS = {"omrade": "000", "kon": "TOT"}


def small(spark):
    leaves = [(o, k, t, v) for t, f in (("2024K1", 1), ("2024K2", 2)) for o, k, v in (("101", "M", 10.0 * f), ("101", "K", 20.0 * f), ("147", "M", 5.0 * f))]
    out = list(leaves)
    for t in ("2024K1", "2024K2"):
        mine = [r for r in leaves if r[2] == t]
        out.append(("000", "TOT", t, sum(r[3] for r in mine)))
        for o in ("101", "147"):
            out.append((o, "TOT", t, sum(r[3] for r in mine if r[0] == o)))
        for k in ("M", "K"):
            out.append(("000", k, t, sum(r[3] for r in mine if r[1] == k)))
    return spark.createDataFrame(out, CUBE)


def test_totals_are_not_counted_twice(spark, rows):
    facts = small(spark)
    total = facts.agg(F.sum("indhold")).first()[0]
    pinned = cube.pin_totals(facts, TOTALS).agg(F.sum("indhold")).first()[0]
    leaves = cube.leaves_only(facts, TOTALS).agg(F.sum("indhold")).first()[0]
    assert (total, pinned, leaves) == (420.0, 105.0, 105.0)
    assert rows(cube.pin_totals(facts, TOTALS, ("omrade",)).where("tid = '2024K1'"), "omrade", "indhold") == [("101", 30.0), ("147", 5.0)]
    check = cube.additivity_check(facts, "kon", "TOT", ["omrade", "tid"])
    assert check.where("difference > 1e-9").count() == 0


def test_totals_by_table(spark, rows):
    many = small(spark).withColumn("table_id", F.lit("a")).unionByName(small(spark).withColumn("table_id", F.lit("b")))
    totals = spark.createDataFrame([("a", "kon", "TOT"), ("a", "omrade", "000")], "table_id string, column_name string, code string")
    got = cube.pin_totals_by_table(many, totals, ["omrade", "kon"], ["omrade"])
    assert rows(got.groupBy("table_id").count()) == [("a", 4), ("b", 16)]


def test_shares_and_changes(spark, rows):
    facts = small(spark)
    shares = cube.conditional_share(facts, ["omrade", "tid"], "kon", "K", "TOT").where("omrade = '101'")
    assert [round(r.share, 3) for r in shares.collect()] == [66.667, 66.667]
    none = cube.conditional_share(facts.where("kon <> 'TOT'"), ["omrade"], "kon", "K", "TOT")
    assert {r.share for r in none.collect()} == {None}
    series = facts.where("omrade = '000' AND kon = 'TOT'").select("omrade", "tid", "indhold")
    last = cube.latest_with_change(series, ["omrade"], "tid", "indhold").first()
    assert (last.tid, last.indhold, last.change) == ("2024K2", 70.0, 1.0)
    assert rows(cube.indexed_series(series, ["omrade"], "tid", "indhold"), "tid", "index_value") == [("2024K1", 100.0), ("2024K2", 200.0)]
    assert rows(cube.indexed_series(series, ["omrade"], "tid", "indhold", base="2024K2"), "tid", "index_value") == [("2024K1", 50.0), ("2024K2", 100.0)]


def test_bands_and_shapes(spark, rows):
    ages = spark.createDataFrame([(0,), (4,), (5,), (99,)], "a int")
    assert [r[0] for r in ages.select(cube.band(F.col("a"), 5, 90)).collect()] == ["0-4", "0-4", "5-9", "90+"]
    codes = spark.createDataFrame([("B1",), ("B12",), ("A1",), ("TOT",)], "c string")
    assert rows(codes.where(cube.code_shape("c", length=2, like="B%"))) == [("B1",)]
    assert rows(codes.where(cube.code_shape("c", not_like="B%", not_among=("TOT",)))) == [("A1",)]


def test_top_bottom(spark, rows):
    df = spark.createDataFrame([("g", str(i), i % 5) for i in range(10)], "g string, id string, v int")
    got = rows(cube.top_bottom_n(df, ["g"], "v", "id", 2), "side", "rank", "id")
    assert got == [("bottom", 1, "0"), ("bottom", 2, "5"), ("top", 1, "4"), ("top", 2, "9")]


def test_code_choices(spark, rows):
    codes = spark.createDataFrame([(c,) for c in ("2009K4", "2010K1", "2010K2", "2015K4", "2016K1", "a.b")], "c string")
    assert rows(cube.select_codes(codes, "c", [">=2010K1<=2015K4"])) == [("2010K1",), ("2010K2",), ("2015K4",)]
    assert rows(cube.select_codes(codes, "c", ["*K1"])) == [("2010K1",), ("2016K1",)]
    assert rows(cube.select_codes(codes, "c", [">=2016K1", "<=2009K4", "a.*"])) == [("2009K4",), ("2016K1",), ("a.b",)]
    assert cube.select_codes(codes, "c", ["*"]).count() == 6


@pytest.mark.parametrize(
    "rule, want",
    [("(1)", [10]), ("(2)", [9]), ("(-n+3)", [8, 9, 10]), ("-(-n+3)", [1, 2, 3]), ("-(1)", [1]), ("-(2)", [2]), ("first(1)", [1]), ("last(1)", [10]),
     ("(2n)", [1, 3, 5, 7, 9]), ("(3n+1)", [1, 4, 7, 10]), ("+(n+9)", [1, 2])],
)
def test_nth_rules(spark, rule, want):
    df = spark.createDataFrame([("t", i, str(i + 1)) for i in range(10)], "table_id string, pos bigint, tid string")
    assert sorted(int(r.tid) for r in cube.nth_periods(df, [rule]).collect()) == want


def test_rules_mix_without_duplicates(spark):
    df = spark.createDataFrame([("t", i, str(i)) for i in range(4)], "table_id string, pos bigint, tid string")
    assert cube.nth_periods(df, ["(1)", "(-n+2)", "(1)"]).count() == 2
    with pytest.raises(ValueError):
        cube.nth_periods(df, ["latest"])


def test_arithmetic_and_percent(spark, rows):
    facts = small(spark).where("tid = '2024K1' AND omrade = '101'")
    got = {op: cube.code_arithmetic(facts, ["tid"], "kon", op, ["K", "M"], "x").first().indhold for op in ("sum", "subtract", "multiply", "divide")}
    assert got == {"sum": 30.0, "subtract": 10.0, "multiply": 200.0, "divide": 2.0}
    with pytest.raises(ValueError):
        cube.code_arithmetic(facts, ["tid"], "kon", "divide", ["K"], "x")
    based = cube.percent_of_base(facts, ["omrade", "tid"], "kon", base="TOT", per=1000)
    assert sorted(round(r.share) for r in based.collect()) == [333, 667, 1000]
    both = cube.add_as_new_value(based, "content", "count", "permille")
    assert both.count() == 6 and set(both.columns) == {"omrade", "kon", "tid", "content", "indhold"}


def test_densify(spark, rows):
    facts = spark.createDataFrame([("a", "x", 1, 5.0), ("b", "y", 2, 7.0)], "p string, q string, r int, indhold double")
    held = spark.createDataFrame([("a", "y", 2)], "p string, q string, r int")
    got = cube.densify_cube(facts, ["p", "q", "r"], held)
    assert got.count() == 8
    assert rows(got.where("indhold IS NULL OR indhold <> 0"), "p", "q", "r", "indhold") == [("a", "x", 1, 5.0), ("a", "y", 2, None), ("b", "y", 2, 7.0)]


def test_cells_and_distinct_values(spark, rows):
    selected = spark.createDataFrame([("t", "a", str(i)) for i in range(3)] + [("t", "tid", "1"), ("t", "tid", "2")], "table_id string, column_name string, code string")
    assert rows(cube.cell_estimate(selected)) == [("t", 6, 3, 18, True)]
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 2)], "a string, b int")
    assert rows(catalog.distinct_values(df, ["a", "b"])) == [("a", "x"), ("b", "1"), ("b", "2")]


def test_subject_tree(spark, rows):
    nodes = spark.createDataFrame(
        [("0", None, "Root Bank"), ("1", "0", "Borgere Her"), ("2", "1", "Befolkning"), ("3", "2", "Tal"), ("4", "1", "Tom"), ("5", "0", "Leaf"),
         ("6", "2", "Inner"), ("7", "6", "Deep")],
        "id string, parent_id string, description string",
    )
    tables = spark.createDataFrame([("3", "A1"), ("3", "A2"), ("5", "B"), ("6", "X"), ("7", "C")], "id string, table_id string")
    paths = catalog.subject_paths(nodes, tables, "0")
    assert rows(paths) == [("borgere_her/befolkning/inner/deep", "C"), ("borgere_her/befolkning/tal", "A1"), ("borgere_her/befolkning/tal", "A2"), ("leaf", "B")]
    assert rows(catalog.subject_listing(paths)) == [("borgere_her", "befolkning")]


def test_subject_tree_of_any_depth_with_a_cycle(spark, rows):
    chain = [(str(k), str(k - 1), f"n{k}") for k in range(1, 41)] + [("a", "b", "a"), ("b", "a", "b"), ("1", "40", "again")]
    nodes = spark.createDataFrame(chain, "id string, parent_id string, description string")
    tables = spark.createDataFrame([("b", "Y")], "id string, table_id string")
    assert rows(catalog.subject_paths(nodes, tables, "0")) == []
    nodes = nodes.where("description <> 'again'")
    tables = spark.createDataFrame([("40", "X")], "id string, table_id string")
    assert rows(catalog.subject_paths(nodes, tables, "0"), "table_id") == [("X",)]


def test_column_lists_replace_all_of_a_table(spark, tmp_path, rows):
    schema = "table_id string, column_name string, pos bigint, id string, text string"
    first = spark.createDataFrame([("a", "x", 0, "1", "one"), ("a", "y", 0, "2", "two"), ("b", "x", 0, "3", "three")], schema)
    catalog.write_column_values(first, str(tmp_path))
    catalog.write_column_values(first.where("table_id = 'a' and column_name = 'x'"), str(tmp_path))
    assert rows(spark.read.schema(schema).parquet(str(tmp_path)), "table_id", "column_name") == [("a", "x"), ("b", "x")]

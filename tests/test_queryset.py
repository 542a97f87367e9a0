import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import queryset as qs
from cubeloom.suite.query_sets import BY_FLAG, BY_MONTH, FLAGS, busiest_month, units_shipped


@pytest.fixture
def shipments(spark):
    rows = [
        ("1996-03-01", "A", "F", 40, 4), ("1996-03-01", "N", "O", 5, 1), ("1996-04-01", "A", "F", 30, 6),
        ("1996-05-01", "N", "O", 11, 2), ("1996-05-01", "A", "O", 50, 3),
    ]
    df = spark.createDataFrame(rows, "month string, flag string, status string, units bigint, lines bigint")
    return qs.QuerySet(
        "shipments",
        {"shipments": df.withColumn("month", F.col("month").cast("date"))},
        {"flags": FLAGS, "by_month": BY_MONTH, "by_flag": BY_FLAG},
        {
            "units_shipped": qs.Output(("by_month",), units_shipped), "busiest_month": qs.Output(("by_month",), busiest_month),
            "flag_table": qs.Output(("by_flag",), lambda by_flag: by_flag),
        },
        (*qs.choice("flag", options="flags"), *qs.day_range("month"), *qs.flag("open_only")),
    )


def test_parameters_skip_casts():
    text = "SELECT a::int FROM t WHERE b = COALESCE(:shape, b) AND d >= :day_from"
    assert qs.extract_params(text) == {"shape", "day_from"}


def test_binding():
    assert qs.bind_value("shape", "all") is None and qs.bind_value("x", None) is None
    assert qs.bind_value("open", True) is True
    assert qs.bind_value("day_from", "1997-02-03") == dt.date(1997, 2, 3)
    assert qs.bind_value("shape", 3) == "3"
    assert qs.bind_value("customer", "c", str) == "c"
    with pytest.raises(ValueError):
        qs.bind_value("customer", "c")
    assert qs.bound_args("a = :b", {"c": 1}) == {"b": None}


def test_values_of_parameters(shipments):
    assert shipments.filter_values({}) == {"flag": "all", "month_from": None, "month_to": None, "open_only": False}
    given = {"flag": "A", "month_to": "", "open_only": "TRUE", "other": "x"}
    assert shipments.filter_values(given) == {"flag": "A", "month_from": None, "month_to": None, "open_only": True}


def test_filtered_metrics(spark, shipments):
    filters = shipments.filter_values({"flag": "A", "month_from": "1996-03-15"})
    shipped = qs.run_output(spark, shipments, "units_shipped", filters).frame.first()
    assert (shipped.value, shipped.change) == (80, pytest.approx(2 / 3, abs=1e-6))
    assert qs.run_output(spark, shipments, "busiest_month", filters).frame.first().value == "1996-04"
    months = qs.run_query(spark, shipments, "by_month", filters)
    assert dict(months.dtypes)["month"] == "timestamp_ntz" and months.count() == 2


def test_flag_and_table(spark, shipments, rows):
    on = shipments.filter_values({"open_only": "true"})
    assert rows(qs.run_output(spark, shipments, "flag_table", on), "flag", "lines", "most") == [("A", 3, 50.0), ("N", 3, 11.0)]
    with pytest.raises(KeyError):
        qs.run_output(spark, shipments, "nothing", on)


def test_options(spark, rows):
    two = spark.createDataFrame([(7, "seven"), (8, None), (None, None)], "code int, name string")
    assert rows(qs.option_list(two)) == [("", ""), ("7", "seven"), ("8", "8")]
    one = spark.createDataFrame([("x",), ("y",)], "r string")
    assert rows(qs.option_list(one)) == [("x", "x"), ("y", "y")]


def test_unknown_queries():
    with pytest.raises(ValueError, match="no query of the set: b, c"):
        qs.QuerySet("x", {}, {"a": "SELECT 1"}, {"o": qs.Output(("a", "c"), print)}, qs.choice("f", options="b"))


def test_validation_status(spark, shipments):
    broken = qs.QuerySet(
        "b", shipments.tables,
        {"empty": "SELECT * FROM shipments WHERE flag = 'Z'", "bad": "SELECT nothing FROM shipments", "ok": FLAGS,
         "runtime": "SELECT CAST(flag AS INT) AS x FROM shipments"},
        {"none": qs.Output(("empty",), lambda empty: empty), "fails": qs.Output(("ok",), lambda ok: 1 / 0),
         "zero": qs.Output(("ok",), lambda ok: qs.metric(ok.agg(F.lit(0).alias("v")), "v", "Zero")),
         "blank": qs.Output(("ok",), lambda ok: qs.metric(ok.agg(F.lit(" ").alias("v")), "v", "Blank"))},
        shipments.parameters[1:],
    )
    unset = {r.name: (r.kind, r.rows, r.status) for r in qs.validate_set(spark, broken, {}).collect()}
    assert unset == {
        "empty": ("query", 0, "error"), "bad": ("query", None, "error"), "ok": ("query", 2, "ok"), "runtime": ("query", None, "error"),
        "none": ("table", None, "error"), "fails": ("output", None, "error"), "zero": ("metric", None, "ok"), "blank": ("metric", None, "error"),
    }
    told = {r.name: (r.status, r.message) for r in qs.validate_set(spark, broken, {"open_only": "true"}).collect()}
    assert told["empty"] == ("warning", "query empty came out empty") and told["none"] == ("warning", "table none came out empty")
    assert told["bad"][0] == "error" and "division by zero" in told["fails"][1] and told["ok"] == ("ok", None)


def test_invalid_filter_values(spark, rows):
    offered = [("size", 9 - i, f"S{i}") for i in range(7)] + [("size", 0, "S3"), ("hue", 0, "red")]
    options = spark.createDataFrame(offered, "filter_name string, pos int, value string")
    chosen = spark.createDataFrame(
        [("size", "S3", "all"), ("size", "X", "all"), ("size", "all", "all"), ("hue", "", "all"), ("hue", None, "all"), ("hue", "red", "all")],
        "filter_name string, value string, default string",
    )
    assert rows(qs.invalid_filter_values(options, chosen)) == [("size", "X", "S3, S6, S5, S4, S2")]


def test_filter_key():
    assert qs.filter_key({}) == "_"
    assert qs.filter_key({"b": "2", "a": "x y"}) == "a=x+y&b=2"


def test_snapshot_replaces_its_own_key(spark, shipments, tmp_path, rows):
    folder = str(tmp_path)
    assert qs.snapshot(spark, shipments, {}, folder) == "_"
    for _ in range(2):
        qs.snapshot(spark, shipments, {"flag": "A"}, folder)
    metrics = spark.read.parquet(f"{folder}/metrics")
    assert rows(metrics, "filter_key", "name", "value") == [
        ("_", "busiest_month", "1996-04"), ("_", "units_shipped", "136"), ("flag=A", "busiest_month", "1996-04"), ("flag=A", "units_shipped", "120")
    ]
    gone = {"flag_table": qs.Output(("by_flag",), lambda by_flag: by_flag.where("false"))}
    qs.snapshot(spark, replace(shipments, outputs=gone), {"flag": "A"}, folder)
    assert rows(spark.read.parquet(f"{folder}/tables/flag_table"), "filter_key", "flag") == [("_", "A"), ("_", "N")]

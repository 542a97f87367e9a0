import pytest
from pyspark.sql import functions as F

from cubeloom.functions.periods import (
    contains_point, int_range, int_range_strict, overlaps, parse_range_text, range_text,
)
from cubeloom.operators import delta, sync

LISTS = "table_id string, pos bigint, tid string"


def lists(spark, **tables):
    return spark.createDataFrame([(t, i, c) for t, codes in tables.items() for i, c in enumerate(codes)], LISTS)


def test_frequency_of_each_form(spark):
    df = lists(
        spark, a=["2024"], b=["2024K4"], c=["2024M12"], d=["2024U52"], e=["2024M12D31"], f=["2024H2"], g=["2024/2025"],
        h=["2024K1", ""], i=["", None], j=["2024M01", "2024"],
    )
    got = {r.table_id: r.frequency for r in sync.infer_frequency(df).collect()}
    assert got == {
        "a": "yearly", "b": "quarterly", "c": "monthly", "d": "weekly", "e": "daily", "f": "half_yearly",
        "g": "other", "h": "quarterly", "i": "other", "j": "yearly",
    }


def test_override_wins_if_known(spark):
    df = lists(spark, a=["2024"], b=["2024"])
    over = spark.createDataFrame([("a", "monthly"), ("b", "hourly")], "table_id string, frequency string")
    got = {r.table_id: (r.frequency, r.overridden) for r in sync.resolve_frequency(df, over).collect()}
    assert got == {"a": ("monthly", True), "b": ("yearly", False)}


def test_pick_periods(spark, rows):
    months = [f"2024M{m:02d}" for m in range(1, 13)]
    remote = lists(spark, boot=["1", "2", "3", "4"], other=[f"t{i}" for i in range(1, 11)], month=months)
    local = spark.createDataFrame(
        [("other", f"t{i}") for i in range(1, 9)] + [("month", m) for m in months], "table_id string, tid string"
    )
    freq = spark.createDataFrame(
        [("boot", "other"), ("other", "other"), ("month", "monthly")], "table_id string, frequency string"
    )
    got = sync.pick_periods(remote, local, freq)
    by = {}
    for r in got.orderBy("table_id", "pos").collect():
        by.setdefault(r.table_id, []).append(r.tid)
    assert by == {"boot": ["1", "2", "3", "4"], "other": ["t9", "t10"], "month": months[-3:]}


def test_batches_respect_row_bound(spark, rows):
    picked = lists(spark, a=[str(i) for i in range(5)], b=["x", "y"]).withColumn("reason", F.lit("new"))
    est = spark.createDataFrame([("a", 40), ("b", 1000)], "table_id string, rows_per_period bigint")
    got = rows(sync.period_batches(picked, est, max_rows=100), "table_id", "tid", "batch")
    assert got == [("a", "0", 0), ("a", "1", 0), ("a", "2", 1), ("a", "3", 1), ("a", "4", 2), ("b", "x", 0), ("b", "y", 1)]


META = "table_id string, variables array<struct<id:string,values:array<struct<id:string,text:string>>>>"


def test_metadata_periods_and_estimate(spark, rows):
    meta = spark.createDataFrame(
        [
            ("a", [("ALDER", [("IALT", "t"), ("0", "z"), ("1", "o")]), ("Tid", [("2024K1", ""), ("2024K2", "")])]),
            ("none", [("ALDER", [("0", "z")])]),
            ("empty", [("TID", [])]),
        ],
        META,
    )
    assert rows(sync.metadata_periods(meta)) == [("a", 0, "2024K1"), ("a", 1, "2024K2")]
    assert rows(sync.metadata_problems(meta)) == [("empty", "no period values"), ("none", "no period variable")]
    assert ("a", 2, 3) in rows(sync.estimate_rows(meta))
    scalar = spark.createDataFrame([("s", [("tid", ["2023", "2024"])])], "table_id string, variables array<struct<id:string,values:array<string>>>")
    assert rows(sync.metadata_periods(scalar)) == [("s", 0, "2023"), ("s", 1, "2024")]


def test_changed_tables_null_equals_null(spark, rows):
    schema = "table_id string, updated string"
    catalog = spark.createDataFrame([("same", "1"), ("new", "2"), ("moved", "3"), ("never", None)], schema)
    state = spark.createDataFrame([("same", "1"), ("moved", "2")], schema)
    assert rows(sync.changed_tables(catalog, state), "table_id") == [("moved",), ("new",)]


def test_state_moves_only_for_synced(spark, rows):
    out = spark.createDataFrame(
        [("a", "2", "yearly", "synced"), ("b", "2", "yearly", "failed"), ("c", "2", "yearly", "skipped")],
        "table_id string, updated string, frequency string, status string",
    )
    state = spark.createDataFrame([("a", "1", "other"), ("b", "1", "other")], "table_id string, updated string, frequency string")
    assert rows(sync.advance_state(state, out)) == [("a", "2", "yearly"), ("b", "1", "other")]
    assert rows(sync.sync_report(out)) == [(3, 1, 1, 1)]


def test_period_forms(spark):
    df = lists(
        spark, q=["2024K4"], d=["2024M03D05"], h=["2024H2", "2024H1"], m=["2024M03"], s=["2021:2023"], y=["2024"],
        old=["1700"], w=["2021U52"], split=["2023/2024"],
    )
    got = {(r.table_id, r.tid): r.tid_text for r in delta.clean_periods(df, pos="pos").collect()}
    assert got == {
        ("q", "2024K4"): "2024-10-01", ("d", "2024M03D05"): "2024-03-05", ("h", "2024H2"): "2024-07-01",
        ("h", "2024H1"): "2024-01-01", ("m", "2024M03"): "2024-03-01", ("s", "2021:2023"): "[2021,2024)",
        ("y", "2024"): "2024-01-01", ("old", "1700"): "1700", ("w", "2021U52"): "2021U52", ("split", "2023/2024"): "2023/2024",
    }


def test_first_code_decides_and_misfits_are_reported(spark):
    df = lists(spark, a=["2024K1", "2024", None], b=["2024M13D01"], c=["2024M02D30"])
    got = {(r.table_id, r.tid): r.tid_rejected for r in delta.clean_periods(df, pos="pos", strict=False).collect()}
    assert got == {
        ("a", "2024K1"): False, ("a", "2024"): True, ("a", None): False, ("b", "2024M13D01"): True, ("c", "2024M02D30"): True,
    }
    with pytest.raises(Exception, match="does not fit"):
        delta.clean_periods(df, pos="pos").collect()


def test_whole_number_years(spark, rows):
    years = spark.createDataFrame([("a", 2023), ("a", 2024)], "table_id string, tid int")
    assert rows(delta.clean_periods(years), "tid_text") == [("2023-01-01",), ("2024-01-01",)]
    with pytest.raises(Exception, match="not a year"):
        delta.clean_periods(spark.createDataFrame([("a", 12)], "table_id string, tid int")).collect()


def test_empty_in_empty_out(spark):
    assert delta.clean_periods(lists(spark), pos="pos").count() == 0


def test_single_table_without_keys(spark, rows):
    df = spark.createDataFrame([("2024K1",), ("2024K2",)], "tid string")
    assert rows(delta.clean_periods(df, keys=[]), "tid_text") == [("2024-01-01",), ("2024-04-01",)]


def test_integer_ranges(spark):
    texts = ["20-24", "100-", "85OV", " 0-4 ", "5-3", "IALT", "", None, "5-5", "x-4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", range_text(int_range(F.col("t"))).alias("r"))
    got = {r.t: r.r for r in df.collect()}
    assert got == {
        "20-24": "[20,25)", "100-": "[100,)", "85OV": "[85,)", " 0-4 ": "[0,5)", "5-3": None, "IALT": None, "": None, None: None,
        "5-5": "[5,6)", "x-4": None,
    }
    with pytest.raises(Exception, match="not an integer range"):
        spark.createDataFrame([("5-3",)], "t string").select(int_range_strict(F.col("t"))).collect()


def test_range_predicates(spark):
    df = spark.createDataFrame([("[20,25)", "[24,30)"), ("[20,25)", "[25,)"), ("[85,)", "[0,85)"), ("[85,)", "[0,86)")], "a string, b string")
    a, b = parse_range_text(F.col("a")), parse_range_text(F.col("b"))
    got = df.select(overlaps(a, b), contains_point(a, F.lit(24)), contains_point(a, F.lit(900))).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, True, False), (False, False, True), (True, False, True)]


def test_changed_periods_are_normalised_once(spark, rows):
    df = lists(spark, a=["2025M03", "2025M04"], b=["2025M03", "2025M03"])
    assert rows(delta.normalize_periods(df)) == [("a", 0, "2025-03-01"), ("a", 1, "2025-04-01"), ("b", 0, "2025-03-01")]


FACT = "table_id string, tid_text string, indhold double"


def test_delta_replaces_and_skips(spark, rows):
    target = spark.createDataFrame(
        [("a", "2024-01-01", 1.0), ("a", "2025-01-01", 2.0), ("a", "2025-01-01", 3.0), ("z", "2024-01-01", 9.0)], FACT
    )
    reloaded = spark.createDataFrame([("a", "2025-01-01", 20.0)], FACT)
    changed = lists(spark, a=["2025", "2026"], z=["2024"])
    manifest = spark.createDataFrame([("a", "2025")], "table_id string, tid string")
    keys = delta.normalize_periods(delta.loadable_changes(changed, manifest))
    assert rows(delta.apply_delta(target, reloaded, keys)) == [
        ("a", "2024-01-01", 1.0), ("a", "2025-01-01", 20.0), ("z", "2024-01-01", 9.0)
    ]
    assert rows(delta.delta_report(target, reloaded, changed, manifest)) == [
        ("a", "applied", None, 2, 1, 1), ("z", "skipped", "no_partition_data", 0, 0, 1)
    ]


def test_changed_period_without_file_is_still_deleted(spark, rows):
    target = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2025-01-01", 2.0)], FACT)
    reloaded = spark.createDataFrame([("a", "2025-01-01", 5.0)], FACT)
    keys = delta.normalize_periods(
        delta.loadable_changes(lists(spark, a=["2024", "2025"]), spark.createDataFrame([("a", "2025")], "table_id string, tid string"))
    )
    assert rows(delta.apply_delta(target, reloaded, keys)) == [("a", "2025-01-01", 5.0)]


def test_backfill_plan(spark, rows):
    manifest = spark.createDataFrame(
        [("new", "2024"), ("part", "2024"), ("part", "2025"), ("full", "2024")], "table_id string, tid string"
    )
    stored = spark.createDataFrame([("part", "2024-01-01"), ("full", "2024-01-01")], "table_id string, tid_text string")
    assert rows(delta.backfill_plan(manifest, stored)) == [("full", "none", 1, 0), ("new", "create", 1, 1), ("part", "backfill", 2, 1)]


def test_extent_of_dates_ranges_and_text(spark, rows):
    df = lists(spark, d=["2024K1", "2024K3"], s=["2019:2020", "2021:2023"], w=["2021U01", "2021U52"])
    assert rows(delta.period_extent(delta.clean_periods(df, pos="pos"))) == [
        ("d", "2024-01-01", "2024-07-01"), ("s", "2019", "2024"), ("w", "2021U01", "2021U52")
    ]

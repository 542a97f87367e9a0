"""Shapes that matter at scale, read from the plans."""

import pytest

from cubeloom.operators import cube, delta
from cubeloom.sources import delta_files, layout
from cubeloom.suite import all_queries

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_column_is_read(spark):
    text = plan(all_queries()["scan_columns"](spark, DATA))
    assert "ReadSchema: struct<l_returnflag:string>" in text


ROW, KEY = "table_id string, tid string, v int", "table_id string, tid string"


@pytest.fixture(params=["default", "-1"])
def either_join(spark, request):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    if request.param != "default":
        spark.conf.set(name, request.param)
    yield spark
    spark.conf.set(name, before)


def folders(df):
    return sorted("/".join(f.split("/")[-3:-1]) for f in df.inputFiles())


def test_only_wanted_periods_are_listed(either_join, tmp_path):
    spark, root = either_join, str(tmp_path / "p")
    data = [(t, str(p), p) for t in ("a", "b") for p in range(20)]
    layout.write_periods(spark.createDataFrame(data, ROW), root, version=1)
    layout.write_periods(spark.createDataFrame([("b", "7", 70)], ROW), root, version=2)
    wanted = [("a", "3"), ("b", "7"), ("b", "99")]
    literal = spark.createDataFrame(wanted, KEY)
    literal.write.parquet(str(tmp_path / "keys"))
    for keys in (literal, spark.read.parquet(str(tmp_path / "keys"))):
        found, missing = layout.load_periods(spark, root, keys)
        assert folders(found) == ["table_id=a/tid=3", "table_id=b/tid=7"]
        assert sorted(r["v"] for r in found.collect()) == [3, 70] and missing.count() == 1
        assert "Join" not in plan(found)
    assert folders(layout.scan_periods(spark, root, "a", ["1", "5"])) == ["table_id=a/tid=1", "table_id=a/tid=5"]


def test_delta_reads_and_cleans_changed_periods_only(either_join, tmp_path):
    spark, raw_root, stored_root = either_join, str(tmp_path / "raw"), str(tmp_path / "stored")
    layout.write_periods(spark.createDataFrame([("a", f"{y}K1", y) for y in range(2000, 2020)], ROW), raw_root)
    layout.write_periods(spark.createDataFrame([("a", f"{y}-01-01", -y) for y in range(1999, 2018)], ROW), stored_root)
    seen = []

    def clean(raw, codes):
        seen.append(folders(raw))
        return delta.clean_periods(raw, codes=codes)

    changed = spark.createDataFrame([("a", 0, "2003K1"), ("a", 1, "2004K1"), ("a", 2, "2050K1")], "table_id string, pos bigint, tid string")
    got = delta_files.apply_delta(spark, raw_root, stored_root, changed, clean).collect()
    assert [tuple(r) for r in got] == [("a", "applied", None, 2, 2, 1)]
    added = delta_files.backfill(spark, raw_root, stored_root, clean)
    assert sorted(r["tid"] for r in added.collect()) == ["2018-01-01", "2019-01-01"]
    assert seen == [["table_id=a/tid=2003K1", "table_id=a/tid=2004K1"], ["table_id=a/tid=2018K1", "table_id=a/tid=2019K1"]]
    assert {r["v"] for r in layout.read_periods(spark, stored_root).collect()} == {2003, 2004, 2018, 2019, *(-y for y in range(1999, 2018) if y not in (2003, 2004))}


def test_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id", "id AS v")
    assert plan(cube.top_bottom_n(df, ["g"], "v", "id", 2)).count("WindowGroupLimit") == 4

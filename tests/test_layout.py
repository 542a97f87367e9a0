import json

import pytest
from pyspark.sql import functions as F

from cubeloom.sources import files, layout, tables
from cubeloom.streaming.ledger_feed import post_charges
from cubeloom.streaming.period_feed import replace_periods, stream_files

ROW = "table_id string, tid string, v int"


def test_period_names_round_trip(spark, tmp_path, rows):
    root = str(tmp_path / "p")
    data = [("a", "2024", 1), ("a", "007", 2), ("a", "2021:2023", 3), ("a", "2023/2024", 4)]
    written = layout.write_periods(spark.createDataFrame(data, ROW), root)
    assert rows(written) == sorted((t, p, 1) for t, p, _ in data)
    assert rows(layout.read_periods(spark, root), "table_id", "tid", "v") == sorted(data)
    assert rows(layout.scan_periods(spark, root, "a", ["007", "2099"]), "v") == [(2,)]


def test_replaced_emptied_and_requested_periods(spark, tmp_path, rows):
    root = str(tmp_path / "p")
    layout.write_periods(spark.createDataFrame([("a", "1", 1), ("a", "1", 2), ("a", "2", 3), ("b", "1", 4)], ROW), root, version=1)
    asked = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "9")], "table_id string, tid string")
    layout.write_periods(spark.createDataFrame([("a", "1", 10)], ROW), root, asked, version=2)
    assert rows(layout.read_periods(spark, root), "table_id", "tid", "v") == [("a", "1", 10), ("b", "1", 4)]
    assert rows(layout.manifest(spark, root)) == [("a", "1", 1), ("a", "2", 0), ("a", "9", 0), ("b", "1", 1)]
    assert layout.local_periods(layout.manifest(spark, root)).collect()[0].tid == "1"
    found, missing = layout.load_periods(spark, root, spark.createDataFrame([("a", "1"), ("a", "9"), ("c", "1")], "table_id string, tid string"))
    assert rows(found, "v") == [(10,)] and rows(missing) == [("c", "1")]
    layout.write_periods(spark.createDataFrame([("a", "2", 30)], ROW), root, version=3)
    assert rows(layout.read_periods(spark, root).where("table_id = 'a'"), "v") == [(10,), (30,)]


def test_replace_writes_changed_periods_only(spark, tmp_path, rows):
    root = str(tmp_path / "p")
    layout.write_periods(spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("a", "3", 3)], ROW), root, version=1)
    changed = spark.createDataFrame([("a", "2"), ("a", "3")], "table_id string, tid string")
    reloaded = spark.createDataFrame([("a", "1", 100), ("a", "2", 20)], ROW)
    assert rows(layout.replace_periods(reloaded, root, changed, version=2)) == [("a", "2", 1), ("a", "3", 0)]
    assert rows(layout.read_periods(spark, root), "v") == [(1,), (20,)]


def test_skewed_period_is_split_over_files(spark, tmp_path):
    root = str(tmp_path / "p")
    df = spark.range(1000).select(F.lit("a").alias("table_id"), F.lit("1").alias("tid"), "id")
    layout.write_periods(df, root, max_records_per_file=300)
    assert len(list((tmp_path / "p" / "facts").glob("version=*/table_id=a/tid=1/*.parquet"))) >= 4


KEY = "table_id string, tid string"


def test_names_of_any_kind_are_found(spark, tmp_path, rows):
    root = str(tmp_path / "p")
    names = ["a b", "x=y", "50%", "q?*", "[1]{2}", "it's", 'say "so"', "back\\slash", "æøå", "a/b:c#d", "tab\there", "^caret", "plus+", None]
    data = [(t, p, i) for i, (t, p) in enumerate(zip(names, reversed(names)))]
    layout.write_periods(spark.createDataFrame(data, ROW), root)
    assert rows(layout.read_periods(spark, root), "table_id", "tid", "v") == sorted(data, key=repr)
    for t, p, i in data[:-1]:
        if p is not None:
            assert rows(layout.scan_periods(spark, root, t, [p]), "v") == [(i,)]


def test_load_that_broke_off_is_not_seen(spark, tmp_path, rows, monkeypatch):
    root = str(tmp_path / "p")
    layout.write_periods(spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], ROW), root, version=1)

    def broken(*args):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(layout, "period_manifest", broken)
        with pytest.raises(RuntimeError, match="gone"):
            layout.write_periods(spark.createDataFrame([("a", "2", 20), ("a", "3", 30)], ROW), root, version=2)
    assert (tmp_path / "p" / "facts" / "version=2").exists()
    assert rows(layout.read_periods(spark, root), "tid", "v") == [("1", 1), ("2", 2)]
    assert rows(layout.manifest(spark, root)) == [("a", "1", 1), ("a", "2", 1)]
    layout.write_periods(spark.createDataFrame([("a", "3", 33)], ROW), root, version=2)
    assert rows(layout.read_periods(spark, root), "tid", "v") == [("1", 1), ("2", 2), ("3", 33)]
    with pytest.raises(ValueError, match="published already"):
        layout.write_periods(spark.createDataFrame([("a", "3", 0)], ROW), root, version=2)


def test_reader_during_a_replacement_sees_one_state(spark, tmp_path, rows):
    root = str(tmp_path / "p")
    layout.write_periods(spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], ROW), root, version=1)
    before = layout.read_periods(spark, root)
    layout.replace_periods(spark.createDataFrame([("a", "1", 10)], ROW), root, spark.createDataFrame([("a", "1"), ("a", "2")], KEY), version=2)
    assert rows(before, "v") == [(1,), (2,)] and rows(layout.read_periods(spark, root), "v") == [(10,)]
    # a replacement may read what it replaces
    more = layout.read_periods(spark, root).withColumn("v", F.col("v") + 1)
    layout.write_periods(more.select("table_id", "tid", "v"), root, version=3)
    assert rows(layout.read_periods(spark, root), "v") == [(11,)]
    (tmp_path / "p" / "facts" / "version=0").mkdir()
    assert layout.drop_superseded(spark, root, before=3) == 4
    assert rows(layout.read_periods(spark, root), "v") == [(11,)] and rows(layout.manifest(spark, root)) == [("a", "1", 1), ("a", "2", 0)]


def test_input_runs_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def mark(batches):
        for b in batches:
            with open(seen, "a") as f:
                f.write(f"{len(b)}\n")
            yield b

    df = spark.createDataFrame([("a", str(i % 3), i) for i in range(90)], ROW).coalesce(1).mapInPandas(mark, ROW)
    layout.write_periods(df, str(tmp_path / "p"))
    assert sum(map(int, open(seen).read().split())) == 90


def test_older_files_lack_a_column(spark, tmp_path, rows):
    root = str(tmp_path / "p")
    layout.write_periods(spark.createDataFrame([("a", "1", 1)], ROW), root, version=1)
    layout.write_periods(spark.createDataFrame([("a", "2", 2, "n")], ROW + ", note string"), root, version=2)
    assert rows(layout.read_periods(spark, root), "tid", "v", "note") == [("1", 1, None), ("2", 2, "n")]
    nothing = layout.load_periods(spark, root, spark.createDataFrame([("z", "1")], KEY))
    assert nothing[0].columns == layout.read_periods(spark, root).columns and nothing[0].collect() == [] and rows(nothing[1]) == [("z", "1")]
    assert layout.read_periods(spark, str(tmp_path / "none")).collect() == []


def test_migration(spark, tmp_path, rows):
    root = str(tmp_path / "p")
    legacy = spark.createDataFrame(
        [("a", "s1", "2024", 1), ("a", "s1", "2024", 2), ("a", "s1", "2025", 3), ("a", "s2", "2025", 4), ("a", "s2", "2026", 5)],
        "table_id string, source string, tid string, v int",
    )
    assert rows(layout.migrate_layout(legacy, root, dry_run=True)) == [("a", "s1", 3, 2, 2, 0), ("a", "s2", 2, 2, 2, 0)]
    assert rows(layout.manifest(spark, root)) == []
    assert rows(layout.migrate_layout(legacy, root)) == [("a", "s1", 3, 2, 2, 0), ("a", "s2", 2, 2, 1, 1)]
    assert rows(layout.read_periods(spark, root), "v") == [(1,), (2,), (3,), (5,)]
    assert rows(layout.migrate_layout(legacy, root)) == [("a", "s1", 3, 2, 0, 2), ("a", "s2", 2, 2, 0, 2)]
    layout.migrate_layout(legacy, root, overwrite=True)
    assert rows(layout.read_periods(spark, root), "v") == [(1,), (2,), (4,), (5,)]


def test_bulk_csv_with_mark_and_decimal_comma(spark, tmp_path, rows):
    path = tmp_path / "bulk.csv"
    path.write_text("﻿OMRÅDE;TID;INDHOLD\n000;2024K1;12,5\n101;2024K1;..\n", encoding="utf-8")
    got = files.read_bulk_csv(spark, str(path), ["OMRÅDE", "TID", "INDHOLD"], ("INDHOLD",))
    assert rows(got) == [("000", "2024K1", 12.5), ("101", "2024K1", None)]


def test_bulk_csv_refuses_other_text(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("A;INDHOLD\n1;oops\n2;\n", encoding="utf-8")
    got = files.read_bulk_csv(spark, str(tmp_path / "bad.csv"), ["A", "INDHOLD"], ("INDHOLD",))
    with pytest.raises(Exception, match="not a measure: oops"):
        got.collect()
    assert got.where("A = '2'").first().INDHOLD is None


def test_bulk_csv_by_header_with_rejects(spark, tmp_path, rows):
    folder = tmp_path / "bulk"
    folder.mkdir()
    (folder / "a.csv").write_text("\ufeffOMRÅDE;TID;INDHOLD\n000;2024K1;12,5\n101;2024K1\n102;2024K1;1;2\n\n103;2024K1;x\n", encoding="utf-8")
    (folder / "b.csv").write_text('tid;extra;indhold;"område"\r\n2020;"a;b ""c""";..;101\r\n2021;;;"1;02"\r\n', encoding="utf-8")
    (folder / "c.csv").write_text("OMRÅDE;INDHOLD\n7;1\n", encoding="utf-8")
    (folder / "d.csv").write_text("OMRÅDE;TID;INDHOLD\n", encoding="utf-8")
    (folder / "e.csv").write_text("", encoding="utf-8")
    columns = ["OMRÅDE", "TID", "INDHOLD"]
    good, bad = files.read_bulk(spark, str(folder), columns, ("INDHOLD",))
    assert rows(good) == [("000", "2024K1", 12.5), ("101", "2020", None), ("1;02", "2021", None)]
    told = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in bad.collect())
    assert told == [
        ("a.csv", "101;2024K1", "fields are missing"), ("a.csv", "102;2024K1;1;2", "fields too many"), ("a.csv", "103;2024K1;x", "not a measure: x"),
        ("c.csv", "7;1", "no column TID"),
    ]
    assert rows(files.read_bulk_csv(spark, str(folder / "b.csv"), ["OMRÅDE", "TID"])) == [("101", "2020"), ("1;02", "2021")]
    for name, message in (("a.csv", "fields (are missing|too many): 10"), ("c.csv", "no column TID: 7;1")):
        with pytest.raises(Exception, match=message):
            files.read_bulk_csv(spark, str(folder / name), columns).collect()


def test_geojson(spark, tmp_path, rows):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"kode": "0101", "navn": "K"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "kommuner.geojson").write_text(json.dumps(doc, indent=1))
    got = files.read_geojson(spark, str(tmp_path / "kommuner.geojson"), ["kode", "navn"], "kommuner").first()
    assert (got.layer, got.kode, got.navn) == ("kommuner", "0101", "K")
    assert json.loads(got.geometry)["coordinates"] == [1, 2]


def test_typed_load(spark, tmp_path):
    facts = spark.createDataFrame([(1, "[0,5)", "2024-01-01", 1.5)], "omrade bigint, alder string, tid string, indhold double")
    loaded = tables.load_fact(facts.withColumn("tid", F.col("tid").cast("date")), str(tmp_path / "f"))
    assert dict(loaded.dtypes) == {"omrade": "smallint", "alder": "struct<lo:int,hi:int>", "tid": "date", "indhold": "double"}
    assert loaded.first().alder.hi == 5
    dim = spark.createDataFrame([(84, 1, "R", None), (1, 2, "P", 84), (101, 3, "C", 1)], "kode bigint, niveau bigint, titel string, parent_kode bigint")
    kinds = dict(tables.load_dim(dim, str(tmp_path / "d")).dtypes)
    assert kinds == {"kode": "smallint", "niveau": "smallint", "titel": "string", "parent_kode": "smallint"}


def test_one_code_is_found_by_its_filter(spark, tmp_path):
    """Codes that rows are not sorted by: filters of the row groups leave a small share of them to read."""
    code = F.concat(F.lit("c"), F.xxhash64("id").cast("string"))
    facts = spark.range(200_000).select(
        (F.col("id") % 40).alias("omrade"), F.lit("a").alias("kon"), code.alias("firma"), F.lit("2024").alias("tid"), F.lit(1.0).alias("indhold")
    )
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(1 << 18))
    try:
        loaded = tables.load_fact(facts, str(tmp_path / "f"))
    finally:
        hadoop.unset("parquet.block.size")
    wanted = facts.where("omrade = 17").first()["firma"]
    found = loaded.where(F.col("firma") == wanted)
    assert [r["firma"] for r in found.collect()] == [wanted]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 40_000


def test_pending_tables(spark, rows):
    have = spark.createDataFrame([("TAB1A",), ("TAB2B",)], "table_id string")
    assert rows(tables.pending_tables(have, spark.createDataFrame([("tab1a",)], "table_id string"))) == [("tab2b",)]


def test_period_feed_replaces_as_files_arrive(spark, tmp_path, rows):
    inbox, root, ckpt = str(tmp_path / "in"), str(tmp_path / "p"), str(tmp_path / "c")
    first = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], ROW)
    first.coalesce(1).write.parquet(inbox)
    replace_periods(stream_files(spark, inbox, first), root, ckpt).awaitTermination()
    spark.createDataFrame([("a", "2", 20)], ROW).coalesce(1).write.mode("append").parquet(inbox)
    replace_periods(stream_files(spark, inbox, first), root, ckpt).awaitTermination()
    assert rows(layout.read_periods(spark, root), "v") == [(1,), (20,)]


def test_ledger_feed_posts_each_key_once(spark, tmp_path, rows):
    inbox, out, ckpt = str(tmp_path / "in"), str(tmp_path / "l"), str(tmp_path / "c")
    schema = "charge_key bigint, ts timestamp, user_id bigint, amount double"
    make = lambda data: spark.createDataFrame(data, "charge_key bigint, ts string, user_id bigint, amount double").withColumn("ts", F.col("ts").cast("timestamp"))
    first = make([(1, "2024-01-01 00:00:00", 7, 5.0), (1, "2024-01-01 00:01:00", 7, 5.0), (2, "2024-01-01 00:02:00", 7, 3.0)])
    first.coalesce(1).write.parquet(inbox)
    post_charges(stream_files(spark, inbox, first), out, ckpt).awaitTermination()
    make([(2, "2024-01-01 00:03:00", 7, 3.0), (3, "2024-01-01 00:04:00", 7, 1.0)]).coalesce(1).write.mode("append").parquet(inbox)
    post_charges(stream_files(spark, inbox, first), out, ckpt).awaitTermination()
    assert rows(spark.read.schema(schema).parquet(f"{out}/*"), "charge_key", "amount") == [(1, 5.0), (2, 3.0), (3, 1.0)]

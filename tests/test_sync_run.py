"""The sync run: tables fail alone, the limit holds, state moves for synced tables only."""

from cubeloom.sources import layout, sync_run
from pyspark.sql import functions as F

ROW = "table_id string, tid string, indhold string, error string"
CODES = "struct<id:string,text:string>"
META = f"table_id string, variables array<struct<id:string,values:array<{CODES}>>>"


def described(spark, **lists):
    return spark.createDataFrame([(t, [("Tid", [(c, c) for c in codes])] if codes is not None else [("X", [])]) for t, codes in lists.items()], META)


def test_each_table_on_its_own(spark, tmp_path, rows):
    root = str(tmp_path / "p")
    layout.write_periods(spark.createDataFrame([("good", "2023", "1", None), ("bad", "2023", "9", None), ("gone", "2023", "9", None)], ROW).drop("error"), root)
    catalog = spark.createDataFrame(
        list(enumerate(["good", "same", "bad", "gone", "stray", "blank", "undescribed", "new"])), "pos bigint, table_id string"
    ).withColumn("updated", F.lit("2"))
    late = spark.createDataFrame([(99, "late", "2")], "pos bigint, table_id string, updated string")
    state = spark.createDataFrame([("same", "2", "yearly"), ("bad", "1", "other"), ("good", "1", "other")], "table_id string, updated string, frequency string")
    years = ["2023", "2024"]
    meta = described(spark, good=years, same=years, bad=years, gone=years, stray=years, blank=[], new=years, late=years)
    source = [
        ("good", "2023", "10", None), ("good", "2024", "20,5", None), ("good", "2024", "..", None), ("bad", "2023", "1", None), ("bad", "2024", "x1", None),
        ("bad", "2024", "a1", None), ("gone", None, None, "timed out"), ("stray", "2024", "1", None), ("stray", "1999", "1", None), ("late", "2024", "1", None),
        ("new", "2023", "7", None),
    ]
    asked = []

    def fetch(batches):
        asked.extend((r["table_id"], r["tid"]) for r in batches.collect())
        return spark.createDataFrame(source, ROW)

    none = spark.createDataFrame([], "table_id string, frequency string")
    outcomes, after = sync_run.run(spark, catalog.unionByName(late), state, meta, none, root, fetch, max_tables=8)
    got = {r["table_id"]: (r["status"], r["reason"], r["rows_written"], r["files_written"], r["bootstrap"]) for r in outcomes.collect()}
    assert got == {
        "good": ("synced", None, 3, 2, False), "same": ("skipped", "unchanged", None, None, None), "bad": ("failed", "not a measure: a1", None, None, None),
        "gone": ("failed", "timed out", None, None, None), "stray": ("failed", "period not asked for: 1999", None, None, None),
        "blank": ("failed", "no period values", None, None, None), "undescribed": ("failed", "no description", None, None, None),
        "new": ("synced", None, 1, 1, True),
    }
    assert {t for t, _ in asked} == {"good", "bad", "gone", "stray", "new"}
    assert rows(after) == [("bad", "1", "other"), ("good", "2", "yearly"), ("new", "2", "yearly"), ("same", "2", "yearly")]
    assert rows(layout.read_periods(spark, root), "table_id", "tid", "indhold") == [
        ("bad", "2023", "9"), ("gone", "2023", "9"), ("good", "2023", "10"), ("good", "2024", ".."), ("good", "2024", "20,5"), ("new", "2023", "7")
    ]
    assert ("new", "2024", 0) in rows(layout.manifest(spark, root))


def test_nothing_to_do(spark, tmp_path, rows):
    catalog = spark.createDataFrame([(0, "a", "1")], "pos bigint, table_id string, updated string")
    state = spark.createDataFrame([("a", "1", "yearly")], "table_id string, updated string, frequency string")
    empty = spark.createDataFrame([], "table_id string, frequency string")
    outcomes, after = sync_run.run(spark, catalog, state, described(spark, a=["2024"]), empty, str(tmp_path / "p"), lambda b: spark.createDataFrame([], ROW))
    assert rows(outcomes, "table_id", "status", "reason") == [("a", "skipped", "unchanged")] and rows(after) == [("a", "1", "yearly")]

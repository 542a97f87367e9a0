import datetime as dt

import pytest
from pyspark.sql import functions as F

from cubeloom.functions.periods import range_text
from cubeloom.functions.text import change_text, excerpt, format_value, plain_name, truncated, value_list_text
from cubeloom.operators import clean, dims
from cubeloom.plans.ordered import stretches
from cubeloom.session import stored

AGE = "table_id string, alder string"


def ages(spark, **tables):
    return spark.createDataFrame([(t, a) for t, codes in tables.items() for a in codes], AGE)


def test_names(spark):
    assert [plain_name(n) for n in ("OMRÅDE", "KØN", "Ærø")] == ["omrade", "kon", "aero"]
    assert clean.normalize_names(spark.createDataFrame([(1, 2)], "`OMRÅDE` int, INDHOLD int")).columns == ["omrade", "indhold"]


def test_age_forms(spark):
    df = ages(
        spark, single=["0", "98", "99-"], bands=["0-4", "5-9", "100-"], over=["80-84", "85OV", "5-9"], total=["0-4", "5-9", "IALT"],
        number_total=["0", "IALT"], holes=["1", None],
    )
    got = {}
    for r in clean.clean_age(df).withColumn("alder_range", range_text(F.col("alder_range"))).collect():
        got.setdefault(r.table_id, set()).add((r.alder_form, r.alder_int, r.alder_range, r.alder_text))
    assert got["single"] == {("int", 0, None, None), ("int", 98, None, None), ("int", 99, None, None)}
    assert got["bands"] == {("range", None, "[0,5)", None), ("range", None, "[5,10)", None), ("range", None, "[100,)", None)}
    assert got["over"] == {("range", None, "[80,85)", None), ("range", None, "[85,)", None), ("range", None, "[5,10)", None)}
    assert {f for t in ("total", "number_total", "holes") for f, *_ in got[t]} == {"text"}


def test_large_number_ages_become_text(spark, rows):
    df = spark.createDataFrame([("a", 5), ("b", 1001), ("b", 7)], "table_id string, alder int")
    assert rows(clean.clean_age(df), "table_id", "alder_int", "alder_text") == [("a", 5, None), ("b", None, "1001"), ("b", None, "7")]


def test_measure(spark, rows):
    df = spark.createDataFrame([("12,5",), ("..",), (None,), ("3",)], "indhold string")
    assert rows(clean.clean_measure(df)) == [(12.5,), (3.0,), (None,), (None,)]
    with pytest.raises(Exception, match="not a measure"):
        clean.clean_measure(spark.createDataFrame([("x",)], "indhold string")).collect()


def test_fact_pipeline(spark, rows):
    raw = spark.createDataFrame(
        [("M", "2024K1", "0-4", "1,5"), ("K", "2024K2", "5-9", ".."), ("K", "2024K2", "10-14", "2")],
        "`KØN` string, TID string, ALDER string, INDHOLD string",
    )
    got = clean.process_fact(raw, keys=[]).withColumn("alder_range", range_text(F.col("alder_range")))
    assert rows(got, "kon", "tid_text", "alder_range", "indhold") == [
        ("K", "2024-04-01", "[10,15)", 2.0), ("M", "2024-01-01", "[0,5)", 1.5)
    ]
    assert rows(clean.withheld_cells(raw), "kon", "alder") == [("K", "5-9")]


def test_types(spark, rows):
    df = spark.createDataFrame(
        [(True, 32767, 40000, 3_000_000_000, 1.5, dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), "[0,5)", "abc", None),
         (False, -32768, 1, 1, 2.5, None, None, "[100,)", "de", None)],
        "flag boolean, small bigint, middle bigint, big bigint, real double, ts timestamp_ntz, day date, alder string, word string, nothing string",
    )
    got = dict(rows(clean.infer_types(df)))
    assert got == {
        "flag": "boolean", "small": "smallint", "middle": "integer", "big": "bigint", "real": "double precision",
        "ts": "timestamp without time zone", "day": "date", "alder": "int4range", "word": "varchar(3)", "nothing": "text",
    }


def test_dates_become_timestamps(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "x")], "d date, s string")
    assert dict(clean.dates_to_timestamps(df).dtypes) == {"d": "timestamp_ntz", "s": "string"}


def test_drop_totals_and_rules(spark, rows):
    df = spark.createDataFrame([("TOT", "M", "2024"), ("1", "TOTR", "2024"), ("1", "M", "TOT"), (None, "K", "2024")], "a string, b string, tid string")
    assert rows(clean.drop_totals(df)) == [("1", "M", "TOT"), (None, "K", "2024")]
    rules = spark.createDataFrame([("a", "d", ["1"]), ("b", "d", ["K", "x"])], "fact_column string, dimension_table string, drop_values array<string>")
    assert rows(clean.drop_rules(df, rules, ["a", "b"])) == [("TOT", "M", "2024")]


DIM = "dim_id string, SEKVENS bigint, KODE {}, NIVEAU int, TITEL string"


def test_parents_of_number_codes(spark):
    raw = spark.createDataFrame(
        [("g", 1, 84, 1, "Region"), ("g", 2, 1, 2, "Part"), ("g", 3, 101, 3, "City"), ("g", 4, 147, 3, "Town"), ("g", 5, 2, 2, "Rest")],
        DIM.format("bigint"),
    )
    got = {r.kode: r.parent_kode for r in dims.process_dim(raw).collect()}
    assert got == {"84": None, "1": "84", "101": "1", "147": "1", "2": "84"}


def test_parents_of_text_codes(spark):
    raw = spark.createDataFrame([("b", 1, "A", 1, "a"), ("b", 2, "01", 2, "b"), ("b", 3, "01.1", 3, "c"), ("b", 4, "01.11", 4, "d")], DIM.format("string"))
    got = dims.process_dim(raw).collect()
    assert {r.kode: r.parent_kode for r in got} == {"A": None, "01": "A", "01.1": "01", "01.11": "01.1"}
    assert not any(r.kode_is_int for r in got)


def _walk(seq):
    """The stack rule, one row after another."""
    stack, out = {}, []
    for level, code in seq:
        out.append(stack.get(level - 1) if level > 1 else None)
        stack = {k: v for k, v in stack.items() if k <= level}
        stack[level] = code
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("width", [1, 3, 1000])
def test_parents_equal_the_stack(spark, seed, width):
    import random

    rnd = random.Random(seed)
    seq = [(rnd.randint(1, 5), f"c{i}") for i in range(60)]
    df = spark.createDataFrame([("d", i, c, lv, "t") for i, (lv, c) in enumerate(seq)], "dim_id string, sekvens bigint, kode string, niveau int, titel string")
    got = {r.kode: r.parent_kode for r in dims.derive_parents(df, bucket_width=width).collect()}
    assert [got[c] for _, c in seq] == _walk(seq)


def test_code_to_int_keeps_text_on_collision_and_null(spark):
    df = spark.createDataFrame(
        [("ok", 1, "01.1"), ("ok", 2, "011"), ("merge", 1, "1.1"), ("merge", 1, "11"), ("null", 1, None), ("null", 1, "1"), ("word", 1, "A")],
        "dim_id string, niveau int, kode string",
    )
    got = {r.dim_id: r.kode_is_int for r in dims.code_decision(df).collect()}
    assert got == {"ok": True, "merge": False, "null": False, "word": False}


def test_dropped_first_level_and_null_codes(spark, rows):
    raw = spark.createDataFrame([("db", 1, "A", 1, "a"), ("db", 2, "01", 2, "b"), ("db", 3, "01.1", 3, "c"), ("x", 1, None, 1, "n")], DIM.format("string"))
    assert rows(dims.process_dim(raw, drop_level_one=("db",)), "kode", "parent_kode") == [("1", None), ("11", "1")]


def test_key_choice(spark, rows):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], "dim_id string, kode string")
    assert rows(dims.dim_key_choice(df)) == [("a", "kode"), ("b", "kode,niveau")]


def test_equal_codes_on_two_levels_do_not_cross(spark, rows):
    df = spark.createDataFrame(
        [("d", "1", 1, None), ("d", "1", 2, "1"), ("d", "2", 1, None), ("d", "3", 2, "2"), ("d", "9", 3, "1")],
        "dim_id string, kode string, niveau int, parent_kode string",
    )
    got = rows(dims.ancestor_closure(df).where("kode = '9'"), "ancestor_kode", "ancestor_niveau")
    assert got == [("1", 1), ("1", 2), ("9", 3)]


def test_ancestors_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(dims, "stored", lambda df, name="stored": written.append(name) or stored(df, name))
    chain = [("d", str(i), i, str(i - 1) if i > 1 else None) for i in range(1, 301)]
    df = spark.createDataFrame(chain, "dim_id string, kode string, niveau int, parent_kode string")
    got = dims.ancestor_closure(df)
    assert (got.count(), got.distinct().count()) == (300 * 301 // 2, 300 * 301 // 2)
    assert sorted(int(r.ancestor_kode) for r in got.where("kode = '300'").collect()) == list(range(1, 301))
    assert written.count("jumps") == 9


def test_ancestors_by_two_ways_and_repeated_rows(spark, rows):
    data = [("1", 1, None), ("2", 2, "1"), ("3", 2, "1"), ("4", 3, "2"), ("4", 3, "3"), ("4", 3, "3"), ("5", 3, "8"), ("6", 4, "4"), (None, 2, "1")]
    df = spark.createDataFrame([("d", *d) for d in data], "dim_id string, kode string, niveau int, parent_kode string")
    got = dims.ancestor_closure(df)
    assert rows(got.where("kode = '6'"), "ancestor_kode", "ancestor_niveau") == [("1", 1), ("2", 2), ("3", 2), ("4", 3), ("6", 4)]
    assert rows(got.where("kode = '5'"), "ancestor_kode") == [("5",)]
    assert rows(got.where("kode is null"), "ancestor_kode") == [("1",), (None,)]


def test_stretches_follow_the_rows_and_not_the_gaps(spark):
    hot = [("hot", i * 10**9) for i in range(900)]
    df = spark.createDataFrame(hot + [(f"k{i}", i) for i in range(100)], "dim_id string, sekvens bigint")
    laid = stretches(df, ["dim_id"], ["sekvens"], 1000, "s", 100)
    sizes = {r.s: r["count"] for r in laid.groupBy("s").count().collect()}
    assert len(sizes) in (9, 10) and max(sizes.values()) < 250
    spans = laid.where("dim_id = 'hot'").groupBy("s").agg(F.min("sekvens").alias("lo"), F.max("sekvens").alias("hi")).orderBy("s").collect()
    assert len(spans) >= 8 and all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_value_display(spark):
    values = [(999.4, "number"), (1000.0, "number"), (1_250_000.0, "currency"), (-2_340_000_000.0, "number"), (0.1234, "percent"), (-0.2, "number")]
    df = spark.createDataFrame(values, "v double, f string").select(format_value(F.col("v"), F.col("f")))
    assert [r[0] for r in df.collect()] == ["999", "1.0K", "1.2M kr.", "-2.3B", "12.3%", "-0"]
    changes = spark.createDataFrame([(0.12,), (-0.031,), (0.0,), (None,)], "c double").select(change_text(F.col("c")))
    assert [r[0] for r in changes.collect()] == ["↑ +12.0%", "↓ -3.1%", "↑ +0.0%", None]


def test_value_lists_and_excerpts(spark):
    df = spark.createDataFrame([(["IALT"] + [str(i) for i in range(25)],), (["a", "b"],)], "v array<string>")
    assert [r[0] for r in df.select(value_list_text(F.col("v"))).collect()] == ["IALT, 0, 1, 2, 3 ... 20, 21, 22, 23, 24", "a, b"]
    texts = spark.createDataFrame([("  a \n b  ",), ("abcdef",), (" ",), (None,)], "t string")
    assert [r[0] for r in texts.select(excerpt(F.col("t"), 4)).collect()] == ["a b", "abcd...", "_None_", "_None_"]
    cut = df.select(F.array_compact(F.concat(F.slice("v", 1, 5), F.slice(F.reverse("v"), 1, 5))).alias("v"), F.size("v").alias("n"))
    assert cut.select(value_list_text(F.col("v"), 20, 5, size=F.col("n"))).first()[0] == "IALT, 0, 1, 2, 3 ... 24, 23, 22, 21, 20"
    assert texts.select(truncated(F.col("t"), 5)).collect()[1][0] == "abcde... (6 total chars)"


def test_four_and_five_levels(spark, rows):
    data = [("d", i, str(i), level) for i, level in enumerate([1, 2, 3, 4, 5, 5, 4, 2, 3, 1, 2], 1)]
    df = spark.createDataFrame(data, "dim_id string, sekvens int, kode string, niveau int").withColumn("titel", F.col("kode"))
    tree = dims.process_dim(df)
    parents = {r.kode: r.parent_kode for r in tree.collect()}
    assert parents == {"1": None, "2": "1", "3": "2", "4": "3", "5": "4", "6": "4", "7": "3", "8": "1", "9": "8", "10": None, "11": "10"}
    got = rows(dims.ancestor_closure(tree).where("kode = '6'"), "ancestor_kode", "ancestor_niveau")
    assert got == [("1", 1), ("2", 2), ("3", 3), ("4", 4), ("6", 5)]

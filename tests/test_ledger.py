import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import ledger, trace
from cubeloom.streaming.ledger_feed import post_charges

RATE = Decimal("7.5")


def test_amounts_round_half_up_and_need_usage(spark, rows):
    df = spark.createDataFrame([(1, Decimal("0.123456"), 1, 0), (2, Decimal("0.123456"), 0, None), (3, Decimal("0.002"), None, 5)], "k int, usd_cost decimal(18,8), requests bigint, input_tokens bigint")
    assert rows(ledger.charge_amounts(df, F.lit(RATE)), "k", "amount") == [(1, Decimal("0.93")), (3, Decimal("0.02"))]


def test_first_posting_counts(spark, rows):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 3.0), ("b", 1, None)], "charge_key string, ts int, amount double")
    assert rows(ledger.post_once(df, "charge_key", ["ts"])) == [("a", 1, 3.0), ("b", 1, None)]


CREDIT = "arrival int, session string, event string"


def _sequential(data):
    a, b, taken = set(), set(), []
    for order, s, e in sorted(data, key=lambda c: c[0]):
        if (s is None or s not in a) and (e is None or e not in b):
            a.add(s), b.add(e), taken.append(order)
    return taken


def test_refused_credit_blocks_nothing(spark, rows):
    data = [(1, "k1", "s1"), (2, "k1", "s2"), (3, "k2", "s2")]
    got = ledger.accepted_credits(spark.createDataFrame(data, CREDIT), ("session", "event"), "arrival")
    assert rows(got, "arrival") == [(1,), (3,)]


@pytest.mark.parametrize("seed", range(2))
def test_credits_equal_the_sequential_rule(spark, rows, seed):
    rnd = random.Random(seed)
    data = [(i, "hot" if rnd.random() < 0.35 else f"k{rnd.randint(0, 60)}", f"s{rnd.randint(0, 60)}") for i in range(200)]
    got = ledger.accepted_credits(spark.createDataFrame(data, CREDIT), ("session", "event"), "arrival")
    assert [r[0] for r in sorted(got.select("arrival").collect())] == _sequential(data)


def test_null_keys_block_nothing(spark):
    data = [(1, "a", None), (2, None, None), (3, "b", None), (4, "a", "x"), (5, None, "x"), (6, None, "x"), (7, None, None), (8, "a", None)]
    got = ledger.accepted_credits(spark.createDataFrame(data, CREDIT), ("session", "event"), "arrival")
    assert sorted(r["arrival"] for r in got.collect()) == _sequential(data) == [1, 2, 3, 5, 7]


def test_long_chain(spark):
    data = [(i, f"k{(i + 1) // 2}", f"s{i // 2}") for i in range(100)]
    got = ledger.accepted_credits(spark.createDataFrame(data, CREDIT), ("session", "event"), "arrival")
    assert sorted(r["arrival"] for r in got.collect()) == _sequential(data) == list(range(0, 100, 2))


def test_stream_keeps_old_stamps_and_drops_late_retries(spark, tmp_path):
    from datetime import datetime, timedelta

    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "charge_key bigint, ts timestamp, amount int"
    runs = [[(1, 100, 10)], [(2, 1, 20), (1, 300, 11)], [(3, 200, 30), (3, 199, 31)], [(1, 365, 12), (4, 360, 40)], [(2, 2, 21)]]
    for batch in runs:
        days = [(k, datetime(2024, 1, 1) + timedelta(days=d), a) for k, d, a in batch]
        spark.createDataFrame(days, schema).write.mode("append").parquet(inbox)
        post_charges(spark.readStream.schema(schema).parquet(inbox), out, ckpt).awaitTermination()
    got = sorted((r["charge_key"], r["amount"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 10), (2, 20), (3, 31), (4, 40)]


def test_null_keys_are_shared_with_nobody(spark, tmp_path, rows):
    schema = "charge_key bigint, ts timestamp, amount int"
    from datetime import datetime

    day = datetime(2024, 1, 1)
    df = spark.createDataFrame([(None, day, 1), (None, day, 1), (5, day, 2), (5, day, 3), (None, day, 4)], schema)
    assert rows(ledger.post_once(df, "charge_key", ["ts"]), "charge_key", "amount") == [(5, 2), (None, 1), (None, 1), (None, 4)]
    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for _ in range(2):
        df.write.mode("append").parquet(inbox)
        post_charges(spark.readStream.schema(schema).parquet(inbox), out, ckpt).awaitTermination()
    assert rows(spark.read.parquet(out), "charge_key", "amount") == [(5, 2), *[(None, 1)] * 4, *[(None, 4)] * 2]


def test_stream_needs_no_posted_row_and_survives_a_lost_commit(spark, tmp_path, rows):
    """What is posted may be moved away; a batch whose commit was lost runs again and posts the same."""
    import shutil
    from datetime import datetime, timedelta

    inbox, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "charge_key bigint, ts timestamp, amount int"

    def post(*data):
        days = [(k, datetime(2024, 1, 1) + timedelta(days=d), a) for k, d, a in data]
        spark.createDataFrame(days, schema).coalesce(1).write.mode("append").parquet(inbox)
        run()

    def run():
        post_charges(spark.readStream.schema(schema).parquet(inbox), out, ckpt).awaitTermination()

    post((1, 5, 10), (2, 5, 20))
    shutil.move(f"{out}/batch=0", str(tmp_path / "archive"))
    post((1, 4, 11), (3, 9, 30), (3, 8, 31))
    assert rows(spark.read.parquet(out), "charge_key", "amount") == [(3, 31)]
    for f in (tmp_path / "ckpt" / "keyed" / "commits").glob("*1*"):
        f.unlink()
    run()
    assert rows(spark.read.parquet(out), "charge_key", "amount") == [(3, 31)]
    post((2, 1, 21), (3, 1, 32), (4, 1, 40))
    assert rows(spark.read.parquet(out), "charge_key", "amount") == [(3, 31), (4, 40)]


def test_balances(spark, rows):
    charges = spark.createDataFrame([(1, Decimal("5.00")), (2, Decimal("1.00"))], "user_id int, amount decimal(12,2)")
    credits = spark.createDataFrame([(1, Decimal("5.00")), (3, Decimal("2.00"))], "user_id int, amount decimal(12,2)")
    assert rows(ledger.balances(charges, credits)) == [(1, Decimal("0.00"), False), (2, Decimal("-1.00"), False), (3, Decimal("2.00"), True)]


def test_upsert_changes_only_supplied_columns(spark, rows):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, n int")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, name string")
    assert rows(ledger.upsert_rows(old, new, ["id"])) == [(1, "a", 10), (2, None, 20), (3, "c", None)]
    assert rows(ledger.upsert_rows(old, new.select("id"), ["id"])) == [(1, "a", 10), (2, "b", 20), (3, None, None)]


LOG = (
    "conv string, msg bigint, kind string, finish_reason string, model_name string, input_tokens bigint, output_tokens bigint, "
    "parts array<struct<kind:string,text:string,tool_name:string,call_id:string>>"
)


def events(spark, messages):
    data = [("c", i, kind, finish, model, 10, 1, parts) for i, (kind, finish, model, parts) in enumerate(messages)]
    log = spark.createDataFrame(data, LOG)
    got = trace.trace_events(log, ["conv"]).orderBy("idx").collect()
    return log, got


def test_single_call_round_trip(spark):
    log, got = events(spark, [
        ("request", None, None, [("user_prompt", "Hi", None, None)]),
        ("response", "tool_call", "model-a", [("thinking", "Need SQL", None, None), ("tool_call", None, "Sql", "call_sql")]),
        ("request", None, None, [("tool_return", "Stored as df_x", "Sql", "call_sql")]),
        ("response", "stop", None, [("text", "Done", None, None), ("text", "  ", None, None)]),
    ])
    assert [(e.idx, e.kind, e.step_idx, e.call_seq, e.is_final) for e in got] == [
        (0, "user", None, None, False), (1, "thinking", 1, None, False), (2, "tool_call", 1, 1, False), (3, "tool_return", 1, 1, False), (4, "assistant_text", 2, None, True)
    ]
    usage = trace.trace_usage(log, ["conv"]).first()
    assert (usage.model_name, usage.input_tokens, usage.output_tokens, usage.responses) == ("model-a", 20, 2, 2)
    summary = trace.turn_summary(trace.trace_events(log, ["conv"]), ["conv"]).first()
    assert (summary.user_text, summary.tools, summary.calls, summary.final_text) == ("Hi", "Sql(1)", 1, "Done")


def test_parallel_calls_retries_and_unknown_ids(spark):
    _, got = events(spark, [
        ("request", None, None, [("tool_return", "early", "Sql", "nobody")]),
        ("response", "tool_call", "m", [("tool_call", None, "Sql", "a"), ("tool_call", None, "Bash", "b"), ("tool_call", None, "Sql", None)]),
        ("request", None, None, [("retry", "again", "Bash", "b"), ("tool_return", "one", "Sql", "a"), ("tool_return", "twice", "Sql", "a"), ("user_prompt", "image", None, None)]),
        ("response", "tool_call", "m", [("tool_call", None, "Sql", "a")]),
        ("request", None, None, [("tool_return", "new", "Sql", "a"), ("tool_return", "lost", "Sql", "zzz")]),
        ("request", None, None, [("user_prompt", "", None, None), ("system", "x", None, None)]),
    ])
    assert [(e.kind, e.text, e.call_seq, e.step_idx) for e in got] == [
        ("tool_return", "early", None, None),
        ("tool_call", None, 1, 1), ("tool_call", None, 2, 1), ("tool_call", None, 3, 1),
        ("tool_return", "one", 1, 1), ("tool_retry", "again", 2, 1),
        ("tool_call", None, 4, 2), ("tool_return", "new", 4, 2), ("tool_return", "lost", None, 2),
    ]


def test_summary_of_many_final_texts(spark):
    parts = [("text", f"w{i}", None, None) for i in range(200)]
    log, _ = events(spark, [("response", "stop", "m", parts)])
    summary = trace.turn_summary(trace.trace_events(log, ["conv"]), ["conv"]).first()
    joined = " ".join(f"w{i}" for i in range(200))
    assert summary.final_text == joined[:120] + "..." and summary.user_text == "_None_" and summary.tools is None


@pytest.mark.parametrize("width", [1, 3])
def test_one_long_log_in_many_buckets(spark, monkeypatch, width):
    rnd = random.Random(width)
    messages = []
    for i in range(40):
        call = rnd.choice("abc")
        if rnd.random() < 0.5:
            messages.append(("response", "stop" if rnd.random() < 0.3 else None, "m", [("text", f"t{i}", None, None), ("tool_call", None, "Sql", call)]))
        elif rnd.random() < 0.5:
            messages.append(("request", None, None, [("tool_return", f"r{i}", "Sql", call)]))
        else:
            messages.append(("request", None, None, [("user_prompt", f"u{i}", None, None)]))
    _, whole = events(spark, messages)
    monkeypatch.setattr(trace, "MESSAGES_PER_BUCKET", width)
    _, cut = events(spark, messages)
    assert cut == whole
    # the rule itself, one message after another
    step = seq = 0
    calls, want = {}, []
    for kind, _, _, parts in messages:
        step += kind == "response"
        for part, text, _, call in parts:
            if part == "tool_call":
                seq += 1
                calls[call] = (seq, step)
                want.append(("tool_call", seq, step))
            elif part == "tool_return":
                got = calls.get(call, (None, step or None))
                want.append(("tool_return", *got))
            elif part == "text":
                want.append(("assistant_text", None, step))
            else:
                want.append(("user", None, None))
    assert [(e.kind, e.call_seq, e.step_idx) for e in whole] == want


def test_prompt_with_an_attachment_only(spark):
    _, got = events(spark, [
        ("request", None, None, [("user_prompt", None, None, None), ("user_prompt", "", None, None)]), ("response", "stop", "m", [("text", "a", None, None)]),
    ])
    assert [(e.kind, e.text) for e in got] == [("user", None), ("assistant_text", "a")]

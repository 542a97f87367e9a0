"""Ledger and message traces."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, trace
from ..session import scratch_path, stored
from ..streaming.ledger_feed import post_charges
from ..streaming.period_feed import stream_files
from . import frames
from ._registry import query
from .joins import dbl
from .views import view

RATE = Decimal("7.5")

view("charge_log", """
SELECT event_id // 2 AS charge_key, event_id, user_id, ts, CAST(value / 100 AS DECIMAL(18,8)) AS usd_cost,
       CAST(event_id % 3 AS BIGINT) AS requests, CAST(FLOOR(value) AS BIGINT) AS input_tokens
FROM events WHERE event_type <> 'purchase'
""")

view("charge_rows", """
SELECT *, ROUND(usd_cost * CAST(7.5 AS DECIMAL(12,6)), 2) AS amount FROM charge_log WHERE requests > 0 OR input_tokens > 0
""")

view("charges_posted", """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY charge_key ORDER BY ts, event_id) AS rn FROM charge_rows) WHERE rn = 1
""")

view("credit_rows", """
SELECT event_id, user_id, CAST(value AS DECIMAL(12,2)) AS amount, 'cs' || user_id || '-' || (DAY(ts) // 5) AS session_key, 'ev' || (event_id // 7) AS event_key,
       ROW_NUMBER() OVER (ORDER BY event_id) AS rn
FROM events WHERE event_type = 'purchase'
""")


def charge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows with repeated keys, from all events but purchases."""
    key = F.col("event_id")
    return frames.table(spark, sf_dir, "events").where(F.col("event_type") != "purchase").select(
        F.floor(key / 2).alias("charge_key"), "event_id", "user_id", "ts",
        (F.col("value") / 100).cast("decimal(18,8)").alias("usd_cost"),
        (key % 3).alias("requests"), F.floor("value").cast("bigint").alias("input_tokens"),
    )


def credit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as credits with two keys that repeat independently."""
    key = F.col("event_id")
    return frames.table(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", F.col("value").cast("decimal(12,2)").alias("amount"),
        F.concat(F.lit("cs"), "user_id", F.lit("-"), F.floor(F.dayofmonth("ts") / 5)).alias("session_key"),
        F.concat(F.lit("ev"), F.floor(key / 7)).alias("event_key"),
    )


@query("charge_amounts", "SELECT event_id, charge_key, user_id, CAST(amount AS DOUBLE) AS amount FROM charge_rows")
def charge_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.charge_amounts(charge_log(spark, sf_dir), F.lit(RATE)).select("event_id", "charge_key", "user_id", dbl("amount", "amount"))


def _posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.post_once(ledger.charge_amounts(charge_log(spark, sf_dir), F.lit(RATE)), "charge_key", ["ts", "event_id"])


@query("post_once", "SELECT charge_key, event_id, user_id, CAST(amount AS DOUBLE) AS amount FROM charges_posted")
def post_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posted(spark, sf_dir).select("charge_key", "event_id", "user_id", dbl("amount", "amount"))


# the sequential rule itself, one credit after another
_WALK = """
WITH RECURSIVE walk(rn, a, b, ok) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), FALSE
  UNION ALL
  SELECT c.rn, CASE WHEN n THEN LIST_APPEND(a, session_key) ELSE a END, CASE WHEN n THEN LIST_APPEND(b, event_key) ELSE b END, n
  FROM (SELECT c.*, w.a, w.b, NOT LIST_CONTAINS(w.a, c.session_key) AND NOT LIST_CONTAINS(w.b, c.event_key) AS n
        FROM walk w JOIN credit_rows c ON c.rn = w.rn + 1) c
)
"""


@query(
    "accepted_credits",
    _WALK + "SELECT c.event_id, c.user_id, CAST(c.amount AS DOUBLE) AS amount, c.session_key, c.event_key FROM credit_rows c JOIN walk w ON w.rn = c.rn WHERE w.ok",
)
def accepted_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = ledger.accepted_credits(credit_log(spark, sf_dir), ("session_key", "event_key"), "event_id")
    return taken.select("event_id", "user_id", dbl("amount", "amount"), "session_key", "event_key")


@query(
    "idempotent_balance",
    """
    SELECT user_id, CAST(SUM(amount) AS DOUBLE) AS balance, SUM(amount) > 0 AS positive FROM (
      SELECT user_id, -amount AS amount FROM charges_posted
      UNION ALL SELECT user_id, amount FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_key ORDER BY rn) AS k FROM credit_rows) WHERE k = 1)
    GROUP BY user_id
    """,
)
def idempotent_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances with credits keyed once, on the checkout session."""
    credits = ledger.post_once(credit_log(spark, sf_dir), "session_key", ["event_id"])
    out = ledger.balances(_posted(spark, sf_dir), credits)
    return out.select("user_id", dbl("balance", "balance"), "positive")


@query(
    "two_key_balance",
    _WALK + """
    SELECT user_id, CAST(SUM(amount) AS DOUBLE) AS balance, SUM(amount) > 0 AS positive FROM (
      SELECT user_id, -amount AS amount FROM charges_posted
      UNION ALL SELECT c.user_id, c.amount FROM credit_rows c JOIN walk w ON w.rn = c.rn WHERE w.ok)
    GROUP BY user_id
    """,
)
def two_key_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances with credits under the two-key rule."""
    credits = ledger.accepted_credits(credit_log(spark, sf_dir), ("session_key", "event_key"), "event_id")
    out = ledger.balances(_posted(spark, sf_dir), credits)
    return out.select("user_id", dbl("balance", "balance"), "positive")


@query(
    "upsert_rows",
    """
    SELECT COALESCE(o.user_id, n.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN n.last_event ELSE o.last_event END AS last_event, o.n_views
    FROM (SELECT user_id, MAX(event_id) AS last_event, COUNT(*) AS n_views FROM events WHERE event_type = 'view' GROUP BY user_id) o
    FULL JOIN (SELECT user_id, CASE WHEN COUNT(*) > 18 THEN MAX(event_id) END AS last_event FROM events WHERE event_type = 'error' GROUP BY user_id) n ON n.user_id = o.user_id
    """,
)
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frames.table(spark, sf_dir, "events")
    old = events.where(F.col("event_type") == "view").groupBy("user_id").agg(
        F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("n_views")
    )
    new = events.where(F.col("event_type") == "error").groupBy("user_id").agg(
        F.when(F.count(F.lit(1)) > 18, F.max("event_id")).alias("last_event")
    )
    return ledger.upsert_rows(old, new, ["user_id"])


@query("stream_ledger", "SELECT user_id, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS amount FROM events GROUP BY user_id")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event file as a stream in which every charge arrives once more as a retry."""
    path = scratch_path(spark, "ledger")
    events = stream_files(spark, sf_dir, frames.table(spark, sf_dir, "events"), "events.parquet")
    again = events.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    charges = again.select(
        F.col("event_id").alias("charge_key"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.col("value").cast("decimal(12,2)").alias("amount"),
    )
    post_charges(charges, path, scratch_path(spark, "ledger-ckpt")).awaitTermination()
    posted = spark.read.parquet(path)
    return posted.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), dbl(F.sum("amount"), "amount"))


# ---- traces -------------------------------------------------------------

view("log_parts", """
SELECT conv_id, turn, turn // 2 AS turn_idx, turn * 2 AS msg, CASE role WHEN 'assistant' THEN 'response' ELSE 'request' END AS side, part, kind, txt, tool, call_id, finish
FROM (SELECT *, CASE WHEN LENGTH(text) % 3 = 0 THEN 'stop' ELSE 'tool_call' END AS finish, CASE WHEN LENGTH(text) % 2 = 0 THEN 'Sql' ELSE 'Bash' END AS t0,
       'k' || (turn % 4) AS k0 FROM conversations) c,
LATERAL (
  SELECT 0 AS part, CASE role WHEN 'system' THEN 'system' ELSE 'user_prompt' END AS kind, text AS txt, NULL AS tool, NULL AS call_id WHERE role <> 'assistant'
  UNION ALL SELECT 0, 'thinking', CASE WHEN LENGTH(text) % 2 = 0 THEN 'plan' ELSE ' ' END, NULL, NULL WHERE role = 'assistant'
  UNION ALL SELECT 1, 'text', text, NULL, NULL WHERE role = 'assistant'
  UNION ALL SELECT 2, 'tool_call', NULL, t0, k0 WHERE role = 'assistant' AND finish = 'tool_call'
)
UNION ALL
SELECT conv_id, turn, turn // 2, turn * 2 + 1, 'request', part, kind, txt, tool, call_id, NULL
FROM (SELECT *, CASE WHEN LENGTH(text) % 2 = 0 THEN 'Sql' ELSE 'Bash' END AS t0, 'k' || (turn % 4) AS k0 FROM conversations
      WHERE role = 'assistant' AND LENGTH(text) % 3 <> 0) c,
LATERAL (SELECT 0 AS part, 'retry' AS kind, 'again' AS txt, t0 AS tool, 'missing' AS call_id WHERE LENGTH(text) % 5 = 0
  UNION ALL SELECT 1, 'tool_return', 'rows', t0, k0 UNION ALL SELECT 2, 'user_prompt', 'picture', NULL, NULL UNION ALL SELECT 3, 'tool_return', 'twice', t0, k0)
""")

view("log_events", """
SELECT *, ROW_NUMBER() OVER w - 1 AS idx, COUNT(*) FILTER (WHERE event = 'tool_call') OVER w AS seq FROM (
  SELECT p.*, s.step, CASE WHEN event0 = 'tool_retry' THEN 1 ELSE 0 END AS rnk, event0 AS event FROM (
    SELECT *, CASE
      WHEN kind = 'tool_return' AND part = 1 THEN 'tool_return' WHEN kind = 'retry' THEN 'tool_retry'
      WHEN kind = 'user_prompt' AND txt <> 'picture' AND LENGTH(txt) > 0 THEN 'user'
      WHEN kind = 'thinking' AND LENGTH(TRIM(txt)) > 0 THEN 'thinking'
      WHEN kind = 'text' AND LENGTH(TRIM(txt)) > 0 THEN 'assistant_text' WHEN kind = 'tool_call' THEN 'tool_call' END AS event0 FROM log_parts) p
  JOIN (SELECT conv_id, msg, SUM(r) OVER (PARTITION BY conv_id ORDER BY msg) AS step FROM (
          SELECT conv_id, msg, MAX(CASE WHEN side = 'response' THEN 1 ELSE 0 END) AS r FROM log_parts GROUP BY conv_id, msg)) s
    ON s.conv_id = p.conv_id AND s.msg = p.msg
  WHERE event0 IS NOT NULL)
WINDOW w AS (PARTITION BY conv_id ORDER BY msg, rnk, part)
""")

view("trace_rows", """
SELECT conv_id, turn_idx, idx, event AS kind,
  CAST(CASE event WHEN 'user' THEN NULL WHEN 'tool_return' THEN COALESCE(call_step, NULLIF(step, 0)) WHEN 'tool_retry' THEN COALESCE(call_step, NULLIF(step, 0)) ELSE step END AS BIGINT) AS step_idx,
  tool AS tool_name, call_id AS tool_call_id, CAST(CASE event WHEN 'tool_call' THEN seq WHEN 'tool_return' THEN call_seq WHEN 'tool_retry' THEN call_seq END AS BIGINT) AS call_seq,
  txt AS text, COALESCE(event = 'assistant_text' AND finish = 'stop', FALSE) AS is_final
FROM (SELECT *, LAST_VALUE(CASE WHEN event = 'tool_call' THEN seq END IGNORE NULLS) OVER l AS call_seq, LAST_VALUE(CASE WHEN event = 'tool_call' THEN step END IGNORE NULLS) OVER l AS call_step
      FROM log_events WINDOW l AS (PARTITION BY conv_id, call_id ORDER BY idx))
""")


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as request and response messages; answers that are not final call a tool."""
    part = "struct<kind:string,text:string,tool_name:string,call_id:string>"
    text, turn, role = F.col("text"), F.col("turn"), F.col("role")
    size = F.length(text)
    tool = F.when(size % 2 == 0, "Sql").otherwise("Bash")
    call = F.concat(F.lit("k"), (turn % 4).cast("string"))

    def one(kind, body=None, name=None, key=None):
        fields = (kind if not isinstance(kind, str) else F.lit(kind), body, name, key)
        return F.struct(*[(F.lit(None) if f is None else f).cast("string").alias(n) for f, n in zip(fields, ("kind", "text", "tool_name", "call_id"))])

    final = size % 3 == 0
    asked = F.array(one(F.when(role == "system", "system").otherwise("user_prompt"), text))
    thought = one("thinking", F.when(size % 2 == 0, "plan").otherwise(" "))
    said = F.array(thought, one("text", text))
    called = F.array(thought, one("text", text), one("tool_call", None, tool, call))
    results = F.array(one("tool_return", F.lit("rows"), tool, call), one("user_prompt", F.lit("picture")), one("tool_return", F.lit("twice"), tool, call))
    retried = F.concat(F.array(one("retry", F.lit("again"), tool, F.lit("missing"))), results)
    log = frames.table(spark, sf_dir, "conversations")
    common = ["conv_id", F.floor(turn / 2).alias("turn_idx")]
    first = log.select(
        *common, (turn * 2).alias("msg"), F.when(role == "assistant", "response").otherwise("request").alias("kind"),
        F.when(role == "assistant", F.when(final, "stop").otherwise("tool_call")).alias("finish_reason"),
        F.when(role == "assistant", F.when(size % 2 == 0, "model-a").otherwise("model-b")).alias("model_name"),
        size.cast("bigint").alias("input_tokens"), (size % 7).cast("bigint").alias("output_tokens"),
        F.when(role != "assistant", asked).when(final, said).otherwise(called).cast(f"array<{part}>").alias("parts"),
    )
    second = log.where((role == "assistant") & ~final).select(
        *common, (turn * 2 + 1).alias("msg"), F.lit("request").alias("kind"), F.lit(None).cast("string").alias("finish_reason"),
        F.lit(None).cast("string").alias("model_name"), F.lit(None).cast("bigint").alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"),
        F.when(size % 5 == 0, retried).otherwise(results).cast(f"array<{part}>").alias("parts"),
    )
    return first.unionByName(second)


@query("trace_events", "SELECT conv_id, idx, kind, step_idx, tool_name, tool_call_id, call_seq, text, is_final FROM trace_rows")
def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.trace_events(message_log(spark, sf_dir), ["conv_id"])


@query(
    "trace_usage",
    """
    SELECT conv_id, ARG_MAX(CASE WHEN LENGTH(text) % 2 = 0 THEN 'model-a' ELSE 'model-b' END, turn) FILTER (WHERE role = 'assistant') AS model_name,
      CAST(COALESCE(SUM(LENGTH(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS input_tokens,
      CAST(COALESCE(SUM(LENGTH(text) % 7) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS output_tokens, COUNT(*) FILTER (WHERE role = 'assistant') AS responses
    FROM conversations GROUP BY conv_id
    """,
)
def trace_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.trace_usage(message_log(spark, sf_dir), ["conv_id"])


@query(
    "tool_results",
    """
    SELECT conv_id, idx, kind, tool_name, CASE WHEN LENGTH(COALESCE(text, '')) <= 4 THEN COALESCE(text, '') ELSE SUBSTR(text, 1, 4) || '... (' || LENGTH(text) || ' total chars)' END AS result,
      LENGTH(COALESCE(text, '')) > 4 AS is_cut FROM trace_rows WHERE kind IN ('tool_return', 'tool_retry')
    """,
)
def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.tool_results(trace.trace_events(message_log(spark, sf_dir), ["conv_id"]), ["conv_id"], size=4)


@query(
    "turn_summary",
    r"""
    SELECT conv_id, turn_idx,
      CASE WHEN u IS NULL OR u = '' THEN '_None_' WHEN LENGTH(u) <= 100 THEN u ELSE SUBSTR(u, 1, 100) || '...' END AS user_text, tools, COALESCE(calls, 0) AS calls,
      CASE WHEN f IS NULL OR f = '' THEN '_None_' WHEN LENGTH(f) <= 120 THEN f ELSE SUBSTR(f, 1, 120) || '...' END AS final_text
    FROM (
      SELECT conv_id, turn_idx,
        TRIM(REGEXP_REPLACE(ARG_MIN(text, idx) FILTER (WHERE kind = 'user'), '\s+', ' ', 'g')) AS u,
        TRIM(REGEXP_REPLACE(STRING_AGG(text, chr(10) ORDER BY idx) FILTER (WHERE is_final), '\s+', ' ', 'g')) AS f
      FROM trace_rows GROUP BY conv_id, turn_idx) b
    LEFT JOIN (
      SELECT conv_id, turn_idx, STRING_AGG(tool_name || '(' || n || ')', ', ' ORDER BY first) AS tools, CAST(SUM(n) AS BIGINT) AS calls FROM (
        SELECT conv_id, turn_idx, tool_name, COUNT(*) AS n, MIN(idx) AS first FROM trace_rows WHERE kind = 'tool_call' GROUP BY ALL) GROUP BY ALL) t USING (conv_id, turn_idx)
    """,
)
def turn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["conv_id", "turn_idx"]
    return trace.turn_summary(stored(trace.trace_events(message_log(spark, sf_dir), keys), "trace"), keys)

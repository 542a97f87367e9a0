"""Message logs to ordered events and turn summaries.

``messages`` is ``(*keys, msg, kind, finish_reason, model_name, input_tokens,
output_tokens, parts)`` with ``msg`` the place in the log, ``kind`` request or
response, and ``parts`` an array of ``(kind, text, tool_name, call_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, truncated
from ..plans.ordered import running

# Messages of one log handled by one task; a message is one row with its parts.
MESSAGES_PER_BUCKET = 1 << 14
USER_EXCERPT, FINAL_EXCERPT, RESULT_CHARS = 100, 120, 500  # fixed values

_RESULTS = ("tool_return", "retry")
_ORDER = ["msg", "_rank", "part"]


def _bucket() -> Column:
    return F.floor(F.col("msg") / MESSAGES_PER_BUCKET)


def _filled(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)\s+", "")), F.lit(0)) > 0


def _parts(messages: DataFrame, keys: list[str]) -> DataFrame:
    """All parts, with the kind of event each becomes, null for none.

    A request with results is read for its results only: returns first, one per
    call, then retries. A message without parts keeps one row, so that its step
    is counted.
    """
    answered = (F.col("kind") == "request") & F.coalesce(F.exists("parts", lambda p: p["kind"].isin(*_RESULTS)), F.lit(False))
    rows = messages.select(
        *keys, "msg", answered.alias("_answered"), F.col("kind").alias("_side"), "finish_reason", "parts",
        F.posexplode_outer("parts").alias("part", "p"),
    )
    kind, text = F.col("p.kind"), F.col("p.text")
    earlier = F.slice("parts", 1, F.col("part"))
    repeated = F.exists(earlier, lambda q: (q["kind"] == "tool_return") & (q["call_id"] == F.col("p.call_id")))
    response = F.col("_side") == "response"
    event = (
        F.when(F.col("_answered") & (kind == "tool_return") & ~F.coalesce(repeated, F.lit(False)), "tool_return")
        .when(F.col("_answered") & (kind == "retry"), "tool_retry")
        .when(F.col("_answered"), None)
        .when((F.col("_side") == "request") & (kind == "user_prompt") & (F.coalesce(F.length(text), F.lit(1)) > 0), "user")
        .when(response & (kind == "thinking") & _filled(text), "thinking")
        .when(response & (kind == "text") & _filled(text), "assistant_text")
        .when(response & (kind == "tool_call"), "tool_call")
    )
    part = F.coalesce("part", F.lit(0))
    return rows.select(
        *keys, "msg", F.when(kind == "retry", 1).otherwise(0).alias("_rank"), part.alias("part"), event.alias("event"),
        (response & (part == 0)).cast("bigint").alias("_answer"),
        F.col("p.tool_name").alias("tool_name"), F.col("p.call_id").alias("tool_call_id"), text.alias("text"),
        (F.col("finish_reason").eqNullSafe("stop") & (event == "assistant_text")).alias("is_final"),
    )


def trace_events(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered events of every log: ``idx, kind, step_idx, call_seq, ...``.

    A prompt without text holds an attachment only and is kept with a null text.

    Results are linked to the latest earlier call with their id; one without a
    call carries the current step.
    """
    is_call = F.col("event") == "tool_call"
    numbered = running(
        _parts(messages, keys), keys, _ORDER, _bucket(),
        sums={
            "_step": F.col("_answer"),
            "_seq": F.coalesce(is_call, F.lit(False)).cast("bigint"),
            "_place": F.col("event").isNotNull().cast("bigint"),
        },
        depth=2,
    ).where(F.col("event").isNotNull())
    # rows without an id share an empty one, which is never looked up
    marked = numbered.withColumn("_id", F.coalesce("tool_call_id", F.lit("")))
    call = F.when(is_call, F.struct(F.col("_seq").alias("seq"), F.col("_step").alias("step")))
    linked = running(marked, [*keys, "_id"], _ORDER, _bucket(), lasts={"_call": call})
    found = F.when(F.col("_id") != "", F.col("_call"))
    result = F.col("event").isin("tool_return", "tool_retry")
    current = F.when(F.col("_step") > 0, F.col("_step"))
    step = (
        F.when(F.col("event") == "user", None)
        .when(result, F.coalesce(found["step"], current))
        .otherwise(F.col("_step"))
    )
    return linked.select(
        *keys,
        (F.col("_place") - 1).alias("idx"),
        F.col("event").alias("kind"),
        step.alias("step_idx"),
        "tool_name",
        "tool_call_id",
        F.when(is_call, F.col("_seq")).when(result, found["seq"]).alias("call_seq"),
        "text",
        "is_final",
    )


def tool_results(events: DataFrame, keys: list[str], size: int = RESULT_CHARS) -> DataFrame:
    """What the tools gave back, cut at ``size`` characters with the total noted, and whether it was cut."""
    text = F.coalesce("text", F.lit(""))
    results = events.where(F.col("kind").isin("tool_return", "tool_retry"))
    return results.select(*keys, "idx", "kind", "tool_name", truncated(text, size).alias("result"), (F.length(text) > size).alias("is_cut"))


def trace_usage(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Responses, tokens and the last model named, per log."""
    answer = F.col("kind") == "response"
    named = F.when(answer & F.col("model_name").isNotNull() & (F.col("model_name") != ""), F.struct("msg", "model_name"))

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(answer, F.col(column))), F.lit(0)).cast("bigint")

    return messages.groupBy(*keys).agg(
        F.max(named)["model_name"].alias("model_name"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        F.count_if(answer).alias("responses"),
    )


def turn_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """First user text, calls per tool in order of first use, and the final text, as excerpts.

    ``events`` is read three times, so it is best a stored table.
    """
    user = F.min(F.when((F.col("kind") == "user") & _filled(F.col("text")), F.struct("idx", "text")))["text"]
    base = events.groupBy(*keys).agg(excerpt(F.coalesce(user, F.lit("")), USER_EXCERPT).alias("user_text"))
    per_tool = (
        events.where((F.col("kind") == "tool_call") & F.col("tool_name").isNotNull())
        .groupBy(*keys, "tool_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    )
    # tools are few; their calls were counted above
    named = F.struct("first", F.concat("tool_name", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    tools = per_tool.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(named)), lambda x: x["t"]), ", ").alias("tools"),
        F.sum("n").alias("calls"),
    )
    # every final text has a letter, so this many of them fill the excerpt and show it is cut
    order = Window.partitionBy(*keys).orderBy("idx")
    finals = events.where((F.col("kind") == "assistant_text") & F.col("is_final")).select(*keys, "idx", "text")
    enough = finals.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= FINAL_EXCERPT + 1)
    joined = enough.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("_final")
    )
    return (
        base.join(tools, keys, "left")
        .join(joined, keys, "left")
        .select(
            *keys, "user_text", "tools", F.coalesce("calls", F.lit(0).cast("bigint")).alias("calls"),
            excerpt(F.coalesce("_final", F.lit("")), FINAL_EXCERPT).alias("final_text"),
        )
    )

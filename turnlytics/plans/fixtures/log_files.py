"""Logs in the formats that people bring, made from the given conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START_SECONDS = 1_709_510_400  # 2024-03-04
START_NANOS = START_SECONDS * 1_000_000_000


def spoken(conversations: DataFrame) -> DataFrame:
    return conversations.where("role IN ('user', 'assistant')")


def object_rows(conversations: DataFrame) -> DataFrame:
    """Chat objects with unusual names and a system turn; some lack user, time or model, and then messages bring a time."""
    late = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") > 0), (START_SECONDS + F.col("conv_id") * 3600 + F.col("turn") * 60) * 1000)
    m = F.struct(F.col("turn"), F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise("system").alias("sender"), F.col("text"), late.alias("time"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return rows.select(
        F.col("conv_id").cast("string").alias("session_id"), F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("u"), F.col("conv_id") % 7)).alias("customer_id"), F.when(F.col("conv_id") % 3 != 0, START_SECONDS + F.col("conv_id") * 3600).alias("created_at"),
        F.when(F.col("conv_id") % 4 != 0, "m1").alias("model_name"), F.concat(F.lit("r"), F.col("conv_id") % 2).alias("release"), F.transform("m", lambda y: F.struct(y["sender"].alias("sender"), y["text"].alias("text"), y["time"].alias("time"))).alias("dialog"),
    )


def message_rows(conversations: DataFrame) -> DataFrame:
    """A row per message; some bring a time, all but the first a user."""
    return conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("content"), F.when(F.col("turn") % 2 == 1, START_SECONDS + F.col("conv_id") * 3600 - F.col("turn")).alias("time"),
        F.when(F.col("turn") > 0, F.concat(F.lit("u"), F.col("conv_id"))).alias("user_id"),
    )


def trace_rows(conversations: DataFrame) -> DataFrame:
    """A span for each reply, with the user text before it; a second call with the same user text for some."""
    last = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True)
    rows = spoken(conversations).withColumn("asked", last.over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    rows = rows.withColumn("call", F.explode(F.when(F.col("turn") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    one = lambda c: F.to_json(F.array(F.struct(F.when(F.lit(c == "asked"), "user").otherwise("assistant").alias("role"), F.col(c).alias("content"))))
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    attributes = F.array(text("gen_ai.request.model", F.lit("m1")), text("gen_ai.input.messages", one("asked")), text("gen_ai.output.messages", one("text")), text("gen_ai.agent.name", F.when(F.col("call") == 0, "planner").otherwise("writer")))
    nanos = (F.lit(START_NANOS) + F.col("conv_id") * 3_600_000_000_000 + F.col("turn") * 1_000_000_000 + F.col("call") * 1_000_000).cast("string")
    span = F.struct(F.col("conv_id").cast("string").alias("traceId"), F.concat_ws("-", "conv_id", "turn", "call").alias("spanId"), F.lit("chat").alias("name"), nanos.alias("startTimeUnixNano"), attributes.alias("attributes"))
    resource = F.struct(F.array(text("user.id", F.concat(F.lit("u"), F.col("conv_id") % 7))).alias("attributes"))
    return rows.select(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))


def export_rows(conversations: DataFrame) -> DataFrame:
    """Exported trees: each message hangs under the one before; replies have an abandoned sibling; system turns are hidden."""
    node = lambda ident, parent, text, hidden: F.struct(
        ident.alias("id"), parent.alias("parent"),
        F.struct(F.struct(F.col("role")).alias("author"), F.lit("all").alias("recipient"), F.struct(F.lit("text").alias("content_type"), F.array(text).alias("parts")).alias("content"), F.struct(hidden.alias("is_visually_hidden_from_conversation"), F.lit("m1").alias("model_slug")).alias("metadata")).alias("message"),
    )
    name = lambda turn, prefix: F.concat(F.lit(prefix), turn.cast("string"))
    parent = F.when(F.col("turn") > 0, name(F.col("turn") - 1, "n")).otherwise(F.lit("root"))
    kept, dropped = node(name(F.col("turn"), "n"), parent, F.col("text"), F.col("role") == "system"), node(name(F.col("turn"), "x"), parent, F.lit("abandoned"), F.lit(False))
    rows = conversations.select("conv_id", "turn", F.explode(F.when(F.col("role") == "assistant", F.array(kept, dropped)).otherwise(F.array(kept))).alias("n"))
    rows = rows.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n.id"), F.col("n")))).alias("mapping"), F.max("turn").alias("last"))
    return rows.select(F.col("conv_id").cast("string").alias("conversation_id"), (F.lit(1709510400.0) + F.col("conv_id") * 3600).alias("create_time"), name(F.col("last"), "n").alias("current_node"), F.lit("m1").alias("default_model_slug"), "mapping")


def sender_rows(conversations: DataFrame) -> DataFrame:
    """Exports of one person's chats, with senders instead of roles."""
    m = F.struct("turn", F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), F.col("text"))
    rows = spoken(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return rows.select(F.col("conv_id").cast("string").alias("uuid"), F.lit("2024-03-04T00:00:00Z").alias("created_at"), F.transform("m", lambda y: F.struct(y["sender"].alias("sender"), y["text"].alias("text"))).alias("chat_messages"))

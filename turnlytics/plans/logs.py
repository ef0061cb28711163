"""Queries for log formats, exports, run facts, reconciliation and streams.

Log files are written from the given conversations, then read as a user's files would be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlytics.functions import rules as R
from turnlytics.operators import checks as C
from turnlytics.operators import decide as D
from turnlytics.operators import labels as L
from turnlytics.operators import metrics as M
from turnlytics.operators import publish as P
from turnlytics import schema
from turnlytics.sources import chats, shards, store
from turnlytics.sources.files import shared_folder
from turnlytics.streaming import ingest, live

from .analysis import _CASES, _FAILURE, themes
from .analysis import ORACLE_SQL as ANALYSIS_SQL
from .core import FAMILY, MIN_CELL, N, RATES, Chat, _chat_sql, chat_query, sql_prefix
from .core import ORACLE_SQL as METRIC_SQL
from .fixtures import chat, log_files
from .labelling import _PRED, _REPORT, predictions

def flat(chats_frame: DataFrame) -> DataFrame:
    """Message rows in plain columns, so that results compare with SQL."""
    return chats.as_messages(chats_frame).select("conv_id", "user", "ts", "model", "version", F.col("idx").cast("long").alias("idx"), "role", "content", "responder")


def objects(x: Chat, *without: str) -> DataFrame:
    path = shared_folder(x.spark, "chat-objects")
    log_files.object_rows(x.table("conversations")).drop(*without).write.json(path)
    return chats.read_chat_objects(x.spark, path)


def nameless(x: Chat) -> DataFrame:
    """Objects without ids: every one is a conversation of its own."""
    rows = objects(x, "session_id")
    return flat(rows).groupBy("conv_id", "user", "ts", "model", "version").agg(F.count(F.lit(1)).alias("messages"), F.min_by("content", "idx").alias("opening")).drop("conv_id")


def csv_turns(x: Chat, *columns: str) -> DataFrame:
    path = shared_folder(x.spark, "turn-rows")
    rows = log_files.message_rows(x.table("conversations"))
    rows.select("conv_id", *columns, "role", "content", "time", "user_id").write.csv(path, header=True, escape='"', quote='"', quoteAll=True)
    return chats.read_turn_rows(x.spark, path)


def arriving(x: Chat, parts: int = 9) -> DataFrame:
    """Message rows without an order column, in the order of turns over several files of unequal sizes."""
    rows = x.table("conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    file = F.when(F.col("turn") >= parts, F.lit(parts)).otherwise(F.col("turn")).cast("int")
    return rows.repartitionByRange(parts + 1, file).sortWithinPartitions("turn", "conv_id").drop("turn")


def arrived(x: Chat) -> DataFrame:
    path = shared_folder(x.spark, "arrival")
    arriving(x).write.csv(path, header=True, escape='"', quote='"', quoteAll=True)
    return chats.read_turn_rows(x.spark, path)


def many_files(x: Chat) -> DataFrame:
    """The same as JSON lines, which tasks may split, with rows of another role that name a model."""
    path = shared_folder(x.spark, "arrival-lines")
    model = F.when(F.col("role") == "assistant", F.concat(F.lit("m"), F.col("conv_id") % 3)).when(F.col("role") == "system", "sysmodel")
    arriving(x).withColumn("model", model).withColumn("role", F.when(F.col("role") == "assistant", "AI").otherwise(F.col("role"))).write.json(path)
    return chats.turn_rows(x.spark.read.schema("conv_id STRING, role STRING, content STRING, model STRING").json(path))


def facts(x: Chat) -> DataFrame:
    """Facts per conversation of a log, from messages within the row."""
    rows = x.nested
    messages = F.transform("messages", lambda y: F.struct(y["role"].alias("role"), y["content"].alias("content"), F.nullif(y["responder"], F.lit("")).alias("responder")))
    user = F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("u"), F.col("conv_id") % 7))
    none = F.lit(None).cast("string")
    return chats.log_facts(rows.select(F.col("conv_id").cast("string").alias("id"), user.alias("user"), F.lit(None).cast("timestamp_ntz").alias("ts"), none.alias("model"), none.alias("version"), messages.alias("messages"))).drop("ts", "model", "version")


def trace_files(x: Chat) -> DataFrame:
    path = shared_folder(x.spark, "traces")
    log_files.trace_rows(x.table("conversations")).write.json(path)
    return chats.read_traces(x.spark, path)


def export_files(x: Chat) -> DataFrame:
    path = shared_folder(x.spark, "export")
    log_files.export_rows(x.table("conversations")).write.json(path)
    return chats.export_threads(x.spark.read.schema(chats.EXPORT).json(path))


def sender_files(x: Chat) -> DataFrame:
    path = shared_folder(x.spark, "senders")
    log_files.sender_rows(x.table("conversations")).write.json(path)
    return chats.sender_exports(x.spark.read.json(path))


def metric_tables(x: Chat) -> dict[str, DataFrame]:
    """All metric tables, from the flat tables of turns and conversations."""
    c, i, t = x.conversations, x.intent, x.turns
    return {
        "volume_daily_model": M.volume_daily_model(c), "depth_by_model": M.depth_by_model(c), "volume_weekly_country": M.volume_weekly_country(c, MIN_CELL), "volume_weekly_language": M.volume_weekly_language(c, MIN_CELL),
        "intensity_weekly": M.intensity_weekly(c), "intensity_weekly_model": M.intensity_weekly_model(c, MIN_CELL), "persistence_quarterly": M.persistence_quarterly(c),
        "intent_by_model": M.intent_by_model(c, i), "intent_by_language": M.intent_by_language(c, i, MIN_CELL), "intent_weekly": M.intent_weekly(c, i), "intent_weekly_model": M.intent_weekly_model(c, i, MIN_CELL),
        "friction_weekly": M.friction_weekly(c), "friction_weekly_model": M.friction_weekly_model(c, MIN_CELL), "friction_by_intent_model": M.friction_by_intent_model(c, i, MIN_CELL), "friction_by_intent_model_era": M.friction_by_intent_model_era(c, i, x.eras, MIN_CELL),
        "friction_by_responder": M.friction_by_responder(t, c, MIN_CELL), "data_quality_weekly": M.data_quality_weekly(c), "data_quality_weekly_model": M.data_quality_weekly_model(c, MIN_CELL),
    }


def consistency(x: Chat) -> DataFrame:
    """The tables against each other, each worked out and written once.  Cells of all sizes, so that cuts add up."""
    tables = metric_tables(x)
    tables |= {"friction_weekly_model": M.friction_weekly_model(x.conversations, 1), "data_quality_weekly_model": M.data_quality_weekly_model(x.conversations, 1)}
    total = x.conversations.agg(F.count(F.lit(1)).alias("conversations"), F.count(F.when(~F.col("has_empty_user_input"), F.col("label"))).alias("labelled"))
    tables = {name: x.written(rows.coalesce(1), f"metric-{name}") for name, rows in tables.items()}  # cells, not rows of data
    return C.reconcile(tables, x.written(total, "totals"))


def declared_checks(x: Chat) -> DataFrame:
    x.conversations.createOrReplaceTempView("flat_conversations")
    return C.run_checks(x.spark, [("no negative lengths", "SELECT count(*) FROM flat_conversations WHERE first_user_len < 0", 0, 0), ("models", "SELECT count(DISTINCT model_family) FROM flat_conversations", 5, 0), ("wrong on purpose", "SELECT count(*) FROM flat_conversations WHERE n_turns = 0", 1, 0)]).drop("error")


def ingested(x: Chat) -> DataFrame:
    """Raw shard files, ingested twice by a stream; the second call finds nothing new."""
    path = shared_folder(x.spark, "ingest")
    raw = x.raw.drop("shard").withColumns({"conversation_hash": F.lit(None).cast("string"), "toxic": F.lit(False)})
    raw.write.option("compression", "zstd").parquet(f"{path}/raw")
    for _ in range(2):
        ingest.ingest_shards(x.spark, f"{path}/raw", f"{path}/flat", f"{path}/checkpoint", raw.schema)
    rows = store.flat_store(x.spark, f"{path}/flat").table("conversations")
    return rows.groupBy("week").agg(F.count(F.lit(1)).alias("conversations"), F.sum(F.col("n_turns").cast("long")).alias("turns"))


def same_names(x: Chat) -> DataFrame:
    """Two folders with files of the same names, flattened in two calls, the second after more files came; a third finds nothing."""
    path = shared_folder(x.spark, "same-names")
    raw = x.raw.drop("shard").withColumns({"conversation_hash": F.lit(None).cast("string"), "toxic": F.lit(False)})
    conv_id = F.col("conversation")[0]["turn_identifier"]
    half = conv_id % 2
    flat = store.flat_store(x.spark, f"{path}/flat")
    for k in range(2):
        part = raw.where(half == k).repartition(3, F.floor(conv_id / 1000))  # repetitions of a conversation stay together, and compress
        part.write.option("compression", "zstd").parquet(f"{path}/written-{k}")
        files = [r["path"] for r in store.source_files(x.spark, f"{path}/written-{k}").orderBy("path").select("path").collect()]  # three
        for n, file in enumerate(files):
            x.spark.read.schema(raw.schema).parquet(file).coalesce(1).write.mode("append").option("compression", "zstd").parquet(f"{path}/raw/{'ab'[k]}")
            _renamed(x, f"{path}/raw/{'ab'[k]}", f"part-{n}.parquet")
        store.flatten_new(flat, f"{path}/raw", raw.schema)
    if store.flatten_new(flat, f"{path}/raw", raw.schema):
        raise RuntimeError("files were flattened twice")
    conversations, turns = flat.table("conversations"), flat.table("turns")
    per = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if("is_correction").alias("corrections"))
    rows = conversations.join(per, "conv_id").groupBy(F.substring_index("shard", "/", 1).alias("folder"))
    return rows.agg(F.count(F.lit(1)).alias("conversations"), F.sum("turns").alias("turns"), F.sum("corrections").alias("corrections"), F.count_distinct("shard").alias("files"))


def _renamed(x: Chat, folder: str, name: str) -> None:
    """Gives the file that was just written a fixed name."""
    at = x.spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(x.spark._jsc.hadoopConfiguration())
    new = next(s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-0000"))
    fs.rename(new, x.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))


def exported_cases(x: Chat) -> DataFrame:
    """Failure cases as JSON lines, read back."""
    path = shared_folder(x.spark, "failure-cases")
    chats.write_failure_cases(D.with_reason(x.failures.drop("opening")), path)
    return x.spark.read.schema("conv_id BIGINT, idx INT, failure STRING, bad_reply STRING, user_feedback STRING, prev_request STRING, attributed_to STRING, reason STRING").json(path)


def exported_backlog(x: Chat) -> DataFrame:
    """Themes with reasons and opening asks as CSV, read back."""
    path = shared_folder(x.spark, "backlog")
    chats.write_backlog(themes(x).drop("share"), path)
    return x.spark.read.csv(path, header=True, multiLine=True, escape='"', schema="intent STRING, responder STRING, failures BIGINT, corrections BIGINT, repeats BIGINT, conversations BIGINT, top_reason STRING, examples STRING").withColumn("examples", F.coalesce("examples", F.lit("")))


def exported_fixes(x: Chat) -> DataFrame:
    path = shared_folder(x.spark, "fixes")
    chats.write_fix_list(D.fix_list(x.labelled), path)
    return x.spark.read.csv(path, header=True, escape='"').select(F.col("rank").cast("long").alias("rank"), "intent", F.col("flagged").cast("long").alias("flagged"), "title")


def facts_of_run(x: Chat) -> DataFrame:
    coverage = shards.intent_coverage(x.conversations, x.labelled.where("intent IS NOT NULL"))
    gate = L.gate(L.summary(predictions(x)), 0.8707)
    return C.run_facts(C.run_meta(x.conversations, x.intent), coverage, gate, MIN_CELL).withColumn("caveats", F.size("caveats").cast("long"))


def streamed_weeks(x: Chat) -> DataFrame:
    """The weekly counts of ``events`` as a stream, to its end."""
    spark, folder = x.spark, shared_folder(x.spark, "events-stream")
    columns = spark.read.parquet(f"{x.sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(columns).parquet(f"{x.sf_dir}/event[s].parquet")  # a pattern may name a single file
    return ingest.stream_to_table(ingest.weekly_volume(stream), ["week", "event_type"], f"{folder}/table", f"{folder}/checkpoint")


def live_weeks(x: Chat) -> DataFrame:
    """Weekly friction from a stream of messages; a conversation's messages are spread over files and batches in any order."""
    path = shared_folder(x.spark, "live")
    rows = chat.with_attributes(x.nested, x.spark, x.sf_dir).select("conv_id", F.to_timestamp_ltz(F.concat(F.col("ts").cast("string"), F.lit("+00:00"))).alias("ts"), "model", F.inline("messages"))
    rows = rows.select("conv_id", "ts", F.col("idx").cast("int").alias("idx"), "role", "content", "responder", "model")
    parts = 3
    for k in range(parts):  # written where they stand, a third at a time
        rows.where(F.pmod(F.xxhash64("conv_id", "idx"), F.lit(parts)) == k).write.mode("append").option("compression", "zstd").parquet(f"{path}/messages")
    files = len(x.spark.read.schema(rows.schema).parquet(f"{path}/messages").inputFiles())
    stream = x.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // parts)).parquet(f"{path}/messages")
    live.run_live(live.live_conversations(stream, delay_ms=400 * 86_400_000), f"{path}/facts", f"{path}/checkpoint")
    return M.friction_weekly(live.latest_conversations(x.spark, f"{path}/facts"))


def published(x: Chat) -> DataFrame:
    path = shared_folder(x.spark, "published")
    tables = metric_tables(x)
    P.write_metrics(tables, path)
    rows = None
    for name in sorted(tables):  # a table each, of a bounded number of cells
        one = x.spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("cells")).select(F.lit(name).alias("table_name"), "cells")
        rows = one if rows is None else rows.unionAll(one)
    return P.published_size(x.spark, path).join(rows, "table_name")


def published_views(x: Chat) -> tuple[str, list[str]]:
    path = shared_folder(x.spark, "published")
    tables = metric_tables(x)
    P.write_metrics(tables, path)
    P.register_published(x.spark, path, list(tables))
    return path, list(tables)


# Fixed value: a question over three published tables.
PUBLISHED_QUESTION = """SELECT i.week, i.conversations, i.pseudo_users, f.correction_rate, q.redacted_rate, i.conversations / i.pseudo_users AS per_user
FROM intensity_weekly i JOIN friction_weekly f ON i.week = f.week JOIN data_quality_weekly q ON i.week = q.week WHERE i.next_week_present"""


def published_answer(x: Chat) -> DataFrame:
    path, _ = published_views(x)
    return P.published_query(x.spark, path, PUBLISHED_QUESTION)


def nested_access(x: Chat) -> DataFrame:
    """Fields of JSON by paths of one and of several steps."""
    whole = F.to_json(F.struct(F.struct(F.struct("event_type", F.round("value").cast("long").alias("rounded")).alias("policies")).alias("B")))
    rows = x.table("events").select("event_id", "props", whole.alias("report"))
    return rows.select("event_id", F.get_json_object("props", "$").alias("whole"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("report", "$.B.policies.event_type").alias("event_type"), F.get_json_object("report", "$.B.policies.rounded").cast("long").alias("rounded"), F.get_json_object("report", "$.B.gone").alias("gone"))


def weekly_change(x: Chat) -> DataFrame:
    """Conversations per week against the week before."""
    rows = x.conversations.groupBy("week").agg(M.count_rows().alias("n"))
    change, direction = P.percent_change(F.col("n"), F.col("before"))
    rows = rows.withColumn("before", F.lag("n").over(Window.orderBy("week")))  # a row per week
    return rows.select("week", "n", change.alias("percent"), direction.alias("direction"))


def story(x: Chat) -> DataFrame:
    """Headline numbers, re-derived from aggregates."""
    weekly, friction = M.intensity_weekly(x.conversations), M.friction_weekly(x.conversations)
    a = weekly.agg(F.sum("conversations").alias("conversations"), F.max("pseudo_users").alias("peak_users"), F.avg("return_rate").alias("mean_return"))
    rates = [(F.sum(F.col("conversations") * F.col(r)) / F.sum("conversations")).alias(r) for r in M.PROXIES]
    return a.join(F.broadcast(friction.agg(*rates)))  # one row


def ad_hoc(x: Chat) -> DataFrame:
    """A user's SQL with the registered rule functions."""
    R.register_sql(x.spark)
    return x.spark.sql("SELECT model_family(c.model) AS model, count_if(is_correction(m.content)) AS corrections, count_if(is_refusal(m.content)) AS refusals FROM {m} m JOIN {c} c ON m.conv_id = c.conv_id GROUP BY 1", m=x.messages, c=x.conversations.select("conv_id", "model"))


QUERIES = {
    "chat_objects": chat_query(lambda x: flat(objects(x))),
    "chat_objects_coverage": chat_query(lambda x: chats.coverage(objects(x))),
    "chat_objects_without_ids": chat_query(nameless),
    "turn_rows_csv": chat_query(lambda x: flat(csv_turns(x, "turn"))),
    "turn_rows_arrival": chat_query(lambda x: flat(arrived(x))),
    "turn_rows_many_files": chat_query(lambda x: flat(many_files(x))),
    "log_facts": chat_query(facts),
    "otlp_traces": chat_query(lambda x: flat(trace_files(x))),
    "chat_export_thread": chat_query(lambda x: flat(export_files(x))),
    "sender_export": chat_query(lambda x: flat(sender_files(x))),
    "eval_case_export": chat_query(lambda x: chats.eval_case_text(D.with_reason(x.failures.drop("opening")))),
    "failure_case_export": chat_query(exported_cases),
    "backlog_export": chat_query(exported_backlog),
    "fix_list_export": chat_query(exported_fixes),
    "run_meta": chat_query(lambda x: C.run_meta(x.conversations, x.intent)),
    "run_facts": chat_query(facts_of_run),
    "intent_coverage": chat_query(lambda x: shards.intent_coverage(x.conversations, x.labelled.where("intent IS NOT NULL AND shard <> 'shard-3'"))),
    "intent_coverage_full": chat_query(lambda x: shards.intent_coverage(x.conversations, x.labelled.where("intent IS NOT NULL"), forced=True)),
    "intent_coverage_none": chat_query(lambda x: shards.intent_coverage(x.conversations, shards.table_or_empty(x.spark, shared_folder(x.spark, "no-intents"), schema.INTENT))),
    "shard_subset": chat_query(lambda x: x.conversations.where(F.col("shard").isin(shards.chosen_shards("0-1,3", [f"shard-{k}" for k in range(4)]))).groupBy("shard").agg(M.count_rows().alias("conversations"))),
    "unfinished_shards": chat_query(lambda x: shards.unfinished(x.conversations, x.conversations.where("shard IN ('shard-0', 'shard-2')")).groupBy("shard").agg(M.count_rows().alias("conversations"))),
    "legacy_turns": chat_query(lambda x: M.friction_by_responder(shards.with_missing(x.turns.drop("attributed_to"), {"attributed_to": "string"}), x.conversations, MIN_CELL)),
    "consistency_checks": chat_query(consistency),
    "declared_checks": chat_query(declared_checks),
    "story_numbers": chat_query(story),
    "ad_hoc_sql": chat_query(ad_hoc),
    "published_tables": chat_query(published),
    "published_catalogue": chat_query(lambda x: P.published_catalogue(x.spark, published_views(x)[1])),
    "published_sql": chat_query(published_answer),
    "responder_split": chat_query(lambda x: P.responder_split(M.friction_by_responder(x.turns, x.conversations, MIN_CELL), M.volume_daily_model(x.conversations))),
    "weekly_change": chat_query(weekly_change),
    "nested_json_access": chat_query(nested_access),
    "incremental_ingest": chat_query(ingested),
    "ingest_same_names": chat_query(same_names),
    "events_stream_weekly": chat_query(streamed_weeks),
    "live_friction_weekly": chat_query(live_weeks),
}

_M = "SELECT conv_id::VARCHAR AS conv_id, {user} AS user, {ts} AS ts, {model} AS model, {version} AS version, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS idx, role, text AS content, {responder} AS responder FROM {source} WHERE role IN ('user', 'assistant')"
_START = "TIMESTAMP '2024-03-04 00:00:00'"
_NO_TIME, _NONE = "NULL::TIMESTAMP", "NULL::VARCHAR"
_HOUR = f"{_START} + to_hours(conv_id::INTEGER)"
_OBJECTS = f"(SELECT *, CASE WHEN conv_id % 3 <> 0 THEN {_HOUR} ELSE {_HOUR} + to_minutes((min(turn) FILTER (turn > 0 AND role IN ('user', 'assistant')) OVER (PARTITION BY conv_id))::INTEGER) END AS moment FROM conversations)"
_OBJECT = {"user": "CASE WHEN conv_id % 5 <> 0 THEN concat('u', conv_id % 7) END", "model": "CASE WHEN conv_id % 4 <> 0 THEN 'm1' END", "version": "concat('r', conv_id % 2)", "ts": "moment", "source": _OBJECTS}
# message rows bring the earliest time, and the user where any spoken row names one
_SPOKEN = "role IN ('user', 'assistant')"
_CSV_TIME = f"(SELECT *, min({_HOUR} - to_seconds(turn)) FILTER (turn % 2 = 1 AND {_SPOKEN}) OVER (PARTITION BY conv_id) AS moment, CASE WHEN max(turn) FILTER ({_SPOKEN}) OVER (PARTITION BY conv_id) > 0 THEN concat('u', conv_id) END AS person FROM conversations)"
_REPLY_MODEL = "(SELECT *, CASE WHEN bool_or(role = 'assistant') OVER (PARTITION BY conv_id) THEN concat('m', conv_id % 3) END AS named FROM conversations)"
_SPANS = f"""calls AS (
 SELECT conv_id, turn, k, asked, text FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations WHERE role IN ('user', 'assistant')), (VALUES (0), (1)) AS c(k)
 WHERE role = 'assistant' AND (k = 0 OR turn % 3 = 0)
), told AS (SELECT *, asked IS NOT NULL AND coalesce(asked <> lag(asked) OVER (PARTITION BY conv_id ORDER BY turn, k), true) AS fresh FROM calls),
said AS (SELECT conv_id, turn, k, 0 AS part, 'user' AS role, asked AS content, NULL AS responder FROM told WHERE fresh UNION ALL SELECT conv_id, turn, k, 1, 'assistant', text, CASE WHEN k = 0 THEN 'planner' ELSE 'writer' END FROM told)"""

_META = """SELECT *, labelled / conversations AS labelled_share FROM (
 SELECT count(*)::BIGINT AS conversations, min(date) AS date_min, max(date) AS date_max, count(DISTINCT shard)::BIGINT AS shards, min(week) FILTER (prompt_tokens IS NOT NULL) AS first_token_week, count(intent)::BIGINT AS labelled,
  date_trunc('week', min(date) + 6)::DATE AS complete_weeks_from, date_trunc('week', max(date) - 6)::DATE AS complete_weeks_through FROM c)"""
_COVERAGE = "SELECT CASE WHEN labelled_shards = 0 THEN 'none' WHEN labelled_shards = shards THEN '{full}' ELSE 'partial' END AS coverage, shards, labelled_shards FROM (SELECT count(DISTINCT shard)::BIGINT AS shards, (count(DISTINCT shard) FILTER ({labelled}))::BIGINT AS labelled_shards FROM c)"
_TABLES = ["volume_daily_model", "depth_by_model", "volume_weekly_country", "volume_weekly_language", "intensity_weekly", "intensity_weekly_model", "persistence_quarterly", "intent_by_model", "intent_by_language", "intent_weekly", "intent_weekly_model", "friction_weekly", "friction_weekly_model", "friction_by_intent_model", "friction_by_intent_model_era", "friction_by_responder", "data_quality_weekly", "data_quality_weekly_model"]


def _on_chat(name: str) -> str:
    """A metric's SQL as a subquery of one that has the chat tables already."""
    rest = METRIC_SQL[name].removeprefix(sql_prefix())
    return f"WITH RECURSIVE {rest[1:].lstrip()}" if rest.startswith(",") else rest


def _same_weeks(a: str, b: str) -> str:
    return f"SELECT count(*) FROM (SELECT week, sum(conversations) AS n FROM {a} GROUP BY 1) x FULL JOIN (SELECT week, sum(conversations) AS n FROM {b} GROUP BY 1) y USING (week) WHERE x.n IS DISTINCT FROM y.n"


def _outside(table: str, *columns: str) -> str:
    return "SELECT " + " + ".join(f"count(*) FILTER ({c} < 0 OR {c} > 1)" for c in columns) + f" FROM {table}"


def _expectations() -> list[tuple[str, str, str, float]]:
    total, labelled = "SELECT count(*) FROM c", "SELECT count(intent) FROM c"
    daily = "(SELECT *, date_trunc('week', date)::DATE AS week FROM volume_daily_model)"
    out = [(f"{n} adds up", f"SELECT sum(conversations) FROM {n}", total, 0) for n in ("volume_daily_model", "depth_by_model", "volume_weekly_country", "volume_weekly_language")]
    out += [(f"{n} adds up to the labelled", f"SELECT sum(conversations) FROM {n}", labelled, 0) for n in ("intent_by_model", "intent_weekly")]
    out += [(f"{n} has the weekly volume", _same_weeks(daily, n), "SELECT 0", 0) for n in ("intensity_weekly", "data_quality_weekly")]
    out += [(f"{p} adds up to {w}", _same_weeks(f"(SELECT week, model_family, count(*) AS conversations FROM c WHERE {cut} GROUP BY 1, 2)", w), "SELECT 0", 0) for p, w, cut in (("friction_weekly_model", "friction_weekly", "NOT has_empty_user_input"), ("data_quality_weekly_model", "data_quality_weekly", "true"))]
    out += [
        ("intensity_weekly_model has the models' volume", f"SELECT count(*) FROM intensity_weekly_model i JOIN (SELECT week, model, sum(conversations) AS n FROM {daily} GROUP BY 1, 2) v USING (week, model) WHERE i.conversations <> v.n", "SELECT 0", 0),
        ("responders that are no model's name", "SELECT count(*) FROM friction_by_responder WHERE responder NOT IN (SELECT model FROM volume_daily_model)", "SELECT 0", 0),
        ("the last complete week has a row", "SELECT count(*) FROM intensity_weekly WHERE week = (SELECT date_trunc('week', max(date) - 6)::DATE FROM c)", "SELECT 1", 0),
        ("friction leaves out empty inputs", "SELECT max(abs(f.conversations - round(d.conversations * (1 - d.empty_input_rate)))) FROM friction_weekly f JOIN data_quality_weekly d USING (week)", "SELECT 0", 1),
        ("era cells within all-time cells", "SELECT count(*) FROM friction_by_intent_model_era e JOIN friction_by_intent_model a USING (intent, model) WHERE e.conversations > a.conversations", "SELECT 0", 0),
        ("intent cells within weekly intents", "SELECT count(*) FROM (SELECT week, sum(conversations) AS n FROM intent_weekly_model GROUP BY 1) a JOIN (SELECT week, sum(conversations) AS n FROM intent_weekly GROUP BY 1) b USING (week) WHERE a.n > b.n", "SELECT 0", 0),
        ("friction rates within 0 and 1", _outside("friction_weekly", "repeat_rate", "one_and_done_rate", "correction_rate", "refusal_rate"), "SELECT 0", 0),
        ("intensity rates within 0 and 1", _outside("intensity_weekly", "return_rate", "top10_share"), "SELECT 0", 0),
        ("intensity rates of models within 0 and 1", _outside("intensity_weekly_model", "return_rate", "top10_share"), "SELECT 0", 0),
        ("quality rates within 0 and 1", _outside("data_quality_weekly", "redacted_rate", "token_usage_coverage"), "SELECT 0", 0),
        ("responder rates within 0 and 1", _outside("friction_by_responder", "correction_rate", "repeat_rate"), "SELECT 0", 0),
        ("return rate is null where no next week is", "SELECT count(*) FROM intensity_weekly WHERE (return_rate IS NULL) = next_week_present", "SELECT 0", 0),
    ]
    return out


_METRIC_STEPS = [f"{n} AS MATERIALIZED ({_on_chat(n)})" for n in _TABLES]

def _catalogue_sql() -> str:
    kinds = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(column_type) END"
    meanings = ", ".join("('{}', '{}')".format(c, t.replace("'", "''")) for c, t in P.COLUMNS.items())
    each = " UNION ALL ".join(f"SELECT '{n}' AS table_name, column_name, {kinds} AS data_type FROM (DESCRIBE {METRIC_SQL[n]})" for n in _TABLES)
    return f"SELECT table_name, column_name, data_type, meaning AS comment FROM ({each}) JOIN (VALUES {meanings}) AS m(name, meaning) ON column_name = name"


ORACLE_SQL = {
    "consistency_checks": _chat_sql(
        "SELECT label, got, want, abs(got - want) <= tolerance AS ok FROM (" + " UNION ALL ".join(f"SELECT '{label.replace(chr(39), chr(39) * 2)}' AS label, coalesce(({got})::DOUBLE, 0) AS got, coalesce(({want})::DOUBLE, 0) AS want, {tolerance} AS tolerance" for label, got, want, tolerance in _expectations()) + ")", *_METRIC_STEPS
    ),
    "chat_objects": _M.format(**_OBJECT, responder=_NONE),
    "chat_objects_without_ids": f"SELECT user, ts, model, version, count(*)::BIGINT AS messages, arg_min(content, idx) AS opening FROM ({_M.format(**_OBJECT, responder=_NONE)}) GROUP BY conv_id, user, ts, model, version",
    "chat_objects_coverage": f"""SELECT *, array_to_string(list_filter([CASE WHEN user_coverage < 0.5 THEN 'no_users' END, CASE WHEN ts_coverage < 0.5 THEN 'no_weeks' END, CASE WHEN model_coverage < 0.5 THEN 'no_models' END], lambda n: n IS NOT NULL), ',') AS notes
FROM (SELECT count(*)::BIGINT AS conversations, avg((conv_id % 5 <> 0)::INT) AS user_coverage, avg((moment IS NOT NULL)::INT) AS ts_coverage, avg((conv_id % 4 <> 0)::INT) AS model_coverage FROM (SELECT DISTINCT conv_id, moment FROM {_OBJECTS}))""",
    "turn_rows_csv": _M.format(user="person", ts="moment", model=_NONE, version=_NONE, responder=_NONE, source=_CSV_TIME),
    "turn_rows_arrival": _M.format(user=_NONE, ts=_NO_TIME, model=_NONE, version=_NONE, responder=_NONE, source="conversations"),
    # a reply without responder column is named after its model
    "turn_rows_many_files": _M.format(user=_NONE, ts=_NO_TIME, model="named", version=_NONE, responder="CASE WHEN role = 'assistant' THEN concat('m', conv_id % 3) END", source=_REPLY_MODEL),
    "log_facts": _chat_sql("""SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 4 <> 0 THEN concat('u', conv_id % 7) ELSE concat('conv:', conv_id) END AS user, n_turns AS turns, repeated_request AS repeat, correction_followup AS correction, one_and_done AS one_turn FROM c"""),
    "otlp_traces": f"WITH {_SPANS} SELECT conv_id::VARCHAR AS conv_id, concat('u', conv_id % 7) AS user, {_HOUR} + to_seconds((min(turn) OVER (PARTITION BY conv_id))::INTEGER) AS ts, 'm1' AS model, NULL::VARCHAR AS version, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k, part))::BIGINT AS idx, role, content, responder FROM said",
    "chat_export_thread": _M.format(user="'you'", ts=_HOUR, model="'m1'", version=_NONE, responder="'m1'", source="conversations"),
    "sender_export": _M.format(user="'you'", ts=_START, model=_NONE, version=_NONE, responder=_NONE, source="conversations"),
    "eval_case_export": _chat_sql("""SELECT concat_ws(chr(10), concat('- description: ', reason), concat('  vars: ', CASE WHEN prev_request IS NULL THEN '{}' ELSE to_json({'x': prev_request})::VARCHAR END), concat('  not: ', to_json({'x': bad_reply})::VARCHAR)) AS value FROM cases""", _FAILURE, _CASES),
    "failure_case_export": _chat_sql("SELECT conv_id, idx, failure, bad_reply, user_feedback, prev_request, attributed_to, reason FROM cases", _FAILURE, _CASES),
    "backlog_export": f"SELECT * EXCLUDE (share) FROM (\n{ANALYSIS_SQL['backlog_themes']}\n)",
    "fix_list_export": f"SELECT rank::BIGINT AS rank, intent, flagged, concat('Fewer repeats and corrections in ', intent, ' (', round(100 * rate, 1), '% of conversations)') AS title FROM (\n{ANALYSIS_SQL['fix_list']}\n)",
    "run_meta": _chat_sql(_META),
    "run_facts": _chat_sql(f"""SELECT m.*, 'full' AS intent_coverage, g.*, {MIN_CELL}::INTEGER AS min_cell, {len(C.CAVEATS)}::BIGINT AS caveats FROM ({_META}) m,
 (SELECT n AS classifier_n_test, accuracy AS classifier_accuracy, f1 AS classifier_macro_f1, 0.7836::DOUBLE AS classifier_threshold, false AS classifier_forced FROM (SELECT count(*)::BIGINT AS n, avg((label = pred)::INT) AS accuracy FROM p), (SELECT avg(f1) AS f1 FROM scored WHERE support > 0)) g""", _PRED, _REPORT),
    "intent_coverage": _chat_sql(_COVERAGE.format(labelled="intent IS NOT NULL AND shard <> 'shard-3'", full="full")),
    "intent_coverage_full": _chat_sql(_COVERAGE.format(labelled="intent IS NOT NULL", full="forced_below_threshold")),
    "intent_coverage_none": _chat_sql(_COVERAGE.format(labelled="false", full="full")),
    "shard_subset": _chat_sql(f"SELECT shard, {N} FROM c WHERE shard IN ('shard-0', 'shard-1', 'shard-3') GROUP BY shard"),
    "unfinished_shards": _chat_sql(f"SELECT shard, {N} FROM c WHERE shard NOT IN ('shard-0', 'shard-2') GROUP BY shard"),
    "legacy_turns": _chat_sql(f"""SELECT responder, n AS assistant_turns, corrections, repeats, corrections / n AS correction_rate, repeats / n AS repeat_rate FROM (
 SELECT model_family AS responder, count_if(role <> 'user')::BIGINT AS n, count_if(is_correction)::BIGINT AS corrections, count_if(repeats_prev_user)::BIGINT AS repeats FROM turns JOIN c USING (conv_id) WHERE NOT has_empty_user_input GROUP BY 1) WHERE n >= {MIN_CELL}"""),
    "declared_checks": _chat_sql("""SELECT 'no negative lengths' AS label, count(*) FILTER (first_user_len < 0)::DOUBLE AS got, count(*) FILTER (first_user_len < 0) = 0 AS ok FROM c
UNION ALL SELECT 'models', count(DISTINCT model_family)::DOUBLE, count(DISTINCT model_family) = 5 FROM c UNION ALL SELECT 'wrong on purpose', count(*) FILTER (n_turns = 0)::DOUBLE, count(*) FILTER (n_turns = 0) = 1 FROM c"""),
    "story_numbers": _chat_sql(f"""SELECT a.*, b.* FROM (SELECT sum(n)::BIGINT AS conversations, max(u)::BIGINT AS peak_users, avg(r) AS mean_return FROM (
 SELECT x.week, any_value(n) AS n, count(*) AS u, CASE WHEN x.week + 7 IN (SELECT week FROM c) THEN count(y.pseudo_user) / count(*) END AS r FROM (SELECT week, pseudo_user FROM c GROUP BY 1, 2) x
 LEFT JOIN (SELECT week, pseudo_user FROM c GROUP BY 1, 2) y ON y.pseudo_user = x.pseudo_user AND y.week = x.week + 7 JOIN (SELECT week, count(*) AS n FROM c GROUP BY 1) z ON z.week = x.week GROUP BY 1)) a,
 (SELECT {RATES} FROM c WHERE NOT has_empty_user_input) b"""),
    "ad_hoc_sql": _chat_sql("SELECT model_family AS model, count(*) FILTER (corr)::BIGINT AS corrections, count(*) FILTER (refused)::BIGINT AS refusals FROM (SELECT conv_id, " + "regexp_matches(content, '{c}') AS corr, regexp_matches(content, '{r}') AS refused FROM messages) JOIN c USING (conv_id) GROUP BY 1"),
    "published_tables": _chat_sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, 1::BIGINT AS files, true AS within_budget, count(*)::BIGINT AS cells FROM {n}" for n in _TABLES), *_METRIC_STEPS),
    "published_catalogue": _catalogue_sql(),
    "published_sql": _chat_sql(PUBLISHED_QUESTION, *_METRIC_STEPS),
    "responder_split": _chat_sql(f"""SELECT count(*)::BIGINT AS responders, count(*) FILTER (responder NOT IN (SELECT model_family FROM c))::BIGINT AS no_models, count(*) FILTER (responder NOT IN (SELECT model_family FROM c)) > 0 AS show_split
FROM (SELECT {FAMILY.format(x="attributed_to")} AS responder FROM turns JOIN c USING (conv_id) WHERE NOT has_empty_user_input AND role <> 'user' GROUP BY 1 HAVING count(*) >= {MIN_CELL})"""),
    "weekly_change": _chat_sql("SELECT week, n, percent, CASE WHEN percent > 0 THEN 'up' WHEN percent < 0 THEN 'down' WHEN percent = 0 THEN 'flat' END AS direction FROM (SELECT week, n, round(100 * (n::DOUBLE / lag(n) OVER (ORDER BY week) - 1), 1) AS percent FROM (SELECT week, count(*)::BIGINT AS n FROM c GROUP BY 1))"),
    "nested_json_access": "SELECT event_id, json_extract_string(props, '$') AS whole, len(json_keys(props))::BIGINT AS n_keys, (props->>'$.k')::BIGINT AS k, event_type, round(value)::BIGINT AS rounded, NULL::VARCHAR AS gone FROM events",
    "incremental_ingest": _chat_sql(f"SELECT week, {N}, sum(n_turns)::BIGINT AS turns FROM c GROUP BY week"),
    "live_friction_weekly": METRIC_SQL["friction_weekly"],
    "ingest_same_names": _chat_sql("""SELECT CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS folder, count(*)::BIGINT AS conversations, sum(n)::BIGINT AS turns, sum(k)::BIGINT AS corrections, 3::BIGINT AS files
FROM c JOIN (SELECT conv_id, count(*) AS n, count(*) FILTER (is_correction) AS k FROM turns GROUP BY 1) USING (conv_id) GROUP BY 1"""),
    "events_stream_weekly": "SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*)::BIGINT AS n, sum(value) AS total FROM events GROUP BY 1, 2",
}


def _fill_patterns() -> None:
    c, r = (R.portable_pattern(p).replace("'", "''") for p in (R.CORRECTION, R.REFUSAL))
    ORACLE_SQL["ad_hoc_sql"] = ORACLE_SQL["ad_hoc_sql"].replace("'{c}'", f"'{c}'").replace("'{r}'", f"'{r}'")


_fill_patterns()

"""Queries for flattening and the metric tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlytics.functions import rules as R
from turnlytics.operators import metrics as M
from turnlytics.operators import turns as T
from turnlytics.sources.files import shared_folder

from .fixtures import chat

MIN_CELL = chat.MIN_CELL


class Chat:
    """The chat tables of one query: built lazily, so a query plans only what it uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nested(self) -> DataFrame:
        """A row per conversation with its messages: what all other chat tables are made from, without an exchange."""
        return chat.written(self.spark, self.sf_dir, "messages", lambda: chat.nested(self.spark, self.sf_dir))

    @cached_property
    def messages(self) -> DataFrame:
        return chat.messages(self.nested)

    def attributed(self) -> DataFrame:
        """The turns, worked out from messages."""
        rows = self.messages
        for name, rule in chat.ATTRIBUTES:
            if name in ("usr", "d", "model"):
                rows = rows.withColumn(name, F.expr(chat.dialect(rule, True)))
        return T.attribute_turns(rows.drop("usr", "d"), F.col("model"))

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows that several branches of a query read, worked out once."""
        path = shared_folder(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @cached_property
    def turns(self) -> DataFrame:
        """The flat table of turns, written once like the messages: metrics read it as they would read ingested data."""
        return chat.written(self.spark, self.sf_dir, "turns", lambda: T.nested_turns(self.shards(self.nested)).select(*FLAT_TURNS))

    @cached_property
    def failures(self) -> DataFrame:
        """Each conversation's first failure and its opening text, found within the row: neither turns nor texts are exchanged."""
        return T.nested_failures(self.shards(self.nested))

    @cached_property
    def conversations(self) -> DataFrame:
        return chat.written(self.spark, self.sf_dir, "conversations", lambda: self.attributes(T.nested_roll_up(self.shards(self.nested)).select(*ROLLED_UP)))

    def rolled_up(self, turns: DataFrame) -> DataFrame:
        """The conversations, worked out from turns."""
        return self.attributes(T.roll_up(turns))

    def attributes(self, rows: DataFrame) -> DataFrame:
        rows = chat.with_attributes(rows, self.spark, self.sf_dir)
        return rows.withColumns({"week": R.monday(F.col("ts")), "model_family": R.model_family(F.col("model"))})

    @cached_property
    def intent(self) -> DataFrame:
        return self.conversations.select("conv_id", F.when(~F.col("has_empty_user_input"), F.col("label")).alias("intent"))

    @cached_property
    def labelled(self) -> DataFrame:
        """Conversations with their intent in one frame, without a join."""
        return self.conversations.withColumn("intent", F.when(~F.col("has_empty_user_input"), F.col("label")))

    @cached_property
    def eras(self) -> DataFrame:
        rows = " UNION ALL ".join(f"SELECT '{e}' AS era, DATE '{a}' AS era_start, DATE '{z}' AS era_end" for e, a, z in chat.ERAS)
        return self.spark.sql(rows)

    @cached_property
    def raw(self) -> DataFrame:
        """The same conversations as nested raw shard rows."""
        return chat.written(self.spark, self.sf_dir, "raw", lambda: self.shards(self.nested, own_responders=False))

    def shards(self, rows: DataFrame, own_responders: bool = True) -> DataFrame:
        """Nested raw shard rows; those of the given shape name no responder per message."""
        rows = chat.with_attributes(rows, self.spark, self.sf_dir)
        used = lambda x: F.col("prompt_tokens").isNotNull() & (x["role"] == "assistant") & (x["idx"] == 2)
        tokens = F.struct(F.col("prompt_tokens"), F.col("completion_tokens"), (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
        message = lambda x: F.struct(
            x["idx"].alias("idx"), x["content"].alias("content"), x["role"].alias("role"), F.col("conv_id").alias("turn_identifier"), F.col("language").alias("language"), F.col("redacted").alias("redacted"),
            F.when(used(x), tokens).alias("usage"), *([x["responder"].alias("responder")] if own_responders else []),
        )
        header = F.struct(F.col("language").alias("accept-language"), F.lit("browser").alias("user-agent"))
        turn = F.size(F.filter("messages", lambda x: x["role"] == "user")).cast("long")
        return rows.select("model", F.col("ts").alias("timestamp"), turn.alias("turn"), "language", "redacted", F.lit(None).cast("string").alias("state"), "country", F.col("usr").alias("hashed_ip"), header.alias("header"), F.transform("messages", message).alias("conversation"), "shard")


def chat_query(f):
    return lambda spark, sf_dir: f(Chat(spark, sf_dir))


CONVERSATION_COLUMNS = ["conv_id", "model", "ts", "date", "week", "country", "language", "n_turns", "pseudo_user", "redacted", "has_empty_user_input", "first_user_len", "last_assistant_len", "repeated_request", "correction_followup", "assistant_refusal", "one_and_done", "intent_text", "shard"]
NESTED_COLUMNS = [*CONVERSATION_COLUMNS, "state", "prompt_tokens", "completion_tokens"]
TURN_COLUMNS = ["conv_id", "idx", "role", "attributed_to", "content_len", "is_empty", "repeats_prev_user", "is_correction", "is_refusal"]
FLAT_TURNS = ["conv_id", "idx", "role", "content", "model", "prev_user", "last_reply", "attributed_to", "users_before", "content_len", "is_empty", "repeats_prev_user", "is_correction", "is_refusal"]
ROLLED_UP = ["conv_id", "n_turns", "has_empty_user_input", "first_user_len", "last_assistant_len", "repeated_request", "correction_followup", "assistant_refusal", "intent_text", "one_and_done"]

QUERIES = {
    "flatten_conversations": chat_query(lambda x: T.nested_roll_up(x.raw).select(*NESTED_COLUMNS)),
    "flatten_turns": chat_query(lambda x: T.nested_turns(x.raw).select(*TURN_COLUMNS)),
    "turn_attribution": chat_query(lambda x: x.attributed().select("conv_id", "idx", "role", "attributed_to", "prev_user", "repeats_prev_user", "is_correction", "is_refusal")),
    "conversation_roll_up": chat_query(lambda x: x.rolled_up(x.attributed()).select(*CONVERSATION_COLUMNS)),
    "responder_charges": chat_query(lambda x: T.responder_charges(x.turns)),
    "volume_daily_model": chat_query(lambda x: M.volume_daily_model(x.conversations)),
    "volume_weekly_country": chat_query(lambda x: M.volume_weekly_country(x.conversations, MIN_CELL)),
    "volume_weekly_language": chat_query(lambda x: M.volume_weekly_language(x.conversations, MIN_CELL)),
    "intensity_weekly": chat_query(lambda x: M.intensity_weekly(x.conversations)),
    "intensity_weekly_model": chat_query(lambda x: M.intensity_weekly_model(x.conversations, MIN_CELL)),
    "persistence_quarterly": chat_query(lambda x: M.persistence_quarterly(x.conversations)),
    "depth_by_model": chat_query(lambda x: M.depth_by_model(x.conversations)),
    "intent_weekly": chat_query(lambda x: M.intent_weekly(x.conversations, x.intent)),
    "intent_weekly_model": chat_query(lambda x: M.intent_weekly_model(x.conversations, x.intent, MIN_CELL)),
    "intent_by_model": chat_query(lambda x: M.intent_by_model(x.conversations, x.intent)),
    "intent_by_language": chat_query(lambda x: M.intent_by_language(x.conversations, x.intent, MIN_CELL)),
    "friction_weekly": chat_query(lambda x: M.friction_weekly(x.conversations)),
    "friction_weekly_model": chat_query(lambda x: M.friction_weekly_model(x.conversations, MIN_CELL)),
    "friction_by_intent_model": chat_query(lambda x: M.friction_by_intent_model(x.conversations, x.intent, MIN_CELL)),
    "friction_by_intent_model_era": chat_query(lambda x: M.friction_by_intent_model_era(x.conversations, x.intent, x.eras, MIN_CELL)),
    "friction_by_responder": chat_query(lambda x: M.friction_by_responder(x.turns, x.conversations, MIN_CELL)),
    "friction_all_and_models": chat_query(lambda x: M.friction_all_and_models(x.conversations, MIN_CELL)),
    "data_quality_weekly": chat_query(lambda x: M.data_quality_weekly(x.conversations)),
    "data_quality_weekly_model": chat_query(lambda x: M.data_quality_weekly_model(x.conversations, MIN_CELL)),
}


def sql_prefix(*steps: str) -> str:
    """CTEs of the chat tables, and further ones."""
    return "WITH RECURSIVE " + ",\n".join([chat.sql_messages(), chat.sql_attributes(), TURNS_SQL, CONV_SQL, *steps])


_correction, _refusal = (R.portable_pattern(p).replace("'", "''") for p in (R.CORRECTION, R.REFUSAL))
_words = lambda x: rf"list_distinct(list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w)))"
FAMILY = r"regexp_replace({x}, '(-(\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}|preview))+$', '')"
SIMILARITY = "CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) ELSE 0 END"

TURNS_SQL = f"""seen_turns AS (
 SELECT m.*, a.model, CASE WHEN role <> 'user' THEN coalesce(nullif(responder, ''), model) END AS own FROM messages m JOIN attributes a USING (conv_id)
), linked_turns AS (
 SELECT *, CASE WHEN role <> 'user' THEN own ELSE last_value(own IGNORE NULLS) OVER b END AS attributed_to,
  last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER b AS prev_user, last_value(CASE WHEN role <> 'user' THEN content END IGNORE NULLS) OVER b AS last_reply
 FROM seen_turns WINDOW b AS (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), worded_turns AS (SELECT *, {_words("prev_user")} AS ta, {_words("content")} AS tb FROM linked_turns),
turns AS MATERIALIZED (
 SELECT conv_id, idx, role, content, attributed_to, prev_user, last_reply, length(content)::INTEGER AS content_len, regexp_full_match(content, '\\s*') AS is_empty,
  CASE WHEN prev_user IS NOT NULL THEN {SIMILARITY} END AS similarity,
  role = 'user' AND prev_user IS NOT NULL AND {SIMILARITY} >= 0.6 AS repeats_prev_user,
  role = 'user' AND regexp_matches(content, '{_correction}') AS is_correction, role <> 'user' AND regexp_matches(content, '{_refusal}') AS is_refusal
 FROM worded_turns)"""

CONV_SQL = f"""rolled AS (
 SELECT conv_id, (count(*) FILTER (role = 'user'))::INTEGER AS n_turns, coalesce(bool_or(is_empty) FILTER (role = 'user'), false) AS has_empty_user_input,
  coalesce(arg_min(content_len, idx) FILTER (role = 'user'), 0) AS first_user_len, coalesce(arg_max(content_len, idx) FILTER (role <> 'user'), 0) AS last_assistant_len,
  bool_or(repeats_prev_user) AS repeated_request, bool_or(is_correction) AS correction_followup, bool_or(is_refusal) AS assistant_refusal,
  substr(array_to_string((list(content ORDER BY idx) FILTER (role = 'user'))[1:2], chr(10)), 1, 2000) AS intent_text
 FROM turns GROUP BY conv_id
), c AS MATERIALIZED (
 SELECT r.*, n_turns = 1 AND last_assistant_len < 200 AS one_and_done, a.* EXCLUDE (conv_id), date_trunc('week', ts)::DATE AS week, {FAMILY.format(x="model")} AS model_family,
  CASE WHEN NOT has_empty_user_input THEN label END AS intent
 FROM rolled r JOIN attributes a USING (conv_id))"""

RATES = ", ".join(f"count_if({flag}) / count(*) AS {name}" for name, flag in M.PROXIES.items())
QUALITY = ", ".join(f"round(count_if({flag}) / count(*), 6) AS {name}" for name, flag in (("redacted_rate", "redacted"), ("empty_input_rate", "has_empty_user_input"), ("token_usage_coverage", "prompt_tokens IS NOT NULL")))
N = "count(*)::BIGINT AS conversations"
ERAS_SQL = "eras(era, era_start, era_end) AS (VALUES " + ", ".join(f"('{e}', DATE '{a}', DATE '{z}')" for e, a, z in chat.ERAS) + ")"


def residual_sql(key: str, users: bool) -> str:
    u, outer = (", count(DISTINCT pseudo_user) AS u", f", max(CASE WHEN {key} IS NOT NULL AND n >= {MIN_CELL} THEN u END)::BIGINT AS pseudo_users") if users else ("", "")
    return f"""SELECT week, CASE WHEN {key} IS NULL THEN 'not recorded' WHEN n < {MIN_CELL} THEN 'small cells' ELSE {key} END AS {key}, sum(n)::BIGINT AS conversations{outer}
FROM (SELECT week, {key} AS {key}, count(*) AS n{u} FROM c GROUP BY 1, 2) GROUP BY 1, 2"""


def intensity_sql(table: str, keys: str, period: str = "week", days: int = 7) -> tuple[str, str]:
    """The steps and the final SELECT of the intensity metrics: lists of users' counts per cell, and each user's next period."""
    cell = f"{period}{keys}"
    others = [k.strip() for k in keys.split(",") if k.strip()]
    part = f"PARTITION BY {', '.join(others)}" if others else ""
    steps = f"""activity AS (SELECT {cell}, pseudo_user, count(*) AS convs FROM {table} GROUP BY ALL),
followed AS (SELECT *, lead({period}) OVER (PARTITION BY {", ".join([*others, "pseudo_user"])} ORDER BY {period}) AS then_active FROM activity),
lists AS (SELECT {cell}, list_reverse_sort(list(convs)) AS v, count_if(coalesce(then_active = {period} + {days}, false)) AS came_back FROM followed GROUP BY ALL),
placed AS (SELECT *, lead({period}) OVER ({part} ORDER BY {period}) IS NOT DISTINCT FROM {period} + {days} AS next_week_present FROM lists)"""
    final = f"""SELECT {cell}, len(v)::BIGINT AS pseudo_users, list_sum(v)::BIGINT AS conversations, list_aggregate(v, 'quantile_cont', 0.5) AS convs_per_user_p50, list_aggregate(v, 'quantile_cont', 0.9) AS convs_per_user_p90,
 list_sum(v[1:greatest(1, ceil(len(v) / 10))::INTEGER]) / list_sum(v) AS top10_share, next_week_present, CASE WHEN next_week_present THEN came_back / len(v) END AS return_rate FROM placed"""
    return steps, final


def persistence_sql(table: str) -> str:
    quarter = "make_date(year(week), 3 * quarter(week) - 2, 1)"
    return f"SELECT q AS quarter, count(*)::BIGINT AS pseudo_users, sum(n) / count(*) AS avg_weeks_active, count_if(n > 1) / count(*) AS share_multi_week FROM (SELECT {quarter} AS q, len(list_distinct(list(week))) AS n FROM {table} GROUP BY {quarter}, pseudo_user) GROUP BY q"


def _chat_sql(final: str, *steps: str) -> str:
    return f"{sql_prefix(*steps)}\n{final}"


_i, _if = intensity_sql("c", "")
_m, _mf = intensity_sql("(SELECT *, model_family AS mf FROM c)", ", mf")
_MODEL = "model_family AS model"
_HAVING = f"GROUP BY ALL HAVING count(*) >= {MIN_CELL}"

ORACLE_SQL = {
    "flatten_conversations": _chat_sql(
        "SELECT " + ", ".join(CONVERSATION_COLUMNS) + """, NULL::VARCHAR AS state, CASE WHEN told THEN prompt_tokens END AS prompt_tokens, CASE WHEN told THEN completion_tokens END AS completion_tokens
FROM c JOIN (SELECT conv_id, bool_or(idx = 2 AND role = 'assistant') AS told FROM messages GROUP BY 1) USING (conv_id)"""
    ),
    "flatten_turns": _chat_sql("SELECT conv_id, idx::INTEGER AS idx, role, model AS attributed_to, content_len, is_empty, repeats_prev_user, is_correction, is_refusal FROM turns JOIN attributes USING (conv_id) WHERE role <> 'user' UNION ALL "
        "SELECT conv_id, idx::INTEGER, role, CASE WHEN attributed_to IS NOT NULL THEN model END, content_len, is_empty, repeats_prev_user, is_correction, is_refusal FROM turns JOIN attributes USING (conv_id) WHERE role = 'user'"),
    "turn_attribution": _chat_sql("SELECT conv_id, idx::INTEGER AS idx, role, attributed_to, prev_user, repeats_prev_user, is_correction, is_refusal FROM turns"),
    "conversation_roll_up": _chat_sql("SELECT " + ", ".join(CONVERSATION_COLUMNS) + " FROM c"),
    "responder_charges": _chat_sql("SELECT conv_id, idx::INTEGER AS idx, attributed_to AS responder, role <> 'user' AS reply, repeats_prev_user, is_correction FROM turns WHERE attributed_to IS NOT NULL"),
    "volume_daily_model": _chat_sql(f"SELECT date, {_MODEL}, {N}, sum(n_turns)::BIGINT AS turns, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, count(prompt_tokens)::BIGINT AS conversations_with_tokens FROM c GROUP BY ALL"),
    "volume_weekly_country": _chat_sql(residual_sql("country", True)),
    "volume_weekly_language": _chat_sql(residual_sql("language", False)),
    "intensity_weekly": _chat_sql(_if, _i),
    "intensity_weekly_model": _chat_sql(f"SELECT * EXCLUDE (mf), mf AS model FROM ({_mf}) WHERE pseudo_users >= {MIN_CELL}", _m),
    "persistence_quarterly": _chat_sql(persistence_sql("c")),
    "depth_by_model": _chat_sql(f"SELECT {_MODEL}, CASE WHEN n_turns <= 2 THEN n_turns::VARCHAR WHEN n_turns <= 5 THEN '3-5' WHEN n_turns <= 10 THEN '6-10' ELSE '11+' END AS depth_bucket, {N}, median(n_turns) AS median_turns FROM c GROUP BY 1, 2"),
    "intent_weekly": _chat_sql(f"SELECT week, intent, {N} FROM c WHERE intent IS NOT NULL GROUP BY ALL"),
    "intent_weekly_model": _chat_sql(f"SELECT week, {_MODEL}, intent, {N} FROM c WHERE intent IS NOT NULL {_HAVING}"),
    "intent_by_model": _chat_sql(f"SELECT {_MODEL}, intent, {N} FROM c WHERE intent IS NOT NULL GROUP BY ALL"),
    "intent_by_language": _chat_sql(f"SELECT language, intent, {N} FROM c WHERE intent IS NOT NULL AND language IN (SELECT language FROM (SELECT language, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, language NULLS LAST LIMIT 10)) {_HAVING}"),
    "friction_weekly": _chat_sql(f"SELECT week, {N}, {RATES} FROM c WHERE NOT has_empty_user_input GROUP BY week"),
    "friction_weekly_model": _chat_sql(f"SELECT week, {_MODEL}, {N}, {RATES} FROM c WHERE NOT has_empty_user_input {_HAVING}"),
    "friction_by_intent_model": _chat_sql(f"SELECT intent, {_MODEL}, {N}, {RATES} FROM c WHERE intent IS NOT NULL {_HAVING}"),
    "friction_by_intent_model_era": _chat_sql(f"SELECT era, era_start, era_end, intent, {_MODEL}, {N}, {RATES} FROM c JOIN eras ON date >= era_start AND date <= era_end WHERE intent IS NOT NULL {_HAVING}", ERAS_SQL),
    "friction_by_responder": _chat_sql(f"""SELECT responder, n AS assistant_turns, corrections, repeats, corrections / n AS correction_rate, repeats / n AS repeat_rate FROM (
 SELECT {FAMILY.format(x="attributed_to")} AS responder, count_if(role <> 'user')::BIGINT AS n, count_if(is_correction)::BIGINT AS corrections, count_if(repeats_prev_user)::BIGINT AS repeats
 FROM turns WHERE attributed_to IS NOT NULL AND conv_id IN (SELECT conv_id FROM c WHERE NOT has_empty_user_input) GROUP BY 1) WHERE n >= {MIN_CELL}"""),
    "friction_all_and_models": _chat_sql(f"SELECT week, NULL::VARCHAR AS model, {N}, {RATES} FROM c WHERE NOT has_empty_user_input GROUP BY week UNION ALL SELECT week, {_MODEL}, {N}, {RATES} FROM c WHERE NOT has_empty_user_input {_HAVING}"),
    "data_quality_weekly": _chat_sql(f"SELECT week, {N}, {QUALITY} FROM c GROUP BY week"),
    "data_quality_weekly_model": _chat_sql(f"SELECT week, {_MODEL}, {N}, {QUALITY} FROM c {_HAVING}"),
}

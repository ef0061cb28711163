"""Queries for weekly series, on the chat tables, ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlytics.functions import rules as R
from turnlytics.operators import activity as A
from turnlytics.operators import metrics as M
from turnlytics.operators import series as S

from .core import FAMILY, MIN_CELL, N, Chat, _chat_sql, chat_query, intensity_sql, persistence_sql
from .core import ORACLE_SQL as METRIC_SQL

RECENT = 6  # the fixture has 18 active weeks
BREAK = "2024-05-06"


def events(x: Chat) -> DataFrame:
    rows = x.table("events")
    day = F.to_date("ts")
    return rows.select("ts", day.alias("date"), R.monday(F.col("ts")).alias("week"), F.col("user_id").cast("string").alias("pseudo_user"), F.col("event_type").alias("model_family"))


def orders(x: Chat) -> DataFrame:
    customers = x.table("customer").join(F.broadcast(x.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")  # 25 nations
    rows = x.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    return rows.select(day.alias("date"), R.monday(day).alias("week"), F.col("o_custkey").cast("string").alias("pseudo_user"), F.col("n_name").alias("country"), F.col("o_orderstatus").alias("model_family"), F.col("o_totalprice").alias("value"))


def model_weeks(x: Chat) -> DataFrame:
    return x.conversations.groupBy(F.col("model_family").alias("model"), "week").agg(M.count_rows().alias("conversations"))


def intent_weeks(x: Chat) -> DataFrame:
    return M.intent_weekly(x.conversations, x.intent)


def weeks(x: Chat) -> DataFrame:
    return S.spine(S.span(x.conversations))


def first_to_last(x: Chat) -> DataFrame:
    return S.spine(x.conversations.agg(F.min("week").alias("a"), F.max("week").alias("z")), "a", "z")


def usual_weeks(x: Chat) -> DataFrame:
    """Weekly rates per model, only weeks with at least the model's usual number of conversations; so every model has gaps."""
    rates = M.friction_weekly_model(x.conversations, 1)
    usual = F.avg("conversations").over(Window.partitionBy("model"))  # a row per week
    return rates.withColumn("usual", usual).where("conversations >= usual").drop("usual")


def activity_bits(x: Chat) -> DataFrame:
    """Week bitmaps of users, shard by shard as they would come in; the last batch holds a shard again."""
    parts = [x.written(A.week_bits(x.conversations.where(F.col("shard").isin(*names))), "bits") for names in (["shard-0"], ["shard-1", "shard-2"], ["shard-3", "shard-0"])]
    return A.merged(A.merged(parts[0], parts[1]), parts[2])


QUERIES = {
    "activity_weekly": chat_query(lambda x: A.weekly_return(activity_bits(x))),
    "activity_persistence": chat_query(lambda x: A.persistence(activity_bits(x))),
    "activity_spans": chat_query(lambda x: A.spans(activity_bits(x)).withColumnRenamed("user", "pseudo_user")),
    "complete_weeks": chat_query(lambda x: S.span(x.conversations)),
    "events_complete_weeks": chat_query(lambda x: S.span(events(x))),
    "orders_complete_weeks": chat_query(lambda x: S.span(orders(x))),
    "zero_filled_volume": chat_query(lambda x: S.zero_filled(model_weeks(x), weeks(x), "model", "conversations")),
    "rate_gaps": chat_query(lambda x: S.rate_gaps(usual_weeks(x), first_to_last(x), "model", "correction_rate")),
    "outage_weeks": chat_query(lambda x: S.outage_weeks(x.conversations, first_to_last(x))),
    "model_windows": chat_query(lambda x: S.windows_of(model_weeks(x), "model")),
    "handoff_events": chat_query(lambda x: S.handoffs(S.windows_of(model_weeks(x), "model"), "model")),
    "recent_vs_prior": chat_query(lambda x: S.recent_vs_prior(model_weeks(x), "model", RECENT)),
    "intent_shift": chat_query(lambda x: S.recent_vs_prior(intent_weeks(x), "intent", RECENT)),
    "pre_post_break_median": chat_query(lambda x: S.break_medians(M.intensity_weekly(x.conversations), F.lit(BREAK).cast("date"), "return_rate")),
    "median_weekly_return": chat_query(lambda x: S.median_return(M.intensity_weekly(x.conversations))),
    "usage_concentration": chat_query(lambda x: S.usage_concentration(x.conversations)),
    "personal_usage": chat_query(lambda x: S.personal_usage(x.conversations)),
    "overview_tiles": chat_query(lambda x: S.overview(x.conversations, RECENT)),
    "recent_model_share": chat_query(lambda x: S.recent_model_share(x.conversations, RECENT)),
    "multi_model_weeks": chat_query(lambda x: S.multi_model_weeks(x.conversations)),
    "complete_week_intensity": chat_query(lambda x: S.complete(M.intensity_weekly(x.conversations), S.span(x.conversations))),
    "country_shares": chat_query(lambda x: S.shares(x.conversations.where("country IS NOT NULL"), ["country"]).orderBy(F.desc("n"), "country").limit(15)),
    "events_intensity_weekly": chat_query(lambda x: M.intensity(events(x))),
    "events_intensity_weekly_type": chat_query(lambda x: M.intensity_weekly_model(events(x), MIN_CELL)),
    "events_persistence": chat_query(lambda x: M.persistence_quarterly(events(x))),
    "events_usage_concentration": chat_query(lambda x: S.usage_concentration(events(x))),
    "orders_intensity_weekly": chat_query(lambda x: M.intensity(orders(x))),
    "orders_volume_country": chat_query(lambda x: M.volume_weekly_country(orders(x), 3)),
    "orders_persistence": chat_query(lambda x: M.persistence_quarterly(orders(x))),
    "orders_recent_vs_prior": chat_query(lambda x: S.recent_vs_prior(orders(x).groupBy("country", "week").agg(M.count_rows().alias("conversations")), "country", 12)),
    "orders_zero_filled": chat_query(lambda x: S.zero_filled(orders(x).groupBy("country", "week").agg(M.count_rows().alias("n")), S.spine(S.span(orders(x))), "country", "n")),
}

_EVENTS = "e AS (SELECT ts, ts::DATE AS date, date_trunc('week', ts)::DATE AS week, user_id::VARCHAR AS pseudo_user, event_type AS model_family FROM events)"
_ORDERS = "o AS (SELECT o_orderdate::DATE AS date, date_trunc('week', o_orderdate)::DATE AS week, o_custkey::VARCHAR AS pseudo_user, n_name AS country, o_orderstatus AS model_family FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_WHOLE = "(date_trunc('week', {a} + 6)::DATE)"


def span_sql(table: str) -> str:
    first, last = "date_trunc('week', first_day + 6)::DATE", "date_trunc('week', last_day - 6)::DATE"
    return f"SELECT first_day, last_day, CASE WHEN {first} <= {last} THEN {first} END AS first_week, CASE WHEN {first} <= {last} THEN {last} END AS last_week FROM (SELECT min(date)::DATE AS first_day, max(date)::DATE AS last_day FROM {table})"


_SPAN = f"bounds AS ({span_sql('c')})"
_SPINE = "spine AS (SELECT unnest(generate_series(first_week, last_week, INTERVAL 7 DAY))::DATE AS week FROM bounds)"
_ALL_WEEKS = "every AS (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY))::DATE AS week FROM c)"
_MW = "mw AS (SELECT model_family AS model, week, count(*)::BIGINT AS conversations FROM c GROUP BY 1, 2)"
_WINDOWS = "w AS (SELECT model, min(week) AS first_week, max(week) AS last_week, count(*)::BIGINT AS active_weeks FROM mw GROUP BY model)"


def recent_sql(table: str, key: str, n: int) -> str:
    return f"""SELECT *, (row_number() OVER (ORDER BY change DESC, {key}))::INTEGER AS rank FROM (
 SELECT {key}, recent, prior, recent / nullif(sum(recent) OVER (), 0) AS recent_share, prior / nullif(sum(prior) OVER (), 0) AS prior_share, recent / nullif(sum(recent) OVER (), 0) - prior / nullif(sum(prior) OVER (), 0) AS change FROM (
 SELECT {key}, coalesce(sum(n) FILTER (k <= {n}), 0)::BIGINT AS recent, coalesce(sum(n) FILTER (k > {n}), 0)::BIGINT AS prior
 FROM (SELECT {key}, week, count(*) AS n FROM {table} GROUP BY 1, 2) t JOIN (SELECT week, row_number() OVER (ORDER BY week DESC) AS k FROM (SELECT DISTINCT week FROM {table})) USING (week) WHERE k <= {2 * n} GROUP BY 1))"""


def concentration_sql(table: str) -> str:
    return f"""SELECT max(users)::BIGINT AS users, sum(convs) FILTER (rk <= greatest(1, ceil(users * 0.1)))::DOUBLE / sum(convs) AS top10_share, (max(convs) FILTER (rk = users // 2 + 1))::BIGINT AS median_conversations
FROM (SELECT convs, row_number() OVER (ORDER BY convs DESC) AS rk, count(*) OVER () AS users FROM (SELECT pseudo_user, count(*) AS convs FROM {table} GROUP BY 1))"""


_i, _if = intensity_sql("c", "")
_e, _ef = intensity_sql("e", "")
_et, _etf = intensity_sql("(SELECT *, model_family AS mf FROM e)", ", mf")
_o, _of = intensity_sql("o", "")
_FRICTION = "f AS (SELECT model, week, correction_rate FROM (SELECT model_family AS model, week, count(*) AS n, avg(count(*)) OVER (PARTITION BY model_family) AS usual, avg(correction_followup::INT) AS correction_rate FROM c WHERE NOT has_empty_user_input GROUP BY 1, 2) WHERE n >= usual)"

ORACLE_SQL = {
    "activity_weekly": f"SELECT week, pseudo_users, next_week_present, return_rate FROM (\n{METRIC_SQL['intensity_weekly']}\n)",
    "activity_persistence": METRIC_SQL["persistence_quarterly"],
    "activity_spans": _chat_sql("SELECT pseudo_user, min(week) AS first_week, max(week) AS last_week, count(DISTINCT week)::BIGINT AS weeks FROM c GROUP BY pseudo_user"),
    "median_weekly_return": _chat_sql(f"SELECT count(*)::BIGINT AS weeks, list_sort(list(return_rate))[count(*) // 2 + 1] AS median_return FROM ({_if}) WHERE return_rate IS NOT NULL", _i),
    "complete_weeks": _chat_sql(span_sql("c")),
    "events_complete_weeks": f"WITH {_EVENTS} {span_sql('e')}",
    "orders_complete_weeks": f"WITH {_ORDERS} {span_sql('o')}",
    "zero_filled_volume": _chat_sql("SELECT model, week, coalesce(conversations, 0)::BIGINT AS conversations FROM (SELECT DISTINCT model FROM mw) CROSS JOIN spine LEFT JOIN mw USING (model, week)", _SPAN, _SPINE, _MW),
    "rate_gaps": _chat_sql("""SELECT model, week, (SELECT correction_rate FROM f WHERE f.model = g.model AND f.week < g.week ORDER BY f.week DESC LIMIT 1) AS before, (SELECT correction_rate FROM f WHERE f.model = g.model AND f.week > g.week ORDER BY f.week LIMIT 1) AS after,
 (SELECT count(*) FROM f WHERE f.model = g.model AND f.week < g.week)::BIGINT AS island
FROM (SELECT model, every.week FROM (SELECT model, min(week) AS a, max(week) AS z FROM f GROUP BY 1) r JOIN every ON every.week BETWEEN a AND z) g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.model = g.model AND f.week = g.week)""", _FRICTION, _ALL_WEEKS),
    "outage_weeks": _chat_sql("SELECT week FROM every WHERE week NOT IN (SELECT week FROM c)", _ALL_WEEKS),
    "model_windows": _chat_sql("SELECT * FROM w", _MW, _WINDOWS),
    "handoff_events": _chat_sql("""SELECT week, coalesce(string_agg(model, ',' ORDER BY model) FILTER (e = 0), '') AS begin, coalesce(string_agg(model, ',' ORDER BY model) FILTER (e = 1), '') AS stop
FROM (SELECT model, first_week AS week, 0 AS e FROM w UNION ALL SELECT model, last_week, 1 FROM w) GROUP BY week""", _MW, _WINDOWS),
    "recent_vs_prior": _chat_sql(recent_sql("(SELECT model_family AS model, week FROM c)", "model", RECENT)),
    "intent_shift": _chat_sql(recent_sql("(SELECT intent, week FROM c WHERE intent IS NOT NULL)", "intent", RECENT)),
    "pre_post_break_median": _chat_sql(f"SELECT side, len(v)::BIGINT AS weeks, v[len(v) // 2 + 1] AS median FROM (SELECT CASE WHEN week < DATE '{BREAK}' THEN 'pre' ELSE 'post' END AS side, list_sort(list(return_rate)) AS v FROM ({_if}) WHERE return_rate IS NOT NULL GROUP BY 1)", _i),
    "usage_concentration": _chat_sql(concentration_sql("c")),
    "personal_usage": _chat_sql("""SELECT pseudo_user, count(*)::BIGINT AS active_weeks, ((max(week) - min(week)) // 7 + 1)::BIGINT AS span_weeks, sum(n)::BIGINT AS conversations, arg_max(week, n * 1000000 - (week - DATE '1970-01-01')) AS busiest_week, max(n)::BIGINT AS busiest_n
FROM (SELECT pseudo_user, week, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1"""),
    "overview_tiles": _chat_sql(f"""SELECT sum(conversations)::BIGINT AS conversations, min(week) FILTER (pseudo_users = top) AS peak_week, max(top)::BIGINT AS peak_users, arg_max(pseudo_users, week) / max(top) - 1 AS change_from_peak,
 max(week) FILTER (return_rate IS NOT NULL) AS return_week, arg_max(return_rate, week) FILTER (return_rate IS NOT NULL) AS return_rate, (sum(conversations) FILTER (k <= {RECENT}))::BIGINT AS recent_conversations
FROM (SELECT *, max(pseudo_users) OVER () AS top, row_number() OVER (ORDER BY week DESC) AS k FROM ({_if}))""", _i),
    "recent_model_share": _chat_sql(f"SELECT model_family AS model, {N}, count(*) / sum(count(*)) OVER () AS share FROM c WHERE week IN (SELECT DISTINCT week FROM c ORDER BY week DESC LIMIT {RECENT}) GROUP BY 1"),
    "multi_model_weeks": _chat_sql("SELECT week, count(*)::BIGINT AS models, max(share) AS top_share, count(*) FILTER (share >= 0.1)::BIGINT AS sizeable FROM (SELECT week, count(*) / sum(count(*)) OVER (PARTITION BY week) AS share FROM c GROUP BY week, model_family) GROUP BY week"),
    "complete_week_intensity": _chat_sql(f"SELECT i.* FROM ({_if}) i, bounds WHERE week BETWEEN first_week AND last_week", _i, _SPAN),
    "country_shares": _chat_sql("SELECT country, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER () AS share FROM c WHERE country IS NOT NULL GROUP BY 1 ORDER BY n DESC, country LIMIT 15"),
    "events_intensity_weekly": f"WITH {_EVENTS}, {_e} {_ef}",
    "events_intensity_weekly_type": f"WITH {_EVENTS}, {_et} SELECT * EXCLUDE (mf), mf AS model FROM ({_etf}) WHERE pseudo_users >= {MIN_CELL}",
    "events_persistence": f"WITH {_EVENTS} {persistence_sql('e')}",
    "events_usage_concentration": f"WITH {_EVENTS} {concentration_sql('e')}",
    "orders_intensity_weekly": f"WITH {_ORDERS}, {_o} {_of}",
    "orders_volume_country": f"""WITH {_ORDERS} SELECT week, CASE WHEN n < 3 THEN 'small cells' ELSE country END AS country, sum(n)::BIGINT AS conversations, max(CASE WHEN n >= 3 THEN u END)::BIGINT AS pseudo_users
FROM (SELECT week, country AS country, count(*) AS n, count(DISTINCT pseudo_user) AS u FROM o GROUP BY 1, 2) GROUP BY 1, 2""",
    "orders_persistence": f"WITH {_ORDERS} {persistence_sql('o')}",
    "orders_recent_vs_prior": f"WITH {_ORDERS} {recent_sql('o', 'country', 12)}",
    "orders_zero_filled": f"WITH {_ORDERS}, bounds AS ({span_sql('o')}), {_SPINE}, k AS (SELECT country, week, count(*)::BIGINT AS n FROM o GROUP BY 1, 2) SELECT country, week, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT country FROM o) CROSS JOIN spine LEFT JOIN k USING (country, week)",
}

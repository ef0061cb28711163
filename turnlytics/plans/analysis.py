"""Queries for failures, decisions and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlytics.functions import reasons
from turnlytics.operators import compare as K
from turnlytics.operators import decide as D
from turnlytics.operators import metrics as M
from turnlytics.operators import series as S
from turnlytics.operators import turns as T

from .core import ERAS_SQL, FAMILY, MIN_CELL, N, RATES, Chat, _chat_sql, _HAVING, chat_query
from .fixtures import chat

REPS = 4000
EXACT_REPS = 400  # drawing value by value is for a few values
PERSONAL_REPLIES = 30
ROUTE_MIN = 60  # cells of the fixture are smaller than those of a real corpus

# Fixture comparisons: intent, side a, side b, as model families.
PAIRS = [("coding", "gpt-4o-mini", "gpt-4o"), ("questions", "gpt-4o-mini", "gpt-4o"), ("coding", "o1-mini", "gpt-4o"), ("questions", "o1-mini", "gpt-4o")]
# Fixture evaluation results: intent, score; translation has none.
SCORES = [("coding", 0.8), ("coding", 0.6), ("questions", 0.9), ("writing_and_business", 0.5), ("creative_roleplay", 0.7), ("image_prompting", 0.4), ("questions", None), ("poetry", 1.0)]


def cases(x: Chat) -> DataFrame:
    """First failures with reason and intent ("unlabelled" where there is none)."""
    rows = D.with_reason(x.failures)
    return rows.join(x.intent, "conv_id", "left").withColumn("intent", F.coalesce("intent", F.lit("unlabelled")))


def era_b(x: Chat) -> DataFrame:
    _, start, end = next(e for e in _eras() if e[0] == "B")
    rows = x.labelled.where(f"NOT has_empty_user_input AND date BETWEEN DATE '{start}' AND DATE '{end}'")
    return rows.select("pseudo_user", "intent", F.col("model_family").alias("model"), "one_and_done", (F.col("repeated_request") | F.col("correction_followup")).alias("friction"), (F.col("n_turns") > 1).alias("multi_turn"))


def _eras():
    return chat.ERAS


def eras_to_now(x: Chat) -> DataFrame:
    """The eras, and a last one from the day after them to the last complete week.  A handful of rows."""
    start = max(e[2] for e in _eras())
    last = S.span(x.conversations).select(F.lit("C").alias("era"), F.date_add(F.lit(start).cast("date"), 1).alias("era_start"), F.col("last_week").alias("era_end"))
    return x.eras.unionByName(last)


KEYS = ["intent", "side_a", "side_b"]


def pair_sides(x: Chat) -> DataFrame:
    pairs = x.spark.createDataFrame(PAIRS, "intent string, side_a string, side_b string")
    return K.sides(era_b(x), pairs, KEYS)


def pair_comparison(x: Chat) -> DataFrame:
    """All pairs and metrics in one job."""
    tagged = pair_sides(x)
    metric = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("hit")) for m in ("one_and_done", "friction"))))
    tagged = tagged.select(*KEYS, "pseudo_user", "side", "multi_turn", metric.alias("m")).select(*KEYS, "pseudo_user", "side", "multi_turn", "m.metric", "m.hit")
    tagged = x.written(tagged, "tagged")  # read by four branches
    keys = [*KEYS, "metric"]
    naive = K.naive_gap(tagged, keys, F.col("hit"))
    users = K.per_user(tagged, keys, "pseudo_user", F.col("hit"))
    share = lambda s: F.avg(F.when(F.col("side") == s, F.col("multi_turn").cast("int")))
    measurable = tagged.groupBy(*keys).agg((F.least(share("a"), share("b")) >= 0.05).alias("measurable"))
    rows = naive.join(K.matched_gap(users, keys), keys, "left").join(K.bootstrap(users, keys, "diff", REPS), keys, "left").join(measurable, keys)
    return K.pair_verdict(K.model_verdict(rows))


def change(x: Chat, at: str = "2024-06-17") -> DataFrame:
    """Corrections before and after the release, for the same people, with a placebo at the midpoint of the time before."""
    rows = x.labelled.where("NOT has_empty_user_input").select("pseudo_user", "ts", F.col("correction_followup").alias("hit"))
    rows = x.written(rows, "points")  # read by the change, its placebo and their intervals
    moment = F.lit(at).cast("timestamp_ntz")
    tagged = rows.withColumns({"run": F.lit("change"), "side": F.when(F.col("ts") >= moment, "a").otherwise("b")})
    before = rows.where(F.col("ts") < moment)
    middle = before.agg(F.timestamp_seconds((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(moment.cast("timestamp"))) / 2e6).cast("timestamp_ntz").alias("middle"))
    placebo = before.crossJoin(F.broadcast(middle)).select("pseudo_user", "ts", "hit", F.lit("placebo").alias("run"), F.when(F.col("ts") >= F.col("middle"), "a").otherwise("b").alias("side"))  # one row
    every = tagged.unionByName(placebo)
    users = K.per_user(every, ["run"], "pseudo_user", F.col("hit"))
    out = K.naive_gap(every, ["run"], F.col("hit")).join(K.matched_gap(users, ["run"]), "run").join(K.bootstrap(users, ["run"], "diff", REPS), "run")
    p = out.where("run = 'placebo'").select(F.col("matched_gap").alias("placebo_gap"), F.col("ci_low").alias("placebo_low"), F.col("ci_high").alias("placebo_high"))
    return K.change_verdict(out.where("run = 'change'").drop("run").join(F.broadcast(p), F.lit(True), "left"))


def unpaired_change(x: Chat, at: str = "2024-06-17") -> DataFrame:
    """One history: conversations before and after, each side resampled on its own, and the difference of the two."""
    rows = x.labelled.where("NOT has_empty_user_input")
    tagged = rows.select(F.col("correction_followup").cast("int").alias("v"), F.when(F.col("ts") >= F.lit(at).cast("timestamp_ntz"), "a").otherwise("b").alias("side"), F.lit(1).alias("one"))
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("m")))
    means = K.resampled_means(tagged, ["side"], "v", REPS).groupBy("rep").agg(of("a").alias("a"), of("b").alias("b"))  # a row per repetition
    quantiles = [F.percentile(c, q).alias(f"{n}_{e}") for n, c in (("a", F.col("a")), ("b", F.col("b")), ("gap", F.col("a") - F.col("b"))) for e, q in (("low", 0.025), ("high", 0.975))]
    return K.naive_gap(tagged, ["one"], F.col("v")).drop("one").join(F.broadcast(means.agg(*quantiles)), F.lit(True))  # one row each


def model_intent(x: Chat) -> DataFrame:
    return M.friction_by_intent_model_era(x.conversations, x.intent, x.eras, MIN_CELL)


def written_cases(x: Chat) -> DataFrame:
    """Reasons and texts of the cases, matched once and read by counts and examples."""
    return x.written(D.with_reason(x.failures).select("reason", "user_feedback"), "cases")


def themes(x: Chat) -> DataFrame:
    """Failed cases are worked out once and read by counts, reasons and examples."""
    failed = x.written(cases(x).select("failure", "reason", "intent", "attributed_to", D.opening_ask(F.col("opening")).alias("ask")), "cases")
    return D.backlog(failed, T.nested_responders(x.shards(x.nested)), x.intent.withColumn("intent", F.coalesce("intent", F.lit("unlabelled")))).withColumn("examples", F.array_join("examples", " | "))


def scores(x: Chat) -> DataFrame:
    """Evaluation results; the weights that they meet come from the conversations."""
    return x.spark.createDataFrame(SCORES, "intent string, score double")


QUERIES = {
    "first_failures": chat_query(lambda x: x.failures.drop("opening")),
    "case_context": chat_query(lambda x: T.nested_context(x.shards(x.nested)).select("conv_id", F.size("context").cast("long").alias("messages"), F.array_join(F.transform("context", lambda m: m["role"]), ",").alias("roles"))),
    "failure_reasons": chat_query(lambda x: D.failure_reasons(written_cases(x)).withColumn("examples", F.array_join("examples", " | "))),
    "failure_reasons_by_intent": chat_query(lambda x: D.reasons_by_intent(cases(x))),
    "failure_case_reasons": chat_query(lambda x: cases(x).select("conv_id", "failure", "reason", "intent")),
    "backlog_themes": chat_query(themes),
    "responder_per_1k": chat_query(lambda x: D.responder_per_1k(T.responder_charges(x.turns))),
    "personal_responders": chat_query(lambda x: D.responder_per_1k(T.responder_charges(x.turns), PERSONAL_REPLIES)),
    "fix_list": chat_query(lambda x: D.fix_list(x.labelled)),
    "routing_cells": chat_query(lambda x: D.routing_cells(model_intent(x), D.price_list(x.spark), ROUTE_MIN)),
    "routing_policies": chat_query(lambda x: D.routing_policies(D.routing_cells(model_intent(x), D.price_list(x.spark), ROUTE_MIN))),
    "eval_mix_overall": chat_query(lambda x: D.usage_mix(M.intent_by_model(x.conversations, x.intent))),
    "eval_mix_excluding_other": chat_query(lambda x: D.usage_mix(M.intent_by_model(x.conversations, x.intent).where("intent <> 'other'"))),
    "eval_mix_by_model": chat_query(lambda x: D.usage_mix(M.intent_by_model(x.conversations, x.intent), ["model"])),
    "eval_mix_by_language": chat_query(lambda x: D.usage_mix(M.intent_by_language(x.conversations, x.intent, MIN_CELL), ["language"])),
    "eval_mix_by_era": chat_query(lambda x: D.usage_mix(M.intent_weekly(x.conversations, x.intent).join(F.broadcast(eras_to_now(x)), F.col("week").between(F.col("era_start"), F.col("era_end"))), ["era"])),
    "weighted_intents": chat_query(lambda x: D.weighted_intents(scores(x), D.usage_mix(M.intent_by_model(x.conversations, x.intent))).drop("total")),
    "weighted_score": chat_query(lambda x: D.weighted_score(scores(x), D.usage_mix(M.intent_by_model(x.conversations, x.intent)))),
    "friction_heat": chat_query(lambda x: D.friction_heat(M.friction_by_intent_model(x.conversations, x.intent, MIN_CELL), 100)),
    "naive_gap": chat_query(lambda x: K.naive_gap(pair_sides(x), KEYS, F.col("one_and_done"))),
    "matched_gap": chat_query(lambda x: K.matched_gap(K.per_user(pair_sides(x), KEYS, "pseudo_user", F.col("one_and_done")), KEYS)),
    "pair_comparison": chat_query(pair_comparison),
    "exact_bootstrap": chat_query(lambda x: K.exact_bootstrap(K.per_user(pair_sides(x), KEYS, "pseudo_user", F.col("one_and_done")), KEYS, "pseudo_user", "diff", EXACT_REPS)),
    "poisson_bootstrap": chat_query(lambda x: K.bootstrap(K.per_user(pair_sides(x), KEYS, "pseudo_user", F.col("friction")), KEYS, "diff", REPS)),
    "version_changes": chat_query(lambda x: K.version_changes(x.conversations)),
    "before_after": chat_query(change),
    "unpaired_change": chat_query(unpaired_change),
}

_FAILURE = """hits AS (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS k FROM turns WHERE role = 'user' AND (repeats_prev_user OR is_correction) AND last_reply IS NOT NULL
), failures AS MATERIALIZED (
 SELECT conv_id, idx::INTEGER AS idx, CASE WHEN is_correction THEN 'correction' ELSE 'repeat' END AS failure, last_reply AS bad_reply, content AS user_feedback, prev_user AS prev_request, attributed_to, similarity
 FROM hits WHERE k = 1)"""
_CASES = f"""cases AS MATERIALIZED (SELECT f.*, coalesce(c.intent, 'unlabelled') AS intent, {reasons.reason_sql("failure", "bad_reply", "user_feedback", "prev_request", "similarity")} AS reason FROM failures f JOIN c USING (conv_id))"""
_CELLS = f"cells AS (SELECT era, era_start, era_end, intent, model_family AS model, {N}, {RATES} FROM c JOIN eras ON date >= era_start AND date <= era_end WHERE intent IS NOT NULL {_HAVING})"
_NOW = "now_eras AS (SELECT * FROM eras UNION ALL SELECT 'C', (SELECT max(era_end) FROM eras) + 1, date_trunc('week', max(date) - 6)::DATE FROM c)"
_PRICE = "prices(model, cost) AS (SELECT m, (1500 * p + 800 * q) / 1e6 FROM (VALUES " + ", ".join(f"('{m}', {p}::DOUBLE, {q}::DOUBLE)" for m, p, q in D.PRICES) + ") AS t(m, p, q))"
_ROUTE = f"""good AS (SELECT c.*, cost, coalesce(conversations >= {ROUTE_MIN} AND cost IS NOT NULL, false) AS ok FROM cells c LEFT JOIN prices USING (model) WHERE intent <> 'other'),
route AS (SELECT * EXCLUDE (ok), ok OR NOT bool_or(ok) OVER (PARTITION BY era, intent) AS eligible FROM good)"""
_PAIRS = "pairs(intent, side_a, side_b) AS (VALUES " + ", ".join(str(p) for p in PAIRS) + ")"
_B = next(e for e in _eras() if e[0] == "B")
_TAGGED = f"""tagged AS (
 SELECT p.*, pseudo_user, one_and_done, repeated_request OR correction_followup AS friction, n_turns > 1 AS multi_turn, CASE WHEN model_family = side_a THEN 'a' ELSE 'b' END AS side
 FROM c JOIN pairs p ON c.intent = p.intent AND model_family IN (side_a, side_b) WHERE NOT has_empty_user_input AND date BETWEEN DATE '{_B[1]}' AND DATE '{_B[2]}')"""
_G = "intent, side_a, side_b"
_NAIVE = "count(*) FILTER (side = 'a')::BIGINT AS n_a, count(*) FILTER (side = 'b')::BIGINT AS n_b, avg({m}::INT) FILTER (side = 'a') AS naive_a, avg({m}::INT) FILTER (side = 'b') AS naive_b, avg({m}::INT) FILTER (side = 'a') - avg({m}::INT) FILTER (side = 'b') AS naive_gap"


def _users(keys: str, metric: str, table: str = "tagged") -> str:
    return f"SELECT {keys}, pseudo_user, avg({metric}::INT) FILTER (side = 'a') AS ra, avg({metric}::INT) FILTER (side = 'b') AS rb FROM {table} GROUP BY ALL HAVING ra IS NOT NULL AND rb IS NOT NULL"


_MATCHED = "count(*)::BIGINT AS matched_users, avg(ra) AS matched_a, avg(rb) AS matched_b, avg(ra - rb) AS matched_gap"


def _exact_boot(keys: str, order: str = "pseudo_user", value: str = "ra - rb", table: str = "users", name: str = "boot") -> str:
    """CTEs that end in ``name``: keys, ci_low, ci_high."""
    on = " AND ".join(f"s.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
    by = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""{name}_v AS (SELECT {keys}, {value} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {table}),
{name}_s AS (SELECT {keys}, n, rep, unnest(range(n)) AS slot FROM (SELECT {keys}, max(n) AS n FROM {name}_v GROUP BY ALL), (SELECT unnest(range({EXACT_REPS})) AS rep)),
{name}_m AS (SELECT {by}, rep, avg(x) AS m FROM {name}_s s JOIN {name}_v v ON {on} AND v.i = ('0x' || substr(md5(concat(rep, ':', slot)), 1, 8))::BIGINT % s.n GROUP BY ALL),
{name} AS (SELECT {keys}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM {name}_m GROUP BY ALL)"""


def _means(keys: str, value: str = "ra - rb", table: str = "users", name: str = "boot") -> str:
    """CTEs that end in ``name``_m: keys, rep, m; Poisson draws for the values of a histogram."""
    parts = ", ".join(f"{k.strip()}::VARCHAR" for k in keys.split(","))
    uniform = lambda at: f"('0x' || substr(md5(t), {at}, 8))::BIGINT / 4294967296.0::DOUBLE"
    probability = "exp(k * ln(m::DOUBLE) - m - lgamma(k + 1.0::DOUBLE))"
    return f"""{name}_h AS (SELECT {keys}, code, count(*) AS m FROM (SELECT {keys}, round(({value})::DOUBLE * 1e12::DOUBLE)::BIGINT AS code FROM {table} WHERE ({value}) IS NOT NULL) GROUP BY ALL),
{name}_p AS (SELECT m, list(p ORDER BY k) AS p FROM (SELECT m, k, sum({probability}) OVER (PARTITION BY m ORDER BY k) AS p FROM (SELECT m, unnest(range((m + 10 * ceil(sqrt(m)) + 10)::BIGINT)) AS k FROM (SELECT DISTINCT m FROM {name}_h WHERE m <= {K.POISSON_TABLE}))) GROUP BY m),
{name}_t AS (SELECT h.*, p.p, rep, code / 1e12::DOUBLE AS x, concat_ws(':', {parts}, code::VARCHAR, rep::VARCHAR) AS t FROM {name}_h h LEFT JOIN {name}_p p ON h.m = p.m, (SELECT unnest(range({REPS})) AS rep)),
{name}_u AS (SELECT *, {uniform(1)} AS u, {uniform(9)} AS v FROM {name}_t),
{name}_z AS (SELECT *, sqrt(-2 * ln(u + 1 / 8589934592.0::DOUBLE)) * cos(2 * pi() * v) AS z FROM {name}_u),
{name}_w AS (SELECT *, CASE WHEN m <= {K.POISSON_TABLE} THEN len(list_filter(p, lambda q: q <= u))::DOUBLE ELSE greatest(floor(m + sqrt(m) * z + (z * z - 1) / 6 + 0.5), 0)::DOUBLE END AS w FROM {name}_z),
{name}_m AS (SELECT {keys}, rep, sum(w * x) / nullif(sum(w), 0) AS m FROM {name}_w GROUP BY ALL)"""


def _boot(keys: str, value: str = "ra - rb", table: str = "users", name: str = "boot") -> str:
    return f"""{_means(keys, value, table, name)},
{name} AS (SELECT {keys}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM {name}_m GROUP BY ALL)"""


_VERDICT = "CASE WHEN NOT coalesce(matched_users >= 30, false) THEN 'overlap' WHEN ci_low > 0 OR ci_high < 0 THEN 'real' WHEN abs(naive_gap) >= 0.03 AND abs(matched_gap) < abs(naive_gap) / 3 THEN 'mix' ELSE 'none' END AS verdict"
_PAIR_VERDICT = "CASE WHEN (ci_low > 0 OR ci_high < 0) AND sign(naive_gap) <> sign(matched_gap) THEN 'flip' WHEN ci_low > 0 OR ci_high < 0 THEN 'real' ELSE 'mix' END AS pair_verdict"
_CHANGE = f"""points AS (SELECT pseudo_user, ts, correction_followup AS hit FROM c WHERE NOT has_empty_user_input),
half AS (SELECT epoch_us(min(ts)) AS m FROM points WHERE ts < TIMESTAMP '2024-06-17'),
tagged AS (
 SELECT 'change' AS run, pseudo_user, hit, CASE WHEN ts >= TIMESTAMP '2024-06-17' THEN 'a' ELSE 'b' END AS side FROM points
 UNION ALL SELECT 'placebo', pseudo_user, hit, CASE WHEN epoch_us(ts) >= (m + epoch_us(TIMESTAMP '2024-06-17')) / 2 THEN 'a' ELSE 'b' END FROM points, half WHERE ts < TIMESTAMP '2024-06-17'
), users AS ({_users("run", "hit")}), {_boot("run")},
result AS (SELECT * FROM (SELECT run, {_NAIVE.format(m="hit")} FROM tagged GROUP BY run) JOIN (SELECT run, {_MATCHED} FROM users GROUP BY run) USING (run) JOIN boot USING (run))"""
_SCORES = "scores(intent, score) AS (VALUES " + ", ".join(f"('{i}', {'NULL' if s is None else s}::DOUBLE)" for i, s in SCORES) + ")"
_WEIGHTS = "weights AS (SELECT intent, count(*)::BIGINT AS conversations, count(*) / sum(count(*)) OVER () AS weight FROM c WHERE intent IS NOT NULL GROUP BY intent)"
_PER = "per AS (SELECT w.intent, weight, count(score)::BIGINT AS n, avg(score) AS mean, sum(score) AS total FROM weights w LEFT JOIN scores s ON w.intent = s.intent GROUP BY ALL)"


def _mix(keys: str, source: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}intent, sum(n)::BIGINT AS conversations, sum(n) / sum(sum(n)) OVER ({part}) AS weight FROM ({source}) GROUP BY {k}intent"


_HISTORY = "tagged AS (SELECT correction_followup::INT AS v, CASE WHEN ts >= TIMESTAMP '2024-06-17' THEN 'a' ELSE 'b' END AS side FROM c WHERE NOT has_empty_user_input)"

ORACLE_SQL = {
    "first_failures": _chat_sql("SELECT * EXCLUDE (similarity) FROM failures", _FAILURE),
    "case_context": _chat_sql("""SELECT f.conv_id, count(m.idx)::BIGINT AS messages, coalesce(string_agg(m.role, ',' ORDER BY m.idx), '') AS roles
FROM (SELECT f.conv_id, max(t.idx) AS reply FROM failures f JOIN turns t ON t.conv_id = f.conv_id AND t.idx < f.idx AND t.role <> 'user' GROUP BY 1) f LEFT JOIN messages m ON m.conv_id = f.conv_id AND m.idx < reply GROUP BY 1""", _FAILURE),
    "failure_reasons": _chat_sql(r"""SELECT reason, n::BIGINT AS n, n / sum(n) OVER () AS share, array_to_string(texts[1:3], ' | ') AS examples
FROM (SELECT reason, count(*) AS n, list_sort(list(DISTINCT substr(trim(regexp_replace(user_feedback, '\s+', ' ', 'g')), 1, 140))) AS texts FROM cases GROUP BY reason)""", _FAILURE, _CASES),
    "failure_reasons_by_intent": _chat_sql("""SELECT intent, k::INTEGER AS rank, reason, n, failures, n / failures AS share FROM (
 SELECT intent, reason, count(*)::BIGINT AS n, (sum(count(*)) OVER (PARTITION BY intent))::BIGINT AS failures, row_number() OVER (PARTITION BY intent ORDER BY count(*) DESC, reason) AS k FROM cases GROUP BY 1, 2) WHERE failures >= 30 AND k <= 3""", _FAILURE, _CASES),
    "failure_case_reasons": _chat_sql("SELECT conv_id, failure, reason, intent FROM cases", _FAILURE, _CASES),
    "backlog_themes": _chat_sql(r"""SELECT t.*, b.conversations, t.failures / b.conversations AS share, r.reason AS top_reason, coalesce(array_to_string(e.asks[1:3], ' | '), '') AS examples FROM (
 SELECT intent, attributed_to AS responder, count(*)::BIGINT AS failures, count(*) FILTER (failure = 'correction')::BIGINT AS corrections, count(*) FILTER (failure = 'repeat')::BIGINT AS repeats FROM cases GROUP BY 1, 2) t
LEFT JOIN (SELECT coalesce(intent, 'unlabelled') AS intent, attributed_to AS responder, count(DISTINCT conv_id)::BIGINT AS conversations FROM turns JOIN c USING (conv_id) WHERE role <> 'user' GROUP BY 1, 2) b ON t.intent = b.intent AND t.responder = b.responder
LEFT JOIN (SELECT intent, attributed_to, reason, row_number() OVER (PARTITION BY intent, attributed_to ORDER BY count(*) DESC, reason) AS k FROM cases GROUP BY 1, 2, 3) r ON r.k = 1 AND r.intent = t.intent AND r.attributed_to IS NOT DISTINCT FROM t.responder
LEFT JOIN (SELECT intent, attributed_to, list_sort(list(DISTINCT substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 160))) AS asks FROM cases JOIN (SELECT conv_id, arg_min(content, idx) AS content FROM turns WHERE role = 'user' GROUP BY 1) USING (conv_id) GROUP BY 1, 2) e ON e.intent = t.intent AND e.attributed_to IS NOT DISTINCT FROM t.responder""", _FAILURE, _CASES),
    "responder_per_1k": _chat_sql("""SELECT *, 1000 * repeats / replies AS repeat_per_1k, 1000 * corrections / replies AS correction_per_1k FROM (
 SELECT attributed_to AS responder, count(*) FILTER (role <> 'user')::BIGINT AS replies, count(*) FILTER (repeats_prev_user)::BIGINT AS repeats, count(*) FILTER (is_correction)::BIGINT AS corrections FROM turns WHERE attributed_to IS NOT NULL GROUP BY 1) WHERE replies > 0"""),
    "personal_responders": _chat_sql("""SELECT *, 1000 * repeats / replies AS repeat_per_1k, 1000 * corrections / replies AS correction_per_1k FROM (
 SELECT attributed_to AS responder, count(*) FILTER (role <> 'user')::BIGINT AS replies, count(*) FILTER (repeats_prev_user)::BIGINT AS repeats, count(*) FILTER (is_correction)::BIGINT AS corrections FROM turns WHERE attributed_to IS NOT NULL GROUP BY 1) WHERE replies >= 30"""),
    "fix_list": _chat_sql("""SELECT intent, conversations, flagged, flagged / conversations AS rate, flagged / sum(flagged) OVER () AS share_of_flagged, (row_number() OVER (ORDER BY flagged DESC, intent))::INTEGER AS rank
FROM (SELECT intent, count(*)::BIGINT AS conversations, sum(repeated_request::INT + correction_followup::INT)::BIGINT AS flagged FROM c WHERE intent IS NOT NULL AND intent <> 'other' GROUP BY intent)"""),
    "routing_cells": _chat_sql("SELECT * FROM route", ERAS_SQL, _CELLS, _PRICE, _ROUTE),
    "routing_policies": _chat_sql("""SELECT *, one_and_done_rate - max(CASE WHEN policy = 'baseline_actual_mix' THEN one_and_done_rate END) OVER (PARTITION BY era) AS one_and_done_change,
 cost_per_1k / nullif(max(CASE WHEN policy = 'baseline_actual_mix' THEN cost_per_1k END) OVER (PARTITION BY era), 0) - 1 AS cost_change
FROM (SELECT era, policy, sum(n)::BIGINT AS conversations, sum(n * one_and_done_rate) / sum(n) AS one_and_done_rate, sum(n * refusal_rate) / sum(n) AS refusal_rate, sum(n * correction_rate) / sum(n) AS correction_rate,
 sum(n * repeat_rate) / sum(n) AS repeat_rate, 1000 * sum(n * price) / sum(n) AS cost_per_1k FROM (
 SELECT era, 'baseline_actual_mix' AS policy, conversations AS n, price, one_and_done_rate, refusal_rate, correction_rate, repeat_rate FROM priced
 UNION ALL SELECT era, policy, volume, price, one_and_done_rate, refusal_rate, correction_rate, repeat_rate FROM (
  SELECT *, 'best_friction' AS policy, row_number() OVER (PARTITION BY era, intent ORDER BY one_and_done_rate, model) AS k FROM open
  UNION ALL SELECT *, 'cheapest_only', row_number() OVER (PARTITION BY era, intent ORDER BY price, model) FROM open
  UNION ALL SELECT *, 'cost_aware', row_number() OVER (PARTITION BY era, intent ORDER BY price, model) FROM open WHERE one_and_done_rate <= floor + 0.05) WHERE k = 1) GROUP BY 1, 2)""", ERAS_SQL, _CELLS, _PRICE, _ROUTE,
        "priced AS (SELECT *, coalesce(cost, 0.0) AS price, sum(conversations) OVER (PARTITION BY era, intent) AS volume FROM route)", "open AS (SELECT *, min(one_and_done_rate) OVER (PARTITION BY era, intent) AS floor FROM priced WHERE eligible)"),
    "eval_mix_overall": _chat_sql("SELECT * FROM weights", _WEIGHTS),
    "eval_mix_excluding_other": _chat_sql(_mix("", "SELECT intent, count(*) AS n FROM c WHERE intent <> 'other' GROUP BY 1")),
    "eval_mix_by_model": _chat_sql(_mix("model", "SELECT model_family AS model, intent, count(*) AS n FROM c WHERE intent IS NOT NULL GROUP BY 1, 2")),
    "eval_mix_by_language": _chat_sql(_mix("language", f"SELECT language, intent, count(*) AS n FROM c WHERE intent IS NOT NULL AND language IN (SELECT language FROM (SELECT language, count(*) AS k FROM c GROUP BY 1 ORDER BY k DESC, language NULLS LAST LIMIT 10)) GROUP BY 1, 2 HAVING n >= {MIN_CELL}")),
    "eval_mix_by_era": _chat_sql(_mix("era", "SELECT era, intent, count(*) AS n FROM c JOIN now_eras ON week BETWEEN era_start AND era_end WHERE intent IS NOT NULL GROUP BY 1, 2"), ERAS_SQL, _NOW),
    "weighted_intents": _chat_sql("SELECT intent, weight, n, mean FROM per", _WEIGHTS, _SCORES, _PER),
    "weighted_score": _chat_sql("""SELECT sum(weight * mean) / sum(weight) FILTER (n > 0) AS usage_weighted_score, sum(total) / sum(n) AS unweighted_mean, sum(weight) FILTER (n > 0) AS covered_weight,
 coalesce(string_agg(intent, ',' ORDER BY intent) FILTER (n = 0), '') AS missing_intents FROM per""", _WEIGHTS, _SCORES, _PER),
    "friction_heat": _chat_sql(f"""SELECT intent, model, conversations, signal, rate, conversations >= 100 AS rankable FROM (
 UNPIVOT (SELECT intent, model, conversations, one_and_done_rate, repeat_rate, correction_rate FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY conversations DESC, model) AS k FROM (SELECT intent, model_family AS model, {N}, {RATES} FROM c WHERE intent IS NOT NULL {_HAVING})) WHERE k <= 3)
 ON one_and_done_rate, repeat_rate, correction_rate INTO NAME signal VALUE rate)"""),
    "naive_gap": _chat_sql(f"SELECT {_G}, {_NAIVE.format(m='one_and_done')} FROM tagged GROUP BY ALL", _PAIRS, _TAGGED),
    "matched_gap": _chat_sql(f"SELECT {_G}, {_MATCHED} FROM users GROUP BY ALL", _PAIRS, _TAGGED, f"users AS ({_users(_G, 'one_and_done')})"),
    "pair_comparison": _chat_sql(f"SELECT *, {_VERDICT}, {_PAIR_VERDICT} FROM (SELECT {_G}, metric, {_NAIVE.format(m='hit')}, least(avg(multi_turn::INT) FILTER (side = 'a'), avg(multi_turn::INT) FILTER (side = 'b')) >= 0.05 AS measurable FROM long GROUP BY ALL) LEFT JOIN (SELECT {_G}, metric, {_MATCHED} FROM users GROUP BY ALL) USING ({_G}, metric) LEFT JOIN boot USING ({_G}, metric)",
        _PAIRS, _TAGGED, "long AS (SELECT * EXCLUDE (one_and_done, friction), 'one_and_done' AS metric, one_and_done AS hit FROM tagged UNION ALL SELECT * EXCLUDE (one_and_done, friction), 'friction', friction FROM tagged)", f"users AS ({_users(_G + ', metric', 'hit', 'long')})", _boot(_G + ", metric")),
    "exact_bootstrap": _chat_sql(f"SELECT {_G}, ci_low, ci_high FROM boot", _PAIRS, _TAGGED, f"users AS ({_users(_G, 'one_and_done')})", _exact_boot(_G)),
    "poisson_bootstrap": _chat_sql(f"SELECT {_G}, ci_low, ci_high FROM boot", _PAIRS, _TAGGED, f"users AS ({_users(_G, 'friction')})", _boot(_G)),
    "version_changes": _chat_sql("SELECT version, previous, \"at\" FROM (SELECT version, min(ts) AS \"at\", lag(version) OVER (ORDER BY min(ts), version) AS previous FROM c GROUP BY version) WHERE previous IS NOT NULL"),
    "before_after": _chat_sql("""SELECT * EXCLUDE (run), (ci_high - ci_low) / (2 * 1.96) * 2.8 * 100 AS mde_points,
 CASE WHEN naive_a = 0 AND naive_b = 0 THEN 'none' WHEN matched_users < 30 THEN 'overlap' WHEN NOT (ci_low > 0 OR ci_high < 0) THEN 'none'
  WHEN coalesce((placebo_low > 0 OR placebo_high < 0) AND sign(placebo_gap) = sign(matched_gap), false) THEN 'trend' WHEN matched_gap > 0 THEN 'worse' ELSE 'real' END AS verdict
FROM (SELECT r.*, p.matched_gap AS placebo_gap, p.ci_low AS placebo_low, p.ci_high AS placebo_high FROM result r LEFT JOIN result p ON p.run = 'placebo' WHERE r.run = 'change')""", _CHANGE),
    "unpaired_change": _chat_sql(f"""SELECT n.*, quantile_cont(a, 0.025) AS a_low, quantile_cont(a, 0.975) AS a_high, quantile_cont(b, 0.025) AS b_low, quantile_cont(b, 0.975) AS b_high, quantile_cont(a - b, 0.025) AS gap_low, quantile_cont(a - b, 0.975) AS gap_high
FROM (SELECT {_NAIVE.format(m='v')} FROM tagged) n, (SELECT rep, max(m) FILTER (side = 'a') AS a, max(m) FILTER (side = 'b') AS b FROM boot_m GROUP BY rep) GROUP BY ALL""", _HISTORY, _means("side", "v", "tagged")),
}

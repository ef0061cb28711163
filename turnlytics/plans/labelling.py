"""Queries for sampling, labelling and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlytics.operators import intent as I
from turnlytics.operators import labels as L
from turnlytics.operators import sampling as P
from turnlytics.sources import results
from turnlytics.sources.files import shared_folder

from .core import FAMILY, Chat, _chat_sql, chat_query
from .fixtures.chat import dialect

DRAWN, FLOOR = 400, 10


def hashed(text: str) -> F.Column:
    return F.expr(dialect(text, True))


def allocation(strata: DataFrame) -> DataFrame:
    sizes = strata.groupBy(*P.STRATUM).agg(F.count(F.lit(1)).alias("size"))
    return P.allocate(sizes, DRAWN, FLOOR)


def drawn(x: Chat) -> DataFrame:
    """The sample with its texts; only the texts of drawn conversations are moved."""
    strata = x.written(P.strata(x.conversations).drop("intent_text"), "strata")  # read by the sizes, the ranges of hashes and the draw
    picked = P.draw(strata, allocation(strata))
    texts = x.conversations.select("conv_id", "intent_text")
    return texts.join(F.broadcast(picked), "conv_id").select(*picked.columns, "intent_text")  # DRAWN rows


#: Two raters: the label itself, and one that strays for some conversations and uses older names for others.
RATER_B = "CASE WHEN {h:concat('s', conv_id):10} = 0 THEN 'other' WHEN label = 'questions' THEN CASE {h:concat('o', conv_id):3} WHEN 0 THEN 'information_seeking' WHEN 1 THEN 'homework_study' ELSE 'questions' END WHEN label = 'writing_and_business' AND {h:concat('o', conv_id):2} = 0 THEN 'writing_editing' ELSE label END"
ANSWER = """CASE {h:concat('a', conv_id):8} WHEN 0 THEN 'I think this is about something else.' WHEN 1 THEN concat('Sure! {"intent": "', label, '", "confidence": "high"} Anything else?')
 WHEN 2 THEN '{"intent": "poetry", "confidence": "high"}' WHEN 3 THEN concat('{"intent": "', label, '", "confidence": "certain"}') WHEN 4 THEN concat('{"a": 1} {"intent": "', label, '", "confidence": "low"}') ELSE concat('{"intent": "', label, '", "confidence": "medium"}') END"""
PRED = "CASE WHEN {h:concat('w', conv_id):5} = 0 THEN CASE {h:concat('v', conv_id):3} WHEN 0 THEN 'coding' WHEN 1 THEN 'other' ELSE 'questions' END ELSE label END"
TRUTHS = {"is_repeat": "CASE WHEN repeated_request THEN {h:concat('g', conv_id):10} < 8 ELSE {h:concat('g', conv_id):20} = 0 END", "is_correction": "CASE WHEN correction_followup THEN {h:concat('j', conv_id):20} < 19 ELSE {h:concat('j', conv_id):30} = 0 END", "is_refusal": "CASE WHEN assistant_refusal THEN {h:concat('k', conv_id):10} < 4 ELSE false END", "satisfied": "{h:concat('z', conv_id):10} < 6"}


def raters(x: Chat) -> tuple[DataFrame, DataFrame]:
    rows = x.labelled.where("intent IS NOT NULL")
    return rows.select("conv_id", "intent"), rows.select("conv_id", hashed(RATER_B).alias("intent"))


def answers(x: Chat) -> DataFrame:
    rows = x.labelled.where("intent IS NOT NULL")
    return rows.select("conv_id", hashed(ANSWER).alias("answer"), F.lit(1).alias("attempt"))


def progress(x: Chat) -> DataFrame:
    """Attempts as JSON lines, a failed one before each that counts, read back and collected."""
    path = shared_folder(x.spark, "progress")
    rows = answers(x)
    rows.unionByName(rows.withColumns({"answer": F.lit("no answer"), "attempt": F.lit(0)})).write.json(path)
    return L.collect_labels(results.read_progress(x.spark, path))


def predictions(x: Chat) -> DataFrame:
    return x.labelled.where("intent IS NOT NULL").select("conv_id", F.col("intent").alias("label"), hashed(PRED).alias("pred"))


def truths(x: Chat) -> tuple[DataFrame, DataFrame]:
    rows = x.conversations.where("NOT has_empty_user_input")
    return rows.select("conv_id", *L.PROXY_LABELS, "one_and_done"), rows.select("conv_id", *(hashed(t).alias(n) for n, t in TRUTHS.items()))


def survey(x: Chat) -> tuple[DataFrame, DataFrame]:
    rows = x.conversations
    results = rows.select((F.col("conv_id") / 1000).cast("long").alias("participant"), (F.col("conv_id") % 1000).alias("question"), (F.lit(30.0) + hashed("{h:concat('y', conv_id):120}")).alias("seconds"), (hashed("{h:concat('b', conv_id):10}") < 9).alias("correct"), (hashed("{h:concat('f', conv_id):10}") < 8).alias("caveat"))
    votes = rows.select((F.col("conv_id") / 1000).cast("long").alias("respondent"), F.concat(F.lit("F"), F.col("conv_id") % 1000).alias("finding_id"), (hashed("{h:concat('w', conv_id % 1000):10}") + hashed("{h:concat('x', conv_id):4}") >= 5).alias("would_act"))
    return results, votes


def softmax(rows: DataFrame) -> DataFrame:
    """Predictions from the exported weights of a fitted classifier."""
    usable = rows.where("label IS NOT NULL AND text IS NOT NULL")
    model = I.fit_sample(usable, "doc_id")
    return I.softmax_scores(rows, model.table(I.sampled(usable, "doc_id", I.SAMPLE_ROWS)), model.classes, model.intercepts.tolist()).withColumn("proba_max", F.col("proba_max").cast("float"))


# A small table of weights (block, term, idf, one weight per class) for texts of three languages.
FIXED_CLASSES, FIXED_INTERCEPTS = ["de", "en", "fr"], [0.1, 0.3, -0.2]
FIXED_WEIGHTS = [
    ("word", "the", 1.2, [-2.0, 3.0, -1.0]), ("word", "and", 1.3, [-1.5, 2.5, -1.0]), ("word", "of the", 2.0, [-0.5, 1.5, -0.5]), ("word", "les", 1.7, [-1.0, -1.0, 2.5]), ("word", "der", 1.9, [2.5, -1.0, -0.5]),
    ("char", " th", 1.1, [-1.0, 2.0, -1.0]), ("char", "ée", 1.4, [-1.0, -1.5, 2.5]), ("char", "ch", 1.2, [1.5, -0.5, 0.2]), ("char", "eau", 2.2, [-1.0, -1.0, 2.0]), ("char", "ing ", 1.6, [-0.5, 2.0, -1.0]), ("char", " le ", 1.8, [-1.0, -1.0, 2.0]),
]


def fixed_softmax(x: Chat) -> DataFrame:
    weights = x.spark.createDataFrame(FIXED_WEIGHTS, "block string, term string, idf double, weights array<double>")
    return I.softmax_scores(x.table("documents").select("doc_id", "text"), weights, FIXED_CLASSES, FIXED_INTERCEPTS).withColumn("proba_max", F.round("proba_max", 5))


def predicted_shards(x: Chat) -> DataFrame:
    """Intents of all conversations, by a classifier fitted on all labelled ones; a row per conversation, with its shard."""
    rows = x.written(x.labelled.select("conv_id", "shard", "intent_text", "has_empty_user_input", "intent"), "labelled")
    model = I.fit(rows.where("intent IS NOT NULL").select(F.col("intent").alias("label"), F.col("intent_text").alias("text")))
    return I.predict_shards(rows, model)


QUERIES = {
    "sample_strata": chat_query(lambda x: P.strata(x.conversations).groupBy(*P.STRATUM).agg(F.count(F.lit(1)).alias("size"))),
    "sample_allocation": chat_query(lambda x: allocation(P.strata(x.conversations))),
    "sample_draw": chat_query(lambda x: drawn(x).drop("intent_text")),
    "label_prompts": chat_query(lambda x: L.prompts(drawn(x)).select("conv_id", F.length("request").alias("length"), F.get_json_object("request", "$.user").alias("text"))),
    "label_cost": chat_query(lambda x: L.label_cost(L.prompts(drawn(x)), 3.0, 15.0)),
    "label_parse": chat_query(lambda x: answers(x).select("conv_id", L.parse_label(F.col("answer")).alias("l")).select("conv_id", "l.intent", "l.confidence")),
    "label_collect": chat_query(lambda x: L.collect_labels(answers(x))),
    "label_progress": chat_query(progress),
    "label_resume": chat_query(lambda x: L.remaining(drawn(x).select("conv_id"), L.collect_labels(answers(x)))),
    "label_canary": chat_query(lambda x: L.canary_ok(answers(x))),
    "label_with_function": chat_query(lambda x: L.label_rows(L.prompts(drawn(x)), _rule_answer)),
    "label_gated": chat_query(lambda x: L.label_batch(L.prompts(drawn(x)), _rule_answer, shared_folder(x.spark, "labels"), 3.0, 15.0, budget=100.0)),
    "rater_agreement": chat_query(lambda x: L.agreement(*raters(x))),
    "rater_disagreements": chat_query(lambda x: L.disagreements(*raters(x))),
    "proxy_precision": chat_query(lambda x: L.proxy_precision(*truths(x))),
    "friction_vs_outcome": chat_query(lambda x: L.friction_vs_outcome(*truths(x))),
    "survey_score": chat_query(lambda x: L.survey_score(*survey(x))),
    "split_stratified": chat_query(lambda x: P.split(predictions(x), "label", "conv_id").select("conv_id", "label", "is_test")),
    "confusion_matrix": chat_query(lambda x: L.confusion(predictions(x), L.CLASSES)),
    "classification_report": chat_query(lambda x: L.report(predictions(x))),
    "classification_gate": chat_query(lambda x: L.gate(L.summary(predictions(x)), 0.8707)),
    "label_sample_export": chat_query(lambda x: P.labelling_export(x.turns)),
    "tfidf_words": lambda spark, sf: I.tfidf(Chat(spark, sf).table("documents").select("doc_id", "text"), "doc_id", "text", I.word_list),
    "tfidf_characters": chat_query(lambda x: I.tfidf(x.table("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", "text", I.character_list)),
    "intent_softmax_fixed": chat_query(fixed_softmax),
    "intent_by_shard": chat_query(predicted_shards),
    "intent_softmax": lambda spark, sf: softmax(Chat(spark, sf).table("documents").select("doc_id", "text", F.col("lang").alias("label"))),
    "intent_predict": lambda spark, sf: I.train_and_predict(Chat(spark, sf).table("documents").select("doc_id", "text", F.col("lang").alias("label"))),
}


def _rule_answer(request: str) -> str:
    """A labeller by rule, in place of a model."""
    return '{"intent": "coding", "confidence": "low"}' if "code" in request.lower() else '{"intent": "other", "confidence": "low"}'


def d(text: str) -> str:
    return dialect(text, False)


_STRATA = f"""eligible AS (SELECT * FROM c WHERE NOT has_empty_user_input AND length(intent_text) >= 5),
best AS (SELECT language FROM (SELECT language, count(*) AS n FROM eligible WHERE language IS NOT NULL GROUP BY 1 ORDER BY n DESC, language LIMIT 8)),
strata AS (SELECT conv_id, model_family, CASE WHEN language IN (SELECT language FROM best) THEN language ELSE 'other' END AS lang_bucket, date_trunc('quarter', ts)::DATE AS quarter, intent_text FROM eligible),
sizes AS (SELECT model_family, lang_bucket, quarter, count(*)::BIGINT AS size FROM strata GROUP BY ALL)"""
_ALLOCATED = f"""wanted AS (
 SELECT *, least(greatest(floor_k, round_even({DRAWN} * size / total, 0)::BIGINT), size) AS want FROM (
  SELECT *, CASE WHEN {FLOOR} * count(*) OVER () > {DRAWN} THEN greatest(1, {DRAWN} // count(*) OVER ()) ELSE {FLOOR} END AS floor_k, sum(size) OVER () AS total FROM sizes)
), spare AS (SELECT *, greatest(0, want - least(floor_k, size)) AS spare, sum(want) OVER () - {DRAWN} AS excess FROM wanted),
allocation AS (SELECT model_family, lang_bucket, quarter, size, (want - least(spare, greatest(excess - coalesce(sum(spare) OVER (ORDER BY want DESC, model_family, lang_bucket, quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)))::BIGINT AS k FROM spare),
drawn AS (SELECT conv_id, model_family, lang_bucket, quarter, intent_text FROM (SELECT s.*, k, row_number() OVER (PARTITION BY s.model_family, s.lang_bucket, s.quarter ORDER BY md5(concat(conv_id, ':7')), conv_id) AS place FROM strata s JOIN allocation a ON s.model_family = a.model_family AND s.lang_bucket = a.lang_bucket AND s.quarter = a.quarter) WHERE place <= k)"""
_SYSTEM = "Classify the request into one of:\n" + "\n".join(f"- {n}: {t}" for n, _, t in L.TAXONOMY)
_SYSTEM_SQL = "'" + _SYSTEM.replace("'", "''") + "'"
_ANSWERS = f"""answers AS (SELECT conv_id, label, {d("{h:concat('a', conv_id):8}")} AS kind FROM c WHERE intent IS NOT NULL),
parsed AS (SELECT conv_id, kind, CASE WHEN kind IN (1, 4, 5, 6, 7) THEN label END AS intent, CASE kind WHEN 1 THEN 'high' WHEN 4 THEN 'low' WHEN 5 THEN 'medium' WHEN 6 THEN 'medium' WHEN 7 THEN 'medium' END AS confidence FROM answers)"""
_MERGE = "CASE WHEN {x} IN ('information_seeking', 'homework_study', 'personal_advice') THEN 'questions' WHEN {x} IN ('writing_editing', 'business_professional') THEN 'writing_and_business' ELSE {x} END"
_RATED = f"rated AS (SELECT conv_id, intent AS x, {d(RATER_B)} AS y FROM c WHERE intent IS NOT NULL), merged AS (SELECT *, {_MERGE.format(x='x')} AS mx, {_MERGE.format(x='y')} AS my FROM rated)"
_TRUTHS = "judged AS (SELECT *, " + ", ".join(f"{d(t)} AS {n}" for n, t in TRUTHS.items()) + " FROM c WHERE NOT has_empty_user_input)"
_PRED = f"p AS (SELECT conv_id, intent AS label, {d(PRED)} AS pred FROM c WHERE intent IS NOT NULL)"
_REPORT = """per AS (SELECT class, 1.0 * tp / nullif(predicted, 0) AS p, 1.0 * tp / nullif(support, 0) AS r, support FROM (
 SELECT class, count(*) FILTER (label = class AND pred = class) AS tp, count(*) FILTER (label = class) AS support, count(*) FILTER (pred = class) AS predicted FROM p, (SELECT label AS class FROM p UNION SELECT pred FROM p) GROUP BY class)),
scored AS (SELECT class, support::BIGINT AS support, coalesce(p, 0)::DOUBLE AS precision, coalesce(r, 0)::DOUBLE AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0)::DOUBLE AS f1 FROM per)"""
_SURVEY = f"""s AS (SELECT conv_id // 1000 AS participant, conv_id % 1000 AS question, 30.0 + {d("{h:concat('y', conv_id):120}")} AS seconds, {d("{h:concat('b', conv_id):10}")} < 9 AS correct, {d("{h:concat('f', conv_id):10}")} < 8 AS caveat,
 concat('F', conv_id % 1000) AS finding_id, {d("{h:concat('w', conv_id % 1000):10}")} + {d("{h:concat('x', conv_id):4}")} >= 5 AS would_act FROM c)"""


def _proxy(name: str, fired: str, truth: str) -> str:
    return f"SELECT '{name}' AS proxy, count(*) FILTER ({fired})::BIGINT AS predicted, count(*) FILTER ({fired} AND {truth})::BIGINT AS true_positives, count(*) FILTER ({truth})::BIGINT AS actual FROM judged"


_PROXIES = " UNION ALL ".join([*(_proxy(p, p, t) for p, t in L.PROXY_LABELS.items()), _proxy("one_and_done", "one_and_done", "NOT satisfied")])
_CLASSES_SQL = ", ".join(f"count(*) FILTER (pred = '{n}')::BIGINT AS {n}" for n in L.CLASSES)


def tfidf_sql(terms: str) -> str:
    """terms: a SELECT of id, term, one row per occurrence."""
    return f"""tf AS (SELECT id, term, count(*) AS n FROM ({terms}) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING df >= 2), total AS (SELECT count(DISTINCT id) AS docs FROM tf),
w AS (SELECT id, term, (1 + ln(n)) * (ln((1 + docs) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), total)
SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM w"""


def _fixed_softmax_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(b)}, {quoted(t)}, {idf}::DOUBLE, [{', '.join(f'{w}::DOUBLE' for w in ws)}])" for b, t, idf, ws in FIXED_WEIGHTS)
    classes = range(len(FIXED_CLASSES))
    return rf"""WITH weights(block, term, idf, w) AS (VALUES {table}),
t AS (SELECT doc_id, lower(coalesce(text, '')) AS s, length(coalesce(text, '')) < 5 AS short FROM documents),
v AS (SELECT doc_id, regexp_extract_all(s, '[\p{{L}}\p{{N}}_]{{2,}}') AS v FROM t),
occurrences AS (
 SELECT doc_id, 'word' AS block, unnest(v) AS term FROM v
 UNION ALL SELECT doc_id, 'word', v[i] || ' ' || v[i + 1] FROM v, LATERAL (SELECT unnest(range(1, len(v))) AS i) AS r
 UNION ALL SELECT doc_id, 'char', substr(w, i, n) FROM (SELECT doc_id, concat(' ', unnest(regexp_extract_all(s, '[^\s]+')), ' ') AS w FROM t), (VALUES (2), (3), (4)) AS g(n), LATERAL (SELECT unnest(range(1, length(w) - n + 2)) AS i) AS r
), tf AS (SELECT doc_id, block, term, count(*) AS n FROM occurrences GROUP BY ALL),
x AS (SELECT doc_id, w.block, (1 + ln(n)) * idf AS x, w FROM tf JOIN weights w ON tf.block = w.block AND tf.term = w.term),
b AS (SELECT doc_id, block, sqrt(sum(x * x)) AS l, {", ".join(f"sum(x * w[{k + 1}]) AS a{k}" for k in classes)} FROM x GROUP BY ALL),
z AS (SELECT doc_id, {", ".join(f"sum(a{k} / l) AS z{k}" for k in classes)} FROM b GROUP BY doc_id),
scored AS (SELECT t.doc_id, short, [{", ".join(f"{FIXED_INTERCEPTS[k]}::DOUBLE + coalesce(z{k}, 0)" for k in classes)}] AS s FROM t LEFT JOIN z ON t.doc_id = z.doc_id)
SELECT doc_id, CASE WHEN NOT short THEN ({FIXED_CLASSES})[list_position(s, list_max(s))] END AS pred, round(CASE WHEN short THEN 0 ELSE 1 / list_sum(list_transform(s, lambda y: exp(y - list_max(s)))) END, 5) AS proba_max FROM scored"""


ORACLE_SQL = {
    "sample_strata": _chat_sql("SELECT * FROM sizes", _STRATA),
    "sample_allocation": _chat_sql("SELECT * FROM allocation", _STRATA, _ALLOCATED),
    "sample_draw": _chat_sql("SELECT * EXCLUDE (intent_text) FROM drawn", _STRATA, _ALLOCATED),
    "label_prompts": _chat_sql(f"SELECT conv_id, length(to_json({{'system': {_SYSTEM_SQL}, 'user': substr(intent_text, 1, 2000)}})::VARCHAR)::INTEGER AS length, substr(intent_text, 1, 2000) AS text FROM drawn", _STRATA, _ALLOCATED),
    "label_with_function": _chat_sql(f"SELECT conv_id, concat('{{\"intent\": \"', CASE WHEN contains(lower(concat({_SYSTEM_SQL}, substr(intent_text, 1, 2000))), 'code') THEN 'coding' ELSE 'other' END, '\", \"confidence\": \"low\"}}') AS answer FROM drawn", _STRATA, _ALLOCATED),
    "label_gated": _chat_sql(f"SELECT conv_id, CASE WHEN contains(lower(concat({_SYSTEM_SQL}, substr(intent_text, 1, 2000))), 'code') THEN 'coding' ELSE 'other' END AS intent, 'low' AS confidence FROM drawn", _STRATA, _ALLOCATED),
    "label_cost": _chat_sql(f"SELECT count(*)::BIGINT AS requests, sum(t)::BIGINT AS input_tokens, (count(*) * 30)::BIGINT AS output_tokens, (sum(t) * 3.0::DOUBLE + count(*) * 30 * 15.0::DOUBLE) / 1e6 AS cost FROM (SELECT ceil((length(substr(intent_text, 1, 2000)) + {len(_SYSTEM)}) / 4.0::DOUBLE) AS t FROM drawn)", _STRATA, _ALLOCATED),
    "label_parse": _chat_sql("SELECT conv_id, intent, confidence FROM parsed", _ANSWERS),
    "label_collect": _chat_sql("SELECT conv_id, intent, confidence FROM parsed WHERE intent IS NOT NULL", _ANSWERS),
    "label_progress": _chat_sql("SELECT conv_id, intent, confidence FROM parsed WHERE intent IS NOT NULL", _ANSWERS),
    "label_resume": _chat_sql("SELECT conv_id FROM drawn WHERE conv_id NOT IN (SELECT conv_id FROM parsed WHERE intent IS NOT NULL)", _STRATA, _ALLOCATED, _ANSWERS),
    "label_canary": _chat_sql("SELECT count(*)::BIGINT AS n, avg((intent IS NOT NULL)::INT) AS parse_rate, avg((intent IS NOT NULL)::INT) >= 0.9 AS go_on FROM (SELECT * FROM parsed ORDER BY conv_id LIMIT 50)", _ANSWERS),
    "rater_agreement": _chat_sql("SELECT count(*)::BIGINT AS n, avg((x = y)::INT) AS raw_agreement, avg((mx = my)::INT) AS merged_agreement FROM merged", _RATED),
    "rater_disagreements": _chat_sql("SELECT least(mx, my) AS first, greatest(mx, my) AS second, count(*)::BIGINT AS n FROM merged WHERE mx <> my GROUP BY 1, 2 ORDER BY n DESC, first, second LIMIT 5", _RATED),
    "proxy_precision": _chat_sql(f"SELECT *, true_positives / nullif(predicted, 0) AS precision, true_positives / nullif(actual, 0) AS recall, CASE WHEN true_positives / nullif(predicted, 0) >= 0.7 THEN 'keep' ELSE 'drop' END AS verdict FROM ({_PROXIES})", _TRUTHS),
    "friction_vs_outcome": _chat_sql("SELECT count(*)::BIGINT AS n_labels, avg((NOT satisfied)::INT) FILTER (repeated_request OR correction_followup OR assistant_refusal OR one_and_done) AS friction_vs_outcome FROM judged", _TRUTHS),
    "survey_score": _chat_sql("""SELECT *, under_limit >= 0.8 AS time_pass, task_success >= 0.8 AS success_pass, caveat_retention >= 0.8 AS caveat_pass, n_findings >= 3 AS action_pass FROM
 (SELECT median(seconds)::DOUBLE AS median_seconds, avg((seconds < 120)::INT) AS under_limit, avg(correct::INT) AS task_success FROM s),
 (SELECT avg(c::INT) AS caveat_retention FROM (SELECT arg_max(caveat, question) AS c FROM s GROUP BY participant)),
 (SELECT count(*)::BIGINT AS n_findings, coalesce(string_agg(finding_id, ',' ORDER BY finding_id), '') AS findings FROM (SELECT finding_id FROM s GROUP BY 1 HAVING avg(would_act::INT) > 0.5))""", _SURVEY),
    "split_stratified": _chat_sql("SELECT conv_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat(conv_id, ':7')), conv_id) <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS is_test FROM p", _PRED),
    "confusion_matrix": _chat_sql(f"SELECT label, {_CLASSES_SQL} FROM p GROUP BY label", _PRED),
    "classification_report": _chat_sql("SELECT * FROM scored", _PRED, _REPORT),
    "classification_gate": _chat_sql("SELECT *, 0.7836::DOUBLE AS gate, accuracy >= 0.7836 AS passes, accuracy >= 0.7836 AS used FROM (SELECT count(*)::BIGINT AS n, avg((label = pred)::INT) AS accuracy FROM p), (SELECT avg(f1) AS macro_f1 FROM scored WHERE support > 0)", _PRED, _REPORT),
    "label_sample_export": _chat_sql("""SELECT conv_id, n_turns, user_texts, replies FROM (
 SELECT conv_id, count(*) FILTER (role = 'user')::BIGINT AS n_turns, bool_or(is_empty) FILTER (role = 'user') AS bad, coalesce(string_agg(content, ' ||| ' ORDER BY idx) FILTER (role = 'user'), '') AS user_texts, coalesce(string_agg(left(content, 400), ' ||| ' ORDER BY idx) FILTER (role <> 'user'), '') AS replies FROM turns GROUP BY conv_id)
WHERE n_turns BETWEEN 1 AND 6 AND NOT bad ORDER BY md5(concat(conv_id, ':7')) LIMIT 300"""),
    "tfidf_words": "WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS v FROM documents),\n" + tfidf_sql("SELECT id, unnest(v) AS term FROM t UNION ALL SELECT id, v[i] || ' ' || v[i + 1] FROM t, LATERAL (SELECT unnest(range(1, len(v))) AS i) AS r").replace("SELECT id, term, x", "SELECT id AS doc_id, term, x"),
    "tfidf_characters": "WITH u AS (SELECT conv_id * 1000 + turn AS id, unnest(regexp_extract_all(lower(text), '[^\\s]+')) AS word FROM conversations WHERE role = 'user'), p AS (SELECT id, concat(' ', word, ' ') AS w FROM u),\n" + tfidf_sql("SELECT id, substr(w, i, n) AS term FROM p, (VALUES (2), (3), (4)) AS s(n), LATERAL (SELECT unnest(range(1, greatest(length(w) - n, 0) + 2)) AS i) AS r WHERE n = 2 OR length(w) > n - 1 AND NOT (length(w) < n)"),
    "intent_softmax_fixed": _fixed_softmax_sql(),
}

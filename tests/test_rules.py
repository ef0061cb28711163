import pytest
from pyspark.sql import functions as F

from turnlytics.functions import reasons
from turnlytics.functions import rules as R
from turnlytics.operators import labels as L
from turnlytics.operators import sampling as P


def evaluate(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_corrections(spark):
    yes = ["No, that is wrong", "no. again", "not what I asked", "wrong", "That’s not it", "I meant the other", "you didn't finish", "try again", "不对，再来", "нет, не то", "Неправильно", "incorrecto", "non, merci", "ce n'est pas ça", "  No!"]
    no = ["Nobody knows", "no problem", "none", "notwhat", "wrongly put", "thanks", "", None, "malo", "новый", "Non"]
    assert evaluate(spark, yes, R.is_correction) == [True] * len(yes)
    assert evaluate(spark, no, R.is_correction) == [False] * len(no)


def test_refusals(spark):
    yes = ["I'm sorry, but I can't help with that.", "I cannot assist", "As an AI language model", "很抱歉，我不能", "К сожалению, я не могу", "Unfortunately, I can’t"]
    no = ["Sure, here you go.", "I cannot believe it", "", None]
    assert evaluate(spark, yes, R.is_refusal) == [True] * len(yes)
    assert evaluate(spark, no, R.is_refusal) == [False] * len(no)


def test_similarity_and_repeats(spark):
    frame = spark.createDataFrame([("a b c", "A b, c!"), ("a b c d", "a b x"), (None, "a"), ("", ""), ("你好", "你好")], "a string, b string")
    got = frame.select(R.jaccard(F.col("a"), F.col("b")).alias("j"), R.is_repeat(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["j"] for r in got] == [1.0, 0.4, 0.0, 0.0, 1.0] and [r["r"] for r in got] == [True, False, False, False, True]


def test_model_family(spark):
    assert evaluate(spark, ["gpt-4-0125-preview", "gpt-4.1-mini-2025-04-14", "gpt-4o", "o1-mini-2024-09-12", None], R.model_family) == ["gpt-4", "gpt-4.1-mini", "gpt-4o", "o1-mini", None]


@pytest.mark.parametrize(("first", "last", "want"), [("2024-03-04", "2024-03-11", ("2024-03-04", "2024-03-04")), ("2024-03-06", "2024-03-24", ("2024-03-11", "2024-03-18")), ("2024-03-06", "2024-03-09", (None, None))])
def test_complete_weeks(spark, first, last, want):
    a, z = R.complete_weeks(F.lit(first).cast("date"), F.lit(last).cast("date"))
    r = spark.range(1).select(a.cast("string").alias("a"), z.cast("string").alias("z")).first()
    assert (r["a"], r["z"]) == want


def test_times_and_roles(spark):
    seconds = ["1709510400", "1709510400000", "1709510400000000", "1709510400000000000", "2024-03-04T00:00:00Z", "never", None]
    got = evaluate(spark, seconds, lambda x: R.any_timestamp(x).cast("string"))
    assert got == ["2024-03-04 00:00:00"] * 5 + [None, None]
    assert evaluate(spark, ["Human", "AI", "Customer", "function", "someone", "", None], R.role_name) == ["user", "assistant", "user", "function", "someone", None, None]
    assert evaluate(spark, [" yes ", "1", "no", None], R.truthy) == [True, True, False, False]
    assert evaluate(spark, ["", "  \n", "x", None], R.is_blank) == [True, True, False, True]


def test_reasons_in_order(spark):
    cases = [
        ("correction", "I'm sorry, but I can't help", "no, do it", "x", "refused"),
        ("correction", "ok", "it does not work", "x", "broken"),
        ("correction", "ok", "continue", "x", "incomplete"),
        ("correction", "ok", "I asked you to be brief", "x", "ignored"),
        ("correction", "ok", "answer in Spanish", "x", "language"),
        ("correction", "ok", "too long", "x", "format"),
        ("correction", "ok", "not what I meant", "x", "misunderstood"),
        ("correction", "ok", "that is incorrect", "x", "wrong"),
        ("correction", "ok", "hmm", "x", "unclear"),
        ("repeat", "ok", "tell me about rivers", "tell me about rivers", "resent"),
        ("repeat", "ok", "tell me about big rivers please", "tell me about rivers please", "reworded"),
        # long repeats: the words of the task itself are no complaint
        ("repeat", "ok", "fix this program, it does not work on my machine today please", "fix this program, it does not work on my machine today", "resent"),
        ("repeat", "ok", None, None, "reworded"),
    ]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, failure string, bad string, said string, before string, want string")
    for r in frame.select("*", reasons.reason_of(F.col("failure"), F.col("bad"), F.col("said"), F.col("before")).alias("got")).collect():
        assert r["got"] == r["want"], r


@pytest.mark.parametrize(("sizes", "n", "floor", "want"), [({"a": 300, "b": 100, "c": 5}, 100, 10, {"a": 70, "b": 25, "c": 5}), ({f"s{i:02d}": 200 for i in range(50)}, 200, 20, {f"s{i:02d}": 4 for i in range(50)}), ({"a": 3, "b": 3}, 100, 10, {"a": 3, "b": 3})])
def test_allocation(spark, sizes, n, floor, want):
    rows = P.allocate(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), n, floor, ["stratum"]).select("stratum", F.col("k").alias("drawn")).collect()
    assert {r["stratum"]: r["drawn"] for r in rows} == want


def test_label_parsing(spark):
    texts = ['{"intent": "coding", "confidence": "high"}', 'Sure: {"intent": "other", "confidence": "low"}!', '{"intent": "poetry", "confidence": "high"}', '{"intent": "coding", "confidence": "sure"}', "none", "", None, '{"x": 1} {"intent": "questions", "confidence": "medium"}']
    got = evaluate(spark, texts, lambda x: L.parse_label(x)["intent"])
    assert got == ["coding", "other", None, None, None, None, None, "questions"]
    assert evaluate(spark, ["homework_study", "business_professional", "coding", "poetry"], L.mapped) == ["questions", "writing_and_business", "coding", "poetry"]


def test_sql_functions(spark):
    R.register_sql(spark)
    r = spark.sql("SELECT is_correction('not what I asked') AS a, is_correction('fine') AS b, is_refusal('I''m sorry') AS c, model_family('gpt-4-0125-preview') AS d, monday(TIMESTAMP '2024-03-06 10:00:00') AS e").first()
    assert (r["a"], r["b"], r["c"], r["d"], str(r["e"])) == (True, False, True, "gpt-4", "2024-03-04")


def test_rules_as_sql_functions(spark):
    from turnlytics.functions import rules

    rules.register_sql(spark)
    r = spark.sql("SELECT is_repeat('sum the list', 'Sum the list please') a, is_repeat(NULL, 'x') b, is_repeat('one two', 'three') c, is_repeat('', '') d, is_correction('That’s wrong') e, is_correction('no problem, thanks') f, is_refusal('I can’t help with that') g, model_family('gpt-4o-2024-05-13') h").first()
    assert tuple(r) == (True, False, False, False, True, False, True, "gpt-4o")


def test_catalogue_lists_tables_with_columns(spark):
    from turnlytics.operators import checks

    got = checks.catalogue({"b": spark.range(1), "a": spark.sql("SELECT 1 x, 'y' z")}, spark).collect()
    assert [tuple(r) for r in got] == [("a", "x, z"), ("b", "id")]


def test_release_suffixes_go_however_many_there_are(spark):
    assert evaluate(spark, ["m-2024-01-01-0613-preview", "m-preview-0613-2024-01-01-0125", "preview", "0613-m"], R.model_family) == ["m", "m", "preview", "0613-m"]


def test_reasons_know_the_white_space_of_unicode(spark):
    frame = spark.createDataFrame([("repeat", "\u3000I'm sorry, but I can't help with that.", "x", "y"), ("correction", "fine", "\u2003no, that\u00a0is wrong", None)], "failure string, bad string, said string, before string")
    got = [r[0] for r in frame.select(reasons.reason_of(F.col("failure"), F.col("bad"), F.col("said"), F.col("before"))).collect()]
    assert got[0] == "refused" and frame.select(R.is_refusal(F.col("bad"))).first()[0]


def test_each_text_is_cut_into_words_once(spark):
    frame = spark.createDataFrame([("one two", "two one")], "a string, b string").select(R.is_repeat(F.col("a"), F.col("b")).alias("r"))
    assert frame._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2
    assert frame.first()["r"]

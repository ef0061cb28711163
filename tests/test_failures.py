"""First failures are found within the row."""

from pyspark.sql import functions as F

from turnlytics.operators import turns as T
from turnlytics.plans import analysis, core

SF = "/root/testdata/sf0.001"
FAILURE = ["conv_id", "idx", "failure", "bad_reply", "user_feedback", "prev_request", "attributed_to"]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def key(frame):
    return sorted(tuple(map(str, r)) for r in frame.collect())


def chats(spark):
    rows = [
        (1, [("user", "draw a cat", None), ("assistant", "b", "p"), ("user", "a dog", None), ("user", "no, that is wrong", None), ("assistant", "d", ""), ("user", "no, that is wrong", None)], "m"),
        (2, [("user", "no, that is wrong", None), ("user", "no, that is wrong", None)], "m"),  # no reply before
        (3, [("assistant", "hi", None), ("user", "try again", None)], None),  # nobody known, no request before
        (4, [("user", None, None), ("assistant", None, "q"), ("user", None, None), ("assistant", "w", "q"), ("user", "sort the list", None), ("assistant", "x", None), ("user", "sort the list", None)], "m"),
        (5, [], "m"), (6, [("assistant", "z", "r"), ("assistant", "y", None), ("user", "u", None)], "m"),
        (7, [("user", "sort the list", None), ("assistant", "z", "r"), ("user", "sort the list please", None), ("user", "not what I asked", None)], "m"),
    ]
    nested = spark.createDataFrame([(m, "s", [(i, *x, "en", False) for x in c]) for i, c, m in rows], "model string, shard string, conversation array<struct<turn_identifier:long,role:string,content:string,responder:string,language:string,redacted:boolean>>")
    messages = spark.createDataFrame([(i, k, *x, m) for i, c, m in rows for k, x in enumerate(c, 1)], "conv_id long, idx int, role string, content string, responder string, model string")
    return nested, T.attribute_turns(messages, F.col("model"))


def test_failures_of_the_row_equal_those_of_turns(spark):
    nested, turns = chats(spark)
    got, want = T.nested_failures(nested), T.first_failures(turns)
    assert key(got.select(FAILURE)) == key(want.select(FAILURE)) and got.count() == 4
    opening = {r["conv_id"]: r["opening"] for r in got.collect()}
    assert opening == {1: "draw a cat", 3: "try again", 4: None, 7: "sort the list"}
    replied = turns.where("role <> 'user' AND attributed_to IS NOT NULL").select("conv_id", F.col("attributed_to").alias("responder")).distinct()
    assert key(T.nested_responders(nested)) == key(replied)


def test_failures_exchange_no_texts(spark):
    x = core.Chat(spark, SF)
    for frame in (x.failures, T.nested_responders(x.shards(x.nested)), analysis.QUERIES["first_failures"](spark, SF)):
        assert "Exchange hashpartitioning" not in plan(frame) and "SortAggregate" not in plan(frame)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = [x for x in plan(analysis.QUERIES["failure_case_reasons"](spark, SF)).splitlines() if "Exchange hashpartitioning" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(lines) == 2  # the join with intents, of rows without texts


def test_context_of_the_row_equals_that_of_turns(spark):
    nested, turns = chats(spark)
    messages = nested.select(F.col("conversation")[0]["turn_identifier"].alias("conv_id"), F.posexplode("conversation").alias("pos", "m")).select("conv_id", (F.col("pos") + 1).alias("idx"), "m.role", "m.content")
    got, want = T.nested_context(nested), T.case_context(messages, T.first_failures(turns))
    assert key(got) == key(want) and got.count() == 4
    assert {r["conv_id"]: [m["idx"] for m in r["context"]] for r in got.collect()} == {1: [1], 3: [], 4: [1, 2, 3, 4, 5], 7: [1]}


def test_context_broadcasts_no_messages(spark):
    """Files of repeated texts are small; taken by their size, all messages went to every executor."""
    text = plan(analysis.QUERIES["case_context"](spark, SF))
    assert "Exchange hashpartitioning" not in text and text.count("BroadcastExchange") <= 1  # the nations of the attributes
    x = core.Chat(spark, SF)
    assert "SortMergeJoin" in plan(T.case_context(x.messages, x.failures))

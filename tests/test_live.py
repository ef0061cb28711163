"""Friction of a stream: equal to the batch operators, whatever the order of messages and batches; late messages are counted."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnlytics.operators import turns as T
from turnlytics.streaming import live

SCHEMA = "conv_id long, ts timestamp, idx int, role string, content string, responder string, model string"
TEXTS = ["write a poem about the sea", "write a poem about the sea please", "no, that is wrong", "", "fine", "I'm sorry, but I can't help with that.", None, "thanks"]


def messages(n=40):
    rng = random.Random(3)
    rows = []
    for c in range(n):
        for i in range(1, rng.randrange(2, 9)):
            role = rng.choice(["user", "user", "assistant"])
            rows.append((c, f"2024-03-{4 + c % 20:02d} 10:00:{i:02d}", i, role, rng.choice(TEXTS), rng.choice([None, "", "planner", "writer"]) if role == "assistant" else None, "m" if c % 5 else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))


def run(spark, tmp_path, batches, **options):
    """Each list of rows is a file, and so a batch."""
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(frame(spark, batches[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    live.run_live(live.live_conversations(stream, **options), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    return live.latest_conversations(spark, f"file://{tmp_path}/out")


@pytest.mark.parametrize("seed", [0, 1])
def test_any_order_gives_what_the_batch_gives(spark, tmp_path, seed):
    rows = messages()
    random.Random(seed).shuffle(rows)
    size = -(-len(rows) // 4)
    got = run(spark, tmp_path, [rows[k : k + size] for k in range(0, len(rows), size)], delay_ms=100 * 86_400_000)
    columns = ["conv_id", "n_turns", "has_empty_user_input", "repeated_request", "correction_followup", "assistant_refusal", "one_and_done"]
    turns = T.attribute_turns(frame(spark, rows), F.col("model"))
    want = T.roll_up(turns).na.fill(False, ["has_empty_user_input"]).select(*columns)
    key = lambda f: sorted(tuple(r) for r in f.select(*columns).collect())
    assert key(got) == key(want)
    charges = T.responder_charges(turns).groupBy("conv_id", "responder").agg(F.count_if("reply").alias("n"), F.count_if("is_correction").alias("c"), F.count_if("repeats_prev_user").alias("r"))
    flat = got.select("conv_id", F.explode(F.arrays_zip("responders", "replies", "corrections", "repeats")).alias("x")).select("conv_id", "x.*")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, charges.collect()))
    assert live.late_rows(spark, f"file://{tmp_path}/out").count() == 0


def test_a_message_sent_twice_counts_once(spark, tmp_path):
    row = (1, "2024-03-04 10:00:00", 1, "user", "write a poem about the sea", None, "m")
    got = run(spark, tmp_path, [[row], [row, (1, "2024-03-04 10:00:01", 2, "assistant", "x" * 300, None, "m")]]).first()
    assert (got["n_turns"], got["repeated_request"], got["one_and_done"], got["replies"]) == (1, False, False, [1])


def test_late_messages_are_counted_and_change_nothing(spark, tmp_path):
    at = lambda day, c, i, text: (c, f"2024-{day} 10:00:00", i, "user", text, None, "m")
    batches = [[at("03-04", 1, 1, "write a poem about the sea")], [at("06-04", 2, 1, "fine")], [at("06-05", 3, 1, "fine")], [at("06-05", 4, 1, "x")], [at("03-04", 1, 2, "no, that is wrong"), at("03-04", 1, 3, "thanks")], [at("06-06", 2, 2, "no, wrong")]]
    got = {r["conv_id"]: r for r in run(spark, tmp_path, batches, delay_ms=3_600_000, horizon_ms=7 * 86_400_000).collect()}
    assert got[1]["n_turns"] == 1 and not got[1]["correction_followup"]
    assert got[2]["n_turns"] == 2 and got[2]["correction_followup"] and str(got[2]["week"]) == "2024-06-03"
    assert len(got) == 4
    assert [tuple(r) for r in live.late_rows(spark, f"file://{tmp_path}/out").collect()] == [(1, 2)]


def test_a_conversation_crosses_to_python_as_one_text(spark):
    """Every column of a frame costs time for each conversation; a message is one text, nulls and all."""
    got = live.said(frame(spark, [(1, "2024-03-04 10:00:00", 1, "user", None, None, None)]))
    assert got.columns == ["conv_id", "ts", "at", "message"] and len(live.STATE.split(", ")) == 2
    assert json.loads(got.first()["message"]) == {"idx": 1, "user": True, "words": "", "flags": live.BLANK, "length": 0, "responder": None}


def test_conversations_of_a_bucket_keep_their_own_times(spark, tmp_path):
    """Few buckets give what many give: one conversation leaves its bucket while another goes on, and a bucket without news is cleared."""
    at = lambda day, c, i, text: (c, f"2024-{day} 10:00:00", i, "user", text, None, "m")
    batches = [[at("03-04", 1, 1, "a poem"), at("03-04", 2, 1, "fine")], [at("06-04", 2, 2, "no, wrong"), at("03-03", 2, 0, "a")], [at("06-05", 3, 1, "x")], [at("06-05", 2, 3, "try again")], [at("03-04", 1, 2, "no, that is wrong"), at("06-06", 2, 4, "thanks")]]
    for buckets in (1, 2048):
        path = tmp_path / str(buckets)
        got = {r["conv_id"]: (r["n_turns"], r["correction_followup"]) for r in run(spark, path, batches, delay_ms=3_600_000, buckets=buckets).collect()}
        assert got == {1: (1, False), 2: (5, True), 3: (1, False)}
        assert [tuple(r) for r in live.late_rows(spark, f"file://{path}/out").collect()] == [(1, 1)]


def test_states_are_fewer_than_conversations(spark, tmp_path):
    rows = [(c, "2024-03-04 10:00:00", 1, "user", "fine", None, "m") for c in range(500)]
    assert run(spark, tmp_path, [rows], buckets=8).count() == 500
    states = spark.read.format("statestore").load(f"file://{tmp_path}/checkpoint").count()
    assert states <= 8

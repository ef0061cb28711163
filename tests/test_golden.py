"""Six conversations in two weeks, whose metrics are known by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnlytics.functions import rules as R
from turnlytics.operators import metrics as M
from turnlytics.operators import turns as T
from turnlytics.schema import raw_shard
from turnlytics.sources import shards

D1, D2 = dt.datetime(2024, 3, 4, 10), dt.datetime(2024, 3, 12, 9)


def message(role, content, ident, usage=None):
    return (content, role, ident, None, None, None, "English", False, False, None, None, usage)


def conversation(ident, ts, model, user, turns, redacted=False, country="US", usage=None):
    messages = [message("user" if i % 2 == 0 else "assistant", t, ident, usage if i == 1 else None) for i, t in enumerate(turns)]
    return ("h", model, ts, (len(turns) + 1) // 2, "English", False, redacted, None, country, user, ("en", "ua"), messages)


ROWS = [
    conversation(1, D1, "gpt-4o-2024-05-13", "u1", ["write a poem about the sea", "Here.", "write a poem about the sea please", "I'm sorry, but I can't help with that.", "no, that is wrong", "x" * 300], usage=(10, 20, 30)),
    conversation(2, D1, "gpt-4o-2024-05-13", "u1", ["hello there", "Hi."], usage=(20, 40, 60)),
    conversation(3, D1, "gpt-4", "u2", ["", "What?"]),
    conversation(4, D2, "gpt-4o", "u1", ["sum these", "ok " * 20, "and these", "ok"], country=None),
    conversation(5, D2, "gpt-4o", "u2", ["translate it", "y" * 500], redacted=True),
    conversation(6, D2, "gpt-4-0125-preview", "u3", ["hi", "y" * 500]),
    ("h", "gpt-4", D2, 0, "English", False, False, None, "US", "u9", ("en", "ua"), []),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, raw_shard()).withColumn("shard", F.lit("s0"))


@pytest.fixture(scope="module")
def conversations(raw):
    return T.nested_roll_up(raw).withColumn("model_family", R.model_family(F.col("model"))).persist()


@pytest.fixture(scope="module")
def turns(raw):
    return T.attribute_turns(T.nested_messages(raw), F.col("model"))


def by(frame, *keys):
    return {tuple(str(r[k]) for k in keys) if len(keys) > 1 else str(r[keys[0]]): r for r in frame.collect()}


def test_conversations(conversations, turns):
    got = by(conversations, "conv_id")
    assert sorted(got) == list("123456") and turns.count() == 18
    one = got["1"]
    assert (one["repeated_request"], one["correction_followup"], one["assistant_refusal"], one["one_and_done"], one["n_turns"]) == (True, True, True, False, 3)
    assert (one["prompt_tokens"], one["completion_tokens"], one["first_user_len"], one["last_assistant_len"]) == (10, 20, 26, 300)
    assert one["intent_text"] == "write a poem about the sea\nwrite a poem about the sea please"
    assert got["2"]["one_and_done"] and not got["5"]["one_and_done"] and got["5"]["redacted"] and got["3"]["has_empty_user_input"]
    assert got["3"]["prompt_tokens"] is None and str(got["4"]["week"]) == "2024-03-11"
    assert got["1"]["pseudo_user"] == got["2"]["pseudo_user"] != got["3"]["pseudo_user"] and len(got["1"]["pseudo_user"]) == 16


def test_rows_and_nested_agree(conversations, turns):
    rows = by(T.roll_up(turns), "conv_id")
    for k, r in by(conversations, "conv_id").items():
        for c in ("n_turns", "has_empty_user_input", "first_user_len", "last_assistant_len", "repeated_request", "correction_followup", "assistant_refusal", "one_and_done", "intent_text"):
            assert rows[k][c] == r[c], (k, c)


def test_older_shards_without_usage(spark):
    old = spark.createDataFrame([(*r[:-1], [m[:-1] for m in r[-1]]) for r in ROWS], raw_shard(with_usage=False))
    assert T.nested_roll_up(old).where("prompt_tokens IS NOT NULL").count() == 0


def test_attribution(turns):
    got = by(turns.where("conv_id = 1"), "idx")
    assert [got[k]["attributed_to"] for k in "123"] == [None, "gpt-4o-2024-05-13", "gpt-4o-2024-05-13"]
    assert got["3"]["repeats_prev_user"] and got["5"]["is_correction"] and got["4"]["is_refusal"] and not got["1"]["repeats_prev_user"]


def test_attribution_of_responders(spark):
    rows = [(1, 1, "user", "a", None), (1, 2, "assistant", "b", "planner"), (1, 3, "user", "c", None), (1, 4, "user", "d", None), (1, 5, "assistant", "e", ""), (1, 6, "user", "f", None)]
    got = by(T.attribute_turns(spark.createDataFrame(rows, "conv_id long, idx int, role string, content string, responder string"), F.lit("m")), "idx")
    assert [got[str(k)]["attributed_to"] for k in range(1, 7)] == [None, "planner", "planner", "planner", "m", "m"]


def test_volume(conversations):
    got = by(M.volume_daily_model(conversations), "date", "model")["2024-03-04", "gpt-4o"]
    assert (got["conversations"], got["turns"], got["prompt_tokens"], got["completion_tokens"], got["conversations_with_tokens"]) == (2, 4, 30, 60, 2)
    small = by(M.volume_weekly_country(conversations, 20), "week", "country")
    assert small["2024-03-04", "small cells"]["conversations"] == 3 and small["2024-03-11", "not recorded"]["conversations"] == 1 and sum(r["conversations"] for r in small.values()) == 6
    every = by(M.volume_weekly_country(conversations, 1), "week", "country")["2024-03-04", "US"]
    assert (every["conversations"], every["pseudo_users"]) == (3, 2)


def test_intensity(conversations):
    got = by(M.intensity_weekly(conversations), "week")
    a, b = got["2024-03-04"], got["2024-03-11"]
    assert (a["pseudo_users"], a["conversations"], a["return_rate"], a["convs_per_user_p50"], a["next_week_present"]) == (2, 3, 1.0, 1.5, True)
    assert a["convs_per_user_p90"] == pytest.approx(1.9) and a["top10_share"] == pytest.approx(2 / 3)
    assert (b["pseudo_users"], b["return_rate"], b["next_week_present"]) == (3, None, False)
    r = M.persistence_quarterly(conversations).first()
    assert r["pseudo_users"] == 3 and r["avg_weeks_active"] == pytest.approx(5 / 3) and r["share_multi_week"] == pytest.approx(2 / 3)


def test_depth_and_quality(conversations):
    got = by(M.depth_by_model(conversations), "model", "depth_bucket")
    assert {k[1]: r["conversations"] for k, r in got.items() if k[0] == "gpt-4o"} == {"1": 2, "2": 1, "3-5": 1}
    q = by(M.data_quality_weekly(conversations), "week")
    assert q["2024-03-04"]["empty_input_rate"] == pytest.approx(1 / 3, abs=1e-6) and q["2024-03-11"]["redacted_rate"] == pytest.approx(1 / 3, abs=1e-6)
    f = by(M.friction_weekly(conversations), "week")["2024-03-04"]
    assert (f["conversations"], f["repeat_rate"], f["one_and_done_rate"]) == (2, 0.5, 0.5)


def test_metric_tables_are_free_of_content(conversations, turns):
    from turnlytics.operators.checks import content_free

    assert content_free(M.friction_weekly(conversations)) and content_free(M.friction_by_responder(turns, conversations, 1)) and not content_free(conversations)


def test_shards_are_chosen_by_position(conversations):
    assert shards.unfinished(conversations, conversations.where("conv_id = 1")).count() == 0
    assert shards.chosen_shards("0-1,3", list("dcba")) == ["a", "b", "d"] and shards.chosen_shards("all", ["b", "a"]) == ["a", "b"]

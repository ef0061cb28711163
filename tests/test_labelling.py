"""Labelling queries run on all conversations; sampling and intervals."""

import hashlib
import random

import duckdb

from turnlytics.plans import labelling
from turnlytics.plans.core import Chat

from .test_queries import TABLES, rows

SF = "/root/testdata/sf0.001"


def test_raters_and_survey_leave_no_conversation_out(spark):
    x = Chat(spark, SF)
    labelled, everyone = x.labelled.where("intent IS NOT NULL").count(), x.conversations.count()
    a, b = labelling.raters(x)
    assert (a.count(), b.count()) == (labelled, labelled)
    assert [f.count() for f in labelling.survey(x)] == [everyone, everyone]
    assert labelling.QUERIES["rater_agreement"](spark, SF).first()["n"] == labelled


def test_whole_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("rater_agreement", "rater_disagreements", "survey_score"):
        got, want = labelling.QUERIES[name](spark, SF).toArrow(), con.execute(labelling.ORACLE_SQL[name]).to_arrow_table()
        columns = sorted(want.column_names)
        assert columns == sorted(got.column_names)
        assert rows(got, columns) == rows(want, columns)


def test_draws_and_splits_equal_ranking_all_rows(spark):
    from pyspark.sql import functions as F

    from turnlytics.operators import sampling

    rows_in = [(i, "big" if i % 7 else None, i % 3) for i in range(4000)] + [(5000, "one", 0)]
    frame = spark.createDataFrame(rows_in, "conv_id long, label string, k3 int")
    order = {i: hashlib.md5(f"{i}:7".encode()).hexdigest() for i, _, _ in rows_in}
    by = {}
    for i, label, _ in rows_in:
        by.setdefault(label, []).append(i)
    want = {label: set(sorted(ids, key=lambda i: (order[i], i))[: int(len(ids) * 0.2)]) for label, ids in by.items()}
    got = sampling.split(frame, "label", "conv_id").collect()
    assert len(got) == len(rows_in) and {r["conv_id"] for r in got if r["is_test"]} == set().union(*want.values())
    sizes = spark.createDataFrame([("big", 37), (None, len(by[None])), ("one", 0)], "label string, k long")
    drawn = {r["conv_id"] for r in sampling.draw(frame, sizes, keys=["label"]).collect()}
    assert drawn == set(sorted(by["big"], key=lambda i: (order[i], i))[:37]) | set(by[None])
    assert sampling.split(frame.where(F.lit(False)), "label", "conv_id").count() == 0


def test_bootstrap_intervals_agree(spark):
    from turnlytics.operators import compare

    rng = random.Random(4)
    frame = spark.createDataFrame([(f"u{i}", "k", rng.random()) for i in range(800)], "user string, key string, x double")
    a = compare.bootstrap(frame, ["key"], "x", 1000).first()
    b = compare.exact_bootstrap(frame, ["key"], "user", "x", 1000).first()
    assert abs(a["ci_low"] - b["ci_low"]) < 0.004 and abs(a["ci_high"] - b["ci_high"]) < 0.004
    one = compare.bootstrap(spark.createDataFrame([("u", "k", 3.0)], "user string, key string, x double"), ["key"], "x").first()
    assert one["ci_low"] == one["ci_high"] == 3.0


def test_gates_stop_a_batch(spark, tmp_path):
    import pytest

    from turnlytics.operators import labels as L

    requests = spark.createDataFrame([(i, "x" * 400, 400) for i in range(100)], "conv_id long, request string, chars int")
    good = '{"intent": "coding", "confidence": "low"}'
    at = lambda name: f"file://{tmp_path}/{name}"
    assert L.label_batch(requests, lambda r: good, at("a"), 1.0, 1.0, budget=1.0, canary=10).count() == 100
    with pytest.raises(L.GateError, match="budget"):
        L.label_batch(requests, lambda r: good, at("b"), 1e6, 1e6, budget=1.0)
    with pytest.raises(L.GateError, match="parsed"):
        L.label_batch(requests, lambda r: "no idea", at("c"), canary=10)
    numbered = requests.selectExpr("conv_id", "cast(conv_id as string) AS request", "chars")

    def failing(request):
        if int(request) >= 50:
            raise RuntimeError("no connection")
        return good

    with pytest.raises(L.GateError, match="50 of 100 are labelled"):
        L.label_batch(numbered, failing, at("d"), canary=10)
    assert L.label_batch(numbered, failing, at("e"), canary=10, least_labelled=0.5).count() == 50
    assert L.label_batch(requests.limit(0), failing, at("f")).count() == 0

"""Bootstrap over histograms: draws have the right distribution, intervals those of drawing value by value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlytics.operators import compare as K


def test_intervals_are_those_of_drawing_with_replacement(spark):
    rng = np.random.default_rng(5)
    sides = {"a": rng.choice([-0.5, 0.0, 0.25, 1.0], 900, p=[0.2, 0.5, 0.2, 0.1]), "b": rng.choice([0.0, 1.0], 700, p=[0.9, 0.1])}
    values = spark.createDataFrame([(s, float(v)) for s, x in sides.items() for v in x], "side string, v double")
    got = {r["side"]: (r["ci_low"], r["ci_high"]) for r in K.bootstrap(values, ["side"], "v", 4000).collect()}
    for s, x in sides.items():
        means = [x[rng.integers(0, len(x), len(x))].mean() for _ in range(4000)]
        assert got[s] == pytest.approx(np.percentile(means, [2.5, 97.5]), abs=0.25 * x.std() / len(x) ** 0.5)
    again = {r["side"]: (r["ci_low"], r["ci_high"]) for r in K.bootstrap(values.repartition(7), ["side"], "v", 4000).collect()}
    assert all(again[s] == pytest.approx(got[s]) for s in got)


@pytest.mark.parametrize("m", [1, 5, 64, 65, 700])
def test_draws_of_equal_values_are_poisson(spark, m):
    """The table is that of the distribution; the mean of equally many ones and zeros spreads as a ratio of two such draws."""
    rows = spark.createDataFrame([(1.0,)] * m, "x double")
    table = K.histogram(rows, [], "x").withColumn("t", K.poisson_table(F.least("m", F.lit(K.POISSON_TABLE)))).first()
    if m <= K.POISSON_TABLE:
        from math import exp, factorial

        want = np.cumsum([exp(-m) * m**k / factorial(k) for k in range(len(table["t"]))])
        assert table["t"] == pytest.approx(want) and table["t"][-1] == pytest.approx(1, abs=1e-8)
    two = spark.createDataFrame([(1.0,)] * m + [(0.0,)] * m, "x double").withColumn("k", F.lit("k"))
    means = np.array([r["m"] for r in K.resampled_means(two, ["k"], "x", 4000).collect() if r["m"] is not None])
    assert means.mean() == pytest.approx(0.5, abs=4 * means.std() / 60)
    if m >= 64:  # a ratio of two Poisson draws of mean m: standard deviation about 1 / sqrt(8 m)
        assert means.std() == pytest.approx((1 / (8 * m)) ** 0.5, rel=0.06)


def test_a_repetition_draws_once_per_distinct_value(spark):
    values = spark.range(30_000).select((F.col("id") % 3).cast("double").alias("v"), F.lit("k").alias("k"))
    means = K.resampled_means(values, ["k"], "v", 50)
    means.collect()
    text = means._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate explode") < text.index("functions=[count") or text.index("Generate") < text.rindex("HashAggregate")
    histogram = K.histogram(values, ["k"], "v").collect()
    assert sorted((r["x"], r["m"]) for r in histogram) == [(0.0, 10_000), (1.0, 10_000), (2.0, 10_000)]


def test_nulls_and_empty_values(spark):
    rows = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None)], "k string, v double")
    got = {r["k"]: (r["ci_low"], r["ci_high"]) for r in K.bootstrap(rows, ["k"], "v", 200).collect()}
    assert got == {"b": (1.0, 1.0)}
    assert K.bootstrap(rows.where("false"), ["k"], "v", 200).count() == 0


def test_repetitions_are_dealt_over_tasks_and_hashed_once(spark):
    values = spark.range(300).select((F.col("id") % 3).cast("double").alias("v"), F.lit("k").alias("k"))
    means = K.resampled_means(values, ["k"], "v", 4000)
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence(") < plan.index("RepartitionByExpression [k")  # the draws come after the exchange
    draws = next(line for line in plan.splitlines() if "filter(table" in line)
    assert "md5" not in draws  # not once per entry of the table
    assert sorted(r["rep"] for r in means.collect()) == list(range(4000))

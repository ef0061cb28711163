"""Comparisons that hold the person fixed, with bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_MATCHED = 30

#: Up to this many equal values, Poisson draws come from cumulative probabilities; beyond, from a corrected normal one.
POISSON_TABLE = 64
DECIMALS = 12

#: Repetitions are dealt over so many tasks.
BLOCKS = 64


def hash_index(key: Column, n: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), n)


def sides(rows: DataFrame, comparisons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tags rows with the side they take in each comparison: (keys..., side_a, side_b) against (model, ...)."""
    joined = rows.join(F.broadcast(comparisons), [k for k in keys if k in rows.columns] or None)  # a handful of comparisons
    side = F.when(F.col("model") == F.col("side_a"), "a").when(F.col("model") == F.col("side_b"), "b")
    return joined.withColumn("side", side).where("side IS NOT NULL")


def naive_gap(tagged: DataFrame, keys: Sequence[str], metric: Column) -> DataFrame:
    of = lambda s, c: F.avg(F.when(F.col("side") == s, c.cast("int")))
    n = lambda s: F.count_if(F.col("side") == s)
    out = tagged.groupBy(*keys).agg(n("a").alias("n_a"), n("b").alias("n_b"), of("a", metric).alias("naive_a"), of("b", metric).alias("naive_b"))
    return out.withColumn("naive_gap", F.col("naive_a") - F.col("naive_b"))


def per_user(tagged: DataFrame, keys: Sequence[str], user: str, metric: Column) -> DataFrame:
    """Each user's rate on either side, for users seen on both; users weigh the same."""
    of = lambda s: F.avg(F.when(F.col("side") == s, metric.cast("int")))
    return tagged.groupBy(*keys, user).agg(of("a").alias("ra"), of("b").alias("rb")).where("ra IS NOT NULL AND rb IS NOT NULL").withColumn("diff", F.col("ra") - F.col("rb"))


def matched_gap(users: DataFrame, keys: Sequence[str]) -> DataFrame:
    return users.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched_users"), F.avg("ra").alias("matched_a"), F.avg("rb").alias("matched_b"), F.avg("diff").alias("matched_gap"))


def histogram(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, x, code, m: how often each value occurs; values are told apart to twelve decimals."""
    code = F.round(F.col(value) * 10.0**DECIMALS).cast("long")
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, code.alias("code")).agg(F.count(F.lit(1)).alias("m"))
    return counts.withColumn("x", F.col("code") / 10.0**DECIMALS)


def poisson_table(m: Column) -> Column:
    """Cumulative probabilities of a Poisson(m) variable from 0 on, up to where hardly anything is left."""
    start = F.struct(F.exp(-m.cast("double")).alias("p"), F.exp(-m.cast("double")).alias("sum"), F.array().cast("array<double>").alias("all"))
    most = (m + 10 * F.ceil(F.sqrt(m)) + 10).cast("int")
    step = lambda s, k: F.struct((s["p"] * m / k).alias("p"), (s["sum"] + s["p"] * m / k).alias("sum"), F.array_append(s["all"], s["sum"]).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step)["all"]


def uniform(text: Column, start: int = 1) -> Column:
    """A number from 0 on below 1 that follows from a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), start, 8), 16, 10).cast("long") / float(1 << 32)


def resampled_means(values: DataFrame, keys: Sequence[str], value: str, reps: int) -> DataFrame:
    """keys, rep, m: the mean of each repetition of a bootstrap.

    A value that occurs m times counts as often as a Poisson(m) draw says, which is what m values that count Poisson(1) times come to,
    and in the mean what drawing with replacement comes to for more than a few values.  So a repetition makes a draw for each
    distinct value, not for each value.  Draws follow hashes of (keys, value, repetition), so a rerun gives the same.
    """
    values = histogram(values, keys, value)  # few rows, but each is drawn ``reps`` times: dealt by blocks of repetitions, as a task would else draw all
    size = -(-reps // BLOCKS)
    rows = values.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // size)))).repartition(BLOCKS, *keys, "block")
    table = F.when(F.col("m") <= POISSON_TABLE, poisson_table(F.least("m", F.lit(POISSON_TABLE))))
    first = F.col("block") * size
    rows = rows.withColumn("table", table).withColumn("rep", F.explode(F.sequence(first, F.least(first + size, F.lit(reps)) - 1)))
    rows = rows.withColumn("text", F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.col("code").cast("string"), F.col("rep").cast("string")))
    rows = rows.withColumns({"u": uniform(F.col("text")), "v": F.when(F.col("m") > POISSON_TABLE, uniform(F.col("text"), 9))})  # columns of their own: within ``filter`` they would be hashed anew for every entry of the table
    u, v = F.col("u"), F.col("v")
    z = F.sqrt(-2 * F.log(u + 2.0**-33)) * F.cos(2 * math.pi * v)
    far = F.greatest(F.floor(F.col("m") + F.sqrt("m") * z + (z * z - 1) / 6 + 0.5), F.lit(0))
    weight = F.when(F.col("m") <= POISSON_TABLE, F.size(F.filter("table", lambda p: p <= u))).otherwise(far)
    rows = rows.withColumn("w", weight.cast("double"))
    return rows.groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("m"))


def interval(means: DataFrame, keys: Sequence[str], value: str = "m", out: tuple[str, str] = ("ci_low", "ci_high")) -> DataFrame:
    """The middle 95 % of the repetitions; a row per repetition comes in."""
    return means.groupBy(*keys).agg(F.percentile(value, 0.025).alias(out[0]), F.percentile(value, 0.975).alias(out[1]))


def bootstrap(values: DataFrame, keys: Sequence[str], value: str, reps: int = 4000, out: tuple[str, str] = ("ci_low", "ci_high")) -> DataFrame:
    """Percentile interval of the mean by resampling."""
    return interval(resampled_means(values, keys, value, reps), keys, out=out)


def exact_bootstrap(values: DataFrame, keys: Sequence[str], order: str, value: str, reps: int, out: tuple[str, str] = ("ci_low", "ci_high"), salt: str = "") -> DataFrame:
    """The interval by drawing as many values as there are, with replacement; draws follow hashes of (rep, slot).

    For some thousands of values per key: it numbers a key's values in one task and makes values times reps slots.
    """
    line = Window.partitionBy(*keys).orderBy(order)
    numbered = values.select(*keys, F.col(value).alias("x"), (F.row_number().over(line) - 1).cast("long").alias("i"))
    counts = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    slots = counts.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    drawn = slots.withColumn("i", hash_index(F.concat(F.lit(salt), F.col("rep"), F.lit(":"), F.col("slot")), F.col("n")))
    means = drawn.join(numbered, [*keys, "i"]).groupBy(*keys, "rep").agg(F.avg("x").alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", 0.025).alias(out[0]), F.percentile("m", 0.975).alias(out[1]))


def excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def model_verdict(rows: DataFrame) -> DataFrame:
    """real, mix, none or overlap (too few people on both sides)."""
    enough = F.col("matched_users") >= MIN_MATCHED
    mix = (F.abs("naive_gap") >= 0.03) & (F.abs("matched_gap") < F.abs("naive_gap") / 3)
    key = F.when(~F.coalesce(enough, F.lit(False)), "overlap").when(excludes_zero(F.col("ci_low"), F.col("ci_high")), "real").when(mix, "mix").otherwise("none")
    return rows.withColumn("verdict", key)


def pair_verdict(rows: DataFrame) -> DataFrame:
    """For published pairs: real, flip (the sign turns for the same people) or mix."""
    real = excludes_zero(F.col("ci_low"), F.col("ci_high"))
    flip = real & (F.signum("naive_gap") != F.signum("matched_gap"))
    return rows.withColumn("pair_verdict", F.when(flip, "flip").when(real, "real").otherwise("mix"))


def version_changes(rows: DataFrame) -> DataFrame:
    """The first time of each version after the first, with the one before it."""
    first = rows.where("version IS NOT NULL AND ts IS NOT NULL").groupBy("version").agg(F.min("ts").alias("at"))
    line = Window.orderBy("at", "version")  # a row per version
    return first.withColumn("previous", F.lag("version").over(line)).where("previous IS NOT NULL").select("version", "previous", "at")


def change_verdict(rows: DataFrame, lower_is_better: bool = True) -> DataFrame:
    """Adds the least detectable effect (in points) and none, real, worse, trend (a placebo shows the same shift) or overlap."""
    clear = excludes_zero(F.col("ci_low"), F.col("ci_high"))
    placebo = F.coalesce(excludes_zero(F.col("placebo_low"), F.col("placebo_high")) & (F.signum("placebo_gap") == F.signum("matched_gap")), F.lit(False))
    nothing = (F.col("naive_a") == 0) & (F.col("naive_b") == 0)
    worse = (F.col("matched_gap") > 0) if lower_is_better else F.lit(False)
    key = F.when(nothing, "none").when(F.col("matched_users") < MIN_MATCHED, "overlap").when(~clear, "none").when(placebo, "trend").when(worse, "worse").otherwise("real")
    return rows.withColumns({"mde_points": (F.col("ci_high") - F.col("ci_low")) / (2 * 1.96) * 2.8 * 100, "verdict": key})

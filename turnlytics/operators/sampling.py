"""Stratified sampling of conversations for labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlytics.functions import rules as R

STRATUM = ["model_family", "lang_bucket", "quarter"]


def eligible(conversations: DataFrame, least: int = 5) -> DataFrame:
    return conversations.where(~F.col("has_empty_user_input") & (F.length("intent_text") >= least))


def strata(conversations: DataFrame, top: int = 8) -> DataFrame:
    """Model family by language (the most frequent ones, else "other") by quarter."""
    rows = eligible(conversations)
    best = rows.where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(top)
    rows = rows.join(F.broadcast(best.select("language", F.col("language").alias("lang_bucket"))), "language", "left")  # ``top`` rows
    return rows.select("conv_id", "model_family", F.coalesce("lang_bucket", F.lit("other")).alias("lang_bucket"), R.quarter_of(F.to_date("ts")).alias("quarter"), "intent_text")


def allocate(sizes: DataFrame, n: int, floor: int, keys: list[str] | None = None) -> DataFrame:
    """Adds ``k``: how many to draw of each stratum (column ``size``); a row per stratum, so the windows are small.

    Proportional, at least the floor (lowered if all floors exceed n), at most the stratum; what exceeds n is cut from the
    largest first, ties by key.
    """
    keys = keys or STRATUM
    whole = Window.partitionBy()
    m, total, size = F.count(F.lit(1)).over(whole), F.sum("size").over(whole), F.col("size")
    least = F.when(F.lit(floor) * m > n, F.greatest(F.lit(1), F.floor(F.lit(n) / m))).otherwise(floor).cast("long")
    rows = sizes.withColumns({"least": least, "share": F.bround(F.lit(n) * size / total, 0).cast("long")})
    rows = rows.withColumn("wanted", F.least(F.greatest("least", "share"), size))
    rows = rows.withColumns({"spare": F.greatest(F.lit(0), F.col("wanted") - F.least("least", "size")), "over": F.sum("wanted").over(whole) - n})
    line = Window.orderBy(F.desc("wanted"), *keys).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("spare").over(line), F.lit(0))
    k = F.col("wanted") - F.least("spare", F.greatest(F.col("over") - before, F.lit(0)))
    return rows.withColumn("k", k).select(*keys, "size", "k")


def hash_order(ident: Column, seed: int) -> Column:
    return F.md5(F.concat(ident.cast("string"), F.lit(f":{seed}")).cast("binary"))


PREFIX = 4  # hexadecimal digits: 65,536 ranges of hashes


def _first_in_hash_order(rows: DataFrame, keys: list[str], ident: str, seed: int, k: Column, carried: DataFrame | None = None) -> DataFrame:
    """Adds ``taken``: is the row among its group's first ``k`` in hash order?

    ``k`` is an expression of the group's ``total`` and of the columns that ``carried`` (a row per group) adds.  Rows are counted per
    group and range of hashes; one range of each group holds the border, and only its rows are ranked.  So no task holds a
    whole group, and what the windows see has a row per range.
    """
    rows = rows.withColumn("__hash", hash_order(F.col(ident), seed)).withColumn("__range", F.left("__hash", F.lit(PREFIX)))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys]
    counts = rows.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys)
    counts = counts.withColumns({"before": F.sum("n").over(group.orderBy("__range")) - F.col("n"), "total": F.sum("n").over(group)})
    if carried is not None:
        counts = counts.alias("r").join(F.broadcast(carried).alias("c"), same("r", "c")).select("r.*", *(F.col(f"c.{c}") for c in carried.columns if c not in keys))  # a row per group
    border = counts.withColumn("k", k).where("before < k AND k <= before + n").select(*keys, F.col("__range").alias("border"), (F.col("k") - F.col("before")).alias("rest"))
    tagged = rows.alias("r").join(F.broadcast(border).alias("b"), same("r", "b"), "left").select("r.*", "border", "rest")  # a row per group
    place = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy("__hash", ident))
    at = tagged.where(F.col("__range") == F.col("border")).withColumn("taken", place <= F.col("rest"))
    other = tagged.where(~F.coalesce(F.col("__range") == F.col("border"), F.lit(False))).withColumn("taken", F.coalesce(F.col("__range") < F.col("border"), F.lit(False)))
    return at.unionByName(other).drop("__hash", "__range", "border", "rest")


def draw(rows: DataFrame, allocation: DataFrame, seed: int = 7, keys: list[str] | None = None) -> DataFrame:
    """The first k of each stratum in hash order: a rerun, or another partitioning, draws the same."""
    keys = keys or STRATUM
    return _first_in_hash_order(rows, keys, "conv_id", seed, F.col("c_k"), allocation.select(*keys, F.col("k").alias("c_k"))).where("taken").drop("taken")


def split(rows: DataFrame, label: str, ident: str, share: float = 0.2, seed: int = 7) -> DataFrame:
    """Marks the test part of each label."""
    return _first_in_hash_order(rows, [label], ident, seed, F.floor(F.col("total") * share)).withColumnRenamed("taken", "is_test")


def labelling_export(turns: DataFrame, n: int = 300, most_turns: int = 6, reply_chars: int = 400, seed: int = 7) -> DataFrame:
    """Conversations of 1 to ``most_turns`` non-empty user turns, both sides' texts joined, in hash order."""
    user = F.col("role") == "user"
    rows = turns.groupBy("conv_id").agg(F.count_if(user).alias("n_turns"), F.bool_or(user & F.col("is_empty")).alias("has_empty"), F.array_sort(F.collect_list(F.struct("idx", "role", "content"))).alias("m"))
    rows = rows.where(~F.col("has_empty") & F.col("n_turns").between(1, most_turns))
    texts = lambda keep, size: F.array_join(F.transform(F.filter("m", keep), lambda x: F.left(x["content"], F.lit(size))), " ||| ")
    rows = rows.select("conv_id", "n_turns", texts(lambda x: x["role"] == "user", 1 << 30).alias("user_texts"), texts(lambda x: x["role"] != "user", reply_chars).alias("replies"))
    return rows.orderBy(hash_order(F.col("conv_id"), seed)).limit(n)

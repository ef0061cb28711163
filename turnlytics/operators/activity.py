"""Activity of users as bitmaps of weeks, so that new shards update return and persistence without reading old ones.

A user has a row per 64 weeks; a bit stands for a week with a conversation.  Bitmaps of two sets of conversations merge by OR, in any
order and however often: a shard that is merged twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlytics.functions import rules as R

WEEKS = 64


def week_number(week: Column) -> Column:
    """Weeks since the Monday 1970-01-05, of a Monday."""
    return F.floor((F.unix_date(week) - 4) / 7)


def week_of(number: Column) -> Column:
    return F.date_from_unix_date((number * 7 + 4).cast("int"))


def week_bits(conversations: DataFrame, user: str = "pseudo_user") -> DataFrame:
    """user, word, bits: the weeks in which a user has conversations (column ``week``)."""
    n = week_number(F.col("week"))
    rows = conversations.where(F.col(user).isNotNull() & F.col("week").isNotNull()).select(F.col(user).alias("user"), F.floor(n / WEEKS).alias("word"), F.pmod(n, F.lit(WEEKS)).cast("int").alias("bit"))
    return rows.groupBy("user", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def merged(*parts: DataFrame) -> DataFrame:
    """The bitmaps of all parts together."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("user", "word").agg(F.bit_or("bits").alias("bits"))


def active_weeks(bits: DataFrame) -> DataFrame:
    """user, week, comes_back: a row per user and active week, and whether the next week is active too.

    The week after a word's last one is the first bit of the user's next word; words are few per user.
    """
    line = Window.partitionBy("user").orderBy("word")
    follows = (F.lead("word").over(line) == F.col("word") + 1) & (F.lead("bits").over(line).bitwiseAND(F.lit(1).cast("long")) != 0)
    rows = bits.withColumn("carried", F.coalesce(follows, F.lit(False)))
    is_set = lambda n: F.expr(f"getbit(bits, {n})") == 1
    rows = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(WEEKS - 1)))).where(is_set("bit"))
    comes_back = F.when(F.col("bit") == WEEKS - 1, F.col("carried")).otherwise(is_set(f"least(bit + 1, {WEEKS - 1})"))
    return rows.select("user", week_of(F.col("word") * WEEKS + F.col("bit")).alias("week"), comes_back.alias("comes_back"))


def weekly_return(bits: DataFrame) -> DataFrame:
    """week, pseudo_users, next_week_present, return_rate (null where the next week has no data)."""
    weekly = active_weeks(bits).groupBy("week").agg(F.count(F.lit(1)).alias("pseudo_users"), F.count_if("comes_back").alias("back"))
    there = F.coalesce(F.lead("week").over(Window.orderBy("week")) == F.date_add("week", 7), F.lit(False))  # a row per week
    return weekly.withColumn("next_week_present", there).select("week", "pseudo_users", "next_week_present", F.when(F.col("next_week_present"), F.col("back") / F.col("pseudo_users")).alias("return_rate"))


def persistence(bits: DataFrame) -> DataFrame:
    """quarter, pseudo_users, avg_weeks_active, share_multi_week."""
    users = active_weeks(bits).groupBy(R.quarter_of(F.col("week")).alias("quarter"), "user").agg(F.count(F.lit(1)).alias("weeks"))
    return users.groupBy("quarter").agg(F.count(F.lit(1)).alias("pseudo_users"), F.avg("weeks").alias("avg_weeks_active"), R.rate(F.col("weeks") > 1).alias("share_multi_week"))


def spans(bits: DataFrame) -> DataFrame:
    """user, first_week, last_week, weeks: from the bitmaps alone."""
    low, high = F.min(F.struct("word", "bits")), F.max(F.struct("word", "bits"))
    rows = bits.groupBy("user").agg(low.alias("low"), high.alias("high"), F.sum(F.bit_count("bits")).alias("weeks"))
    first = F.aggregate(F.sequence(F.lit(WEEKS - 1), F.lit(0), F.lit(-1)), F.lit(0), lambda a, b: F.when(F.getbit(F.col("low.bits"), b) == 1, b).otherwise(a))
    last = F.aggregate(F.sequence(F.lit(0), F.lit(WEEKS - 1)), F.lit(0), lambda a, b: F.when(F.getbit(F.col("high.bits"), b) == 1, b).otherwise(a))
    return rows.select("user", week_of(F.col("low.word") * WEEKS + first).alias("first_week"), week_of(F.col("high.word") * WEEKS + last).alias("last_week"), F.col("weeks").cast("long").alias("weeks"))

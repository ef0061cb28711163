"""Weekly series: spines, zero filling, gaps, windows, handoffs and recent changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlytics.functions import rules as R

from .metrics import count_rows, intensity


def span(rows: DataFrame, day: str = "date") -> DataFrame:
    """One row: first and last day, first and last complete week."""
    first, last = R.complete_weeks(F.col("first_day"), F.col("last_day"))
    return rows.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).withColumns({"first_week": first, "last_week": last})


def spine(bounds: DataFrame, first: str = "first_week", last: str = "last_week") -> DataFrame:
    """A row per week; bounded by the length of the log, not by its size."""
    return bounds.where(F.col(first).isNotNull()).select(F.explode(F.sequence(first, last, F.expr("interval 7 days"))).alias("week"))


def complete(rows: DataFrame, bounds: DataFrame, week: str = "week") -> DataFrame:
    return rows.join(F.broadcast(bounds.select("first_week", "last_week")), F.col(week).between(F.col("first_week"), F.col("last_week"))).drop("first_week", "last_week")  # one row


def zero_filled(counts: DataFrame, weeks: DataFrame, key: str, value: str) -> DataFrame:
    """Every key in every week of the spine, 0 where it has none.  Keys times weeks: both are small cuts."""
    grid = counts.select(key).distinct().join(F.broadcast(weeks))
    return grid.join(counts, [key, "week"], "left").select(key, "week", F.coalesce(value, F.lit(0)).alias(value))


def rate_gaps(rates: DataFrame, weeks: DataFrame, key: str, value: str) -> DataFrame:
    """Weeks between a key's first and last one in which it has no rate, with the rates on either side of the gap."""
    ends = rates.groupBy(key).agg(F.min("week").alias("w0"), F.max("week").alias("w1"))
    grid = ends.join(F.broadcast(weeks), F.col("week").between(F.col("w0"), F.col("w1"))).select(key, "week")
    line = Window.partitionBy(key).orderBy("week")
    rows = grid.join(rates.select(key, "week", value), [key, "week"], "left")
    rows = rows.withColumns({
        "before": F.last(value, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.first(value, ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)),
        "island": F.count(value).over(line),
    })
    return rows.where(F.col(value).isNull()).select(key, "week", "before", "after", "island")


def outage_weeks(counts: DataFrame, weeks: DataFrame) -> DataFrame:
    return weeks.join(counts.select("week").distinct(), "week", "left_anti")


def windows_of(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.countDistinct("week").alias("active_weeks"))


def handoffs(windows: DataFrame, key: str) -> DataFrame:
    """For each week, which keys begin and which end in it."""
    ends = windows.unpivot([key], ["first_week", "last_week"], "end", "week")
    names = lambda e: F.array_join(F.array_sort(F.collect_list(F.when(F.col("end") == e, F.col(key)))), ",")
    return ends.groupBy("week").agg(names("first_week").alias("begin"), names("last_week").alias("stop"))


def recent_vs_prior(counts: DataFrame, key: str, weeks: int = 12) -> DataFrame:
    """Each key's share of the last weeks with data against the same number before, with the change and its rank."""
    ranks = counts.select("week").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("week"))))  # a row per week
    rows = counts.join(F.broadcast(ranks.where(F.col("k") <= 2 * weeks)), "week")
    n = lambda recent: F.sum(F.when((F.col("k") <= weeks) == recent, F.col("conversations")).otherwise(0))
    rows = rows.groupBy(key).agg(n(True).alias("recent"), n(False).alias("prior"))
    whole = Window.partitionBy()
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(whole))
    rows = rows.withColumns({"recent_share": share("recent"), "prior_share": share("prior")}).withColumn("change", F.col("recent_share") - F.col("prior_share"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("change"), key)))


def upper_median(value: Column) -> Column:
    """The element in the middle of the sorted values (the upper one of two), not interpolated."""
    values = F.sort_array(F.collect_list(value))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def break_medians(rows: DataFrame, at: Column, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(F.when(F.col("week") < at, "pre").otherwise("post").alias("side")).agg(count_rows().alias("weeks"), upper_median(F.col(value)).alias("median"))


def median_return(weekly: DataFrame) -> DataFrame:
    """One row: weeks whose return is known, and their median return (the upper one of two).  A row per week."""
    return weekly.where("return_rate IS NOT NULL").agg(count_rows().alias("weeks"), F.try_element_at(F.sort_array(F.collect_list("return_rate")), (F.floor(F.count("return_rate") / 2) + 1).cast("int")).alias("median_return"))


def usage_concentration(rows: DataFrame, user: str = "pseudo_user") -> DataFrame:
    """Whole log: users, the most active tenth's share, and the middle user's conversations (the lower one of two)."""
    histogram = rows.groupBy(user).agg(count_rows().alias("convs")).groupBy("convs").agg(count_rows().alias("m"))
    line = Window.orderBy(F.desc("convs"))  # a row per distinct count
    histogram = histogram.withColumns({"cum": F.sum("m").over(line), "users": F.sum("m").over(Window.partitionBy())})
    cut = F.greatest(F.lit(1), F.ceil(F.col("users") * 0.1))
    taken = F.greatest(F.lit(0), F.least(F.col("m"), cut - (F.col("cum") - F.col("m"))))
    middle = F.floor(F.col("users") / 2) + 1
    at = F.when((F.col("cum") >= middle) & (F.col("cum") - F.col("m") < middle), F.col("convs"))
    return histogram.agg(F.max("users").alias("users"), (F.sum(taken * F.col("convs")) / F.sum(F.col("m") * F.col("convs"))).alias("top10_share"), F.max(at).alias("median_conversations"))


def personal_usage(rows: DataFrame, user: str = "pseudo_user") -> DataFrame:
    """Per user: active weeks of the weeks spanned, and the busiest week."""
    weeks = rows.groupBy(user, "week").agg(count_rows().alias("n"))
    spanned = F.floor(F.datediff(F.max("week"), F.min("week")) / 7) + 1
    busiest = F.max(F.struct("n", (-F.unix_date("week")).alias("d"), "week"))
    return weeks.groupBy(user).agg(count_rows().alias("active_weeks"), spanned.alias("span_weeks"), F.sum("n").alias("conversations"), busiest.alias("b")).select(
        user, "active_weeks", "span_weeks", "conversations", F.col("b.week").alias("busiest_week"), F.col("b.n").alias("busiest_n")
    )


def overview(rows: DataFrame, weeks: int = 12) -> DataFrame:
    """One row of headline numbers."""
    weekly = intensity(rows)
    by_week = Window.orderBy("week")  # a row per week
    weekly = weekly.withColumn("k", F.row_number().over(by_week.orderBy(F.desc("week"))))
    peak = F.max(F.struct("pseudo_users", (-F.unix_date("week")).alias("d"), "week"))
    last = F.max(F.when(F.col("return_rate").isNotNull(), F.struct("week", "return_rate")))
    out = weekly.agg(
        F.sum("conversations").alias("conversations"), peak.alias("p"), F.max_by("pseudo_users", "week").alias("last_users"), last.alias("r"),
        F.sum(F.when(F.col("k") <= weeks, F.col("conversations"))).alias("recent_conversations"),
    )
    return out.select(
        "conversations", F.col("p.week").alias("peak_week"), F.col("p.pseudo_users").alias("peak_users"), (F.col("last_users") / F.col("p.pseudo_users") - 1).alias("change_from_peak"),
        F.col("r.week").alias("return_week"), F.col("r.return_rate").alias("return_rate"), "recent_conversations",
    )


def recent_model_share(rows: DataFrame, weeks: int = 12, model: str = "model_family") -> DataFrame:
    ranks = rows.select("week").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("week")))).where(F.col("k") <= weeks).select("week")
    counts = rows.join(F.broadcast(ranks), "week").groupBy(F.col(model).alias("model")).agg(count_rows().alias("conversations"))
    return counts.withColumn("share", F.col("conversations") / F.sum("conversations").over(Window.partitionBy()))


def multi_model_weeks(rows: DataFrame, least_share: float = 0.1, model: str = "model_family") -> DataFrame:
    """Per week: models, the leading one's share, and how many have at least ``least_share``."""
    counts = rows.groupBy("week", F.col(model).alias("model")).agg(count_rows().alias("n"))
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("week")))
    return counts.groupBy("week").agg(count_rows().alias("models"), F.max("share").alias("top_share"), F.count_if(F.col("share") >= least_share).alias("sizeable"))


def shares(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = rows.groupBy(*keys).agg(count_rows().alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))

"""The metric tables.  Inputs are CONVERSATIONS (with model_family), TURNS and INTENT frames; small cells are suppressed or folded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlytics.functions import rules as R

PROXIES = {"repeat_rate": "repeated_request", "one_and_done_rate": "one_and_done", "correction_rate": "correction_followup", "refusal_rate": "assistant_refusal"}


def count_rows() -> Column:
    return F.count(F.lit(1))



def suppress(cells: DataFrame, column: str, min_cell: int) -> DataFrame:
    return cells.where(F.col(column) >= min_cell)


def fold_small_cells(cells: DataFrame, key: str, min_cell: int, sums: Sequence[str] = ("conversations",), kept_only: Sequence[str] = (), per: Sequence[str] = ("week",)) -> DataFrame:
    """Relabel missing keys as ``not recorded`` and small cells as ``small cells``, then add up: totals stay whole."""
    small = F.col(sums[0]) < min_cell
    label = F.when(F.col(key).isNull(), "not recorded").when(small, "small cells").otherwise(F.col(key))
    plain = F.col(key).isNotNull() & ~small
    rows = cells.select(*per, label.alias(key), *sums, *(F.when(plain, F.col(c)).alias(c) for c in kept_only))
    return rows.groupBy(*per, key).agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in kept_only))


def volume_daily_model(c: DataFrame) -> DataFrame:
    return c.groupBy("date", F.col("model_family").alias("model")).agg(
        count_rows().alias("conversations"), F.sum(F.col("n_turns").cast("long")).alias("turns"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.count("prompt_tokens").alias("conversations_with_tokens"),
    )


def volume_weekly_country(c: DataFrame, min_cell: int) -> DataFrame:
    cells = c.groupBy("week", "country").agg(count_rows().alias("conversations"), F.countDistinct("pseudo_user").alias("pseudo_users"))
    return fold_small_cells(cells, "country", min_cell, kept_only=["pseudo_users"])


def volume_weekly_language(c: DataFrame, min_cell: int) -> DataFrame:
    return fold_small_cells(c.groupBy("week", "language").agg(count_rows().alias("conversations")), "language", min_cell)


def intensity(c: DataFrame, keys: Sequence[str] = (), step_days: int = 7, period: str = "week") -> DataFrame:
    """Users, conversations per user, the share of the most active tenth, and return in the next period.

    The tenth's share comes from the histogram of conversations per user, not from ranking users in one task; return comes from
    each user's next active period.  ``keys`` are further cell keys; return then means the same key's users.
    """
    cell = [period, *keys]
    per_user = c.groupBy(*cell, "pseudo_user").agg(count_rows().alias("convs"))
    follow = F.lead(period).over(Window.partitionBy(*keys, "pseudo_user").orderBy(period))
    per_user = per_user.withColumn("back", F.coalesce(follow == F.date_add(period, step_days), F.lit(False)))
    histogram = per_user.groupBy(*cell, "convs").agg(count_rows().alias("m"), F.count_if("back").alias("back"))
    line = Window.partitionBy(*cell).orderBy(F.desc("convs"))
    whole = Window.partitionBy(*cell)
    histogram = histogram.withColumns({"cum": F.sum("m").over(line.rowsBetween(Window.unboundedPreceding, 0)), "users": F.sum("m").over(whole)})
    cut = F.greatest(F.lit(1), F.ceil(F.col("users") * 0.10))
    taken = F.greatest(F.lit(0), F.least(F.col("m"), cut - (F.col("cum") - F.col("m"))))
    # percentile takes frequencies, so quantiles come from the histogram too
    cells = histogram.groupBy(*cell).agg(
        F.sum("m").alias("pseudo_users"), F.sum(F.col("m") * F.col("convs")).alias("conversations"),
        F.percentile("convs", 0.5, F.col("m")).alias("convs_per_user_p50"), F.percentile("convs", 0.9, F.col("m")).alias("convs_per_user_p90"),
        (F.sum(taken * F.col("convs")) / F.sum(F.col("m") * F.col("convs"))).alias("top10_share"), (F.sum("back") / F.sum("m")).alias("back_rate"),
    )
    follows = F.lead(period).over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy(period)) == F.date_add(period, step_days)
    cells = cells.withColumn("next_week_present", F.coalesce(follows, F.lit(False)))
    return cells.withColumn("return_rate", F.when(F.col("next_week_present"), F.col("back_rate"))).drop("back_rate")


def intensity_weekly(c: DataFrame) -> DataFrame:
    return intensity(c)


def intensity_weekly_model(c: DataFrame, min_cell: int) -> DataFrame:
    return suppress(intensity(c.withColumn("model", F.col("model_family")), ["model"]), "pseudo_users", min_cell)


def persistence_quarterly(c: DataFrame) -> DataFrame:
    users = c.groupBy(R.quarter_of(F.col("week")).alias("quarter"), "pseudo_user").agg(F.countDistinct("week").alias("weeks"))
    return users.groupBy("quarter").agg(count_rows().alias("pseudo_users"), F.avg("weeks").alias("avg_weeks_active"), R.rate(F.col("weeks") > 1).alias("share_multi_week"))


def depth_by_model(c: DataFrame) -> DataFrame:
    return c.groupBy(F.col("model_family").alias("model"), R.depth_bucket(F.col("n_turns")).alias("depth_bucket")).agg(count_rows().alias("conversations"), F.median("n_turns").alias("median_turns"))


def labelled(c: DataFrame, intent: DataFrame) -> DataFrame:
    return c.join(intent.where("intent IS NOT NULL").select("conv_id", "intent"), "conv_id")


def intent_counts(c: DataFrame, intent: DataFrame, keys: Sequence[str | Column], min_cell: int = 0) -> DataFrame:
    return suppress(labelled(c, intent).groupBy(*keys, "intent").agg(count_rows().alias("conversations")), "conversations", min_cell)


def intent_weekly(c: DataFrame, intent: DataFrame) -> DataFrame:
    return intent_counts(c, intent, ["week"])


def intent_weekly_model(c: DataFrame, intent: DataFrame, min_cell: int) -> DataFrame:
    return intent_counts(c, intent, ["week", F.col("model_family").alias("model")], min_cell)


def intent_by_model(c: DataFrame, intent: DataFrame) -> DataFrame:
    return intent_counts(c, intent, [F.col("model_family").alias("model")])


def intent_by_language(c: DataFrame, intent: DataFrame, min_cell: int, top: int = 10) -> DataFrame:
    """The most frequent languages (a missing one takes a place, and falls away) by intent."""
    best = c.groupBy("language").agg(count_rows().alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("language")).limit(top).select("language")
    return intent_counts(c.join(F.broadcast(best), "language"), intent, ["language"], min_cell)  # ``top`` rows


def friction(c: DataFrame, keys: Sequence[str | Column], min_cell: int = 0) -> DataFrame:
    rates = [R.rate(F.col(flag)).alias(name) for name, flag in PROXIES.items()]
    return suppress(c.where("NOT has_empty_user_input").groupBy(*keys).agg(count_rows().alias("conversations"), *rates), "conversations", min_cell)


def friction_weekly(c: DataFrame) -> DataFrame:
    return friction(c, ["week"])


def friction_weekly_model(c: DataFrame, min_cell: int) -> DataFrame:
    return friction(c, ["week", F.col("model_family").alias("model")], min_cell)


def friction_by_intent_model(c: DataFrame, intent: DataFrame, min_cell: int) -> DataFrame:
    return friction(labelled(c, intent), ["intent", F.col("model_family").alias("model")], min_cell)


def friction_by_intent_model_era(c: DataFrame, intent: DataFrame, eras: DataFrame, min_cell: int) -> DataFrame:
    """eras: era, era_start, era_end; a handful of rows, so each date meets all of them."""
    tagged = c.join(F.broadcast(eras), F.col("date").between(F.col("era_start"), F.col("era_end")))
    return friction(labelled(tagged, intent), ["era", "era_start", "era_end", "intent", F.col("model_family").alias("model")], min_cell)


def friction_by_responder(turns: DataFrame, c: DataFrame, min_cell: int) -> DataFrame:
    """Corrections and repeats per reply, charged to the responder; first user turns react to nothing and stay out."""
    rows = turns.select("conv_id", "idx", "role", "attributed_to", "repeats_prev_user", "is_correction").join(c.where("NOT has_empty_user_input").select("conv_id", "model"), "conv_id")
    rows = rows.where(~((F.col("role") == "user") & (F.col("idx") == 1)))
    user = F.col("role") == "user"
    cells = rows.groupBy(R.model_family(F.coalesce("attributed_to", "model")).alias("responder")).agg(
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.count_if(user & F.col("is_correction")).alias("corrections"), F.count_if(user & F.col("repeats_prev_user")).alias("repeats")
    )
    per = lambda c: F.try_divide(F.col(c).cast("double"), F.col("assistant_turns"))
    return suppress(cells, "assistant_turns", min_cell).withColumns({"correction_rate": per("corrections"), "repeat_rate": per("repeats")})


def data_quality(c: DataFrame, keys: Sequence[str | Column], min_cell: int = 0) -> DataFrame:
    flags = {"redacted_rate": F.col("redacted"), "empty_input_rate": F.col("has_empty_user_input"), "token_usage_coverage": F.col("prompt_tokens").isNotNull()}
    return suppress(c.groupBy(*keys).agg(count_rows().alias("conversations"), *(R.rounded_rate(f).alias(n) for n, f in flags.items())), "conversations", min_cell)


def data_quality_weekly(c: DataFrame) -> DataFrame:
    return data_quality(c, ["week"])


def data_quality_weekly_model(c: DataFrame, min_cell: int) -> DataFrame:
    return data_quality(c, ["week", F.col("model_family").alias("model")], min_cell)


def friction_all_and_models(c: DataFrame, min_cell: int) -> DataFrame:
    """Weekly friction of all models (model null) and of each, from one scan."""
    rates = ", ".join(f"avg(cast({flag} AS int)) AS {name}" for name, flag in PROXIES.items())
    return c.sparkSession.sql(
        f"SELECT week, model_family AS model, count(*) AS conversations, grouping(model_family) AS whole, {rates} FROM {{c}} WHERE NOT has_empty_user_input "
        "GROUP BY GROUPING SETS ((week), (week, model_family))", c=c,
    ).where((F.col("whole") == 1) | (F.col("conversations") >= min_cell)).drop("whole")

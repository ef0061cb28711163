"""Decisions: failure reasons, backlog, fix list, routing policies and usage-weighted evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlytics.functions import rules as R
from turnlytics.functions.reasons import reason_of

from .metrics import count_rows

# List prices in USD per million tokens (model, prompt, completion), and the tokens assumed for a conversation.
PRICES = [("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6), ("o1", 15.0, 60.0), ("o1-mini", 3.0, 12.0), ("gpt-4", 30.0, 60.0), ("gpt-3.5-turbo", 0.5, 1.5)]
ASSUMED_TOKENS = (1500, 800)


def with_reason(failures: DataFrame) -> DataFrame:
    return failures.withColumn("reason", reason_of(F.col("failure"), F.col("bad_reply"), F.col("user_feedback"), F.col("prev_request")))


def failure_reasons(cases: DataFrame, examples: int = 3) -> DataFrame:
    """Count, share and up to three different examples (the first in order of text) per reason."""
    # distinct examples are cut down per reason before they meet: a reason may have any number of cases
    texts = cases.select("reason", R.example_text(F.col("user_feedback")).alias("t")).distinct()
    rank = F.row_number().over(Window.partitionBy("reason").orderBy("t"))
    few = texts.withColumn("k", rank).where(F.col("k") <= examples).groupBy("reason").agg(F.array_sort(F.collect_list("t")).alias("examples"))
    counts = cases.groupBy("reason").agg(count_rows().alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("reason", "n", (F.col("n") / total).alias("share")).join(few, "reason")


def reasons_by_intent(cases: DataFrame, least: int = 30, top: int = 3) -> DataFrame:
    counts = cases.groupBy("intent", "reason").agg(count_rows().alias("n"))
    whole = F.sum("n").over(Window.partitionBy("intent"))
    counts = counts.withColumns({"failures": whole, "rank": F.row_number().over(Window.partitionBy("intent").orderBy(F.desc("n"), "reason"))})
    return counts.where((F.col("failures") >= least) & (F.col("rank") <= top)).select("intent", "rank", "reason", "n", "failures", (F.col("n") / F.col("failures")).alias("share"))


def opening_ask(text: Column) -> Column:
    """A conversation's first user text, shortened."""
    return R.example_text(text, 160)


def backlog(cases: DataFrame, replied: DataFrame, intents: DataFrame, examples: int = 3) -> DataFrame:
    """Failures by intent and responder, against the conversations of that intent in which the responder replied (``replied``: conv_id,
    responder, each pair once).

    Where cases have an ``ask``, themes also name their most frequent reason and up to three different opening asks, the first ones in order
    of text.
    """
    base = replied.join(intents, "conv_id").groupBy("intent", "responder").agg(count_rows().alias("conversations"))
    cases = cases.withColumn("responder", F.col("attributed_to"))
    kind = lambda k: F.count_if(F.col("failure") == k)
    same = lambda a, b: F.col(f"{a}.intent").eqNullSafe(F.col(f"{b}.intent")) & F.col(f"{a}.responder").eqNullSafe(F.col(f"{b}.responder"))
    themes = cases.groupBy("intent", "responder").agg(count_rows().alias("failures"), kind("correction").alias("corrections"), kind("repeat").alias("repeats"))
    rows = themes.alias("t").join(base.alias("b"), F.col("t.intent").eqNullSafe(F.col("b.intent")) & (F.col("t.responder") == F.col("b.responder")), "left")
    rows = rows.select("t.intent", "t.responder", "failures", "corrections", "repeats", "conversations", F.try_divide("failures", "conversations").alias("share"))
    if "ask" not in cases.columns:
        return rows
    theme = Window.partitionBy("intent", "responder")
    counts = cases.groupBy("intent", "responder", "reason").agg(count_rows().alias("n"))  # a row per reason
    top = counts.groupBy("intent", "responder").agg(F.min(F.struct((-F.col("n")).alias("m"), "reason"))["reason"].alias("top_reason"))
    texts = cases.select("intent", "responder", "ask").distinct().withColumn("k", F.row_number().over(theme.orderBy("ask"))).where(F.col("k") <= examples)
    few = texts.groupBy("intent", "responder").agg(F.array_sort(F.collect_list("ask")).alias("examples"))
    rows = rows.alias("t").join(top.alias("r"), same("t", "r"), "left").select("t.*", "top_reason")
    return rows.alias("t").join(few.alias("f"), same("t", "f"), "left").select("t.*", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def responder_per_1k(charges: DataFrame, least_replies: int = 1) -> DataFrame:
    """Repeats and push-backs per 1,000 replies; for one person's log, responders with few replies stay out (30 are usual)."""
    rows = charges.groupBy("responder").agg(F.count_if("reply").alias("replies"), F.count_if("repeats_prev_user").alias("repeats"), F.count_if("is_correction").alias("corrections")).where(F.col("replies") >= least_replies)
    return rows.withColumns({"repeat_per_1k": 1000 * F.col("repeats") / F.col("replies"), "correction_per_1k": 1000 * F.col("corrections") / F.col("replies")})


def fix_list(labelled: DataFrame) -> DataFrame:
    """Intents by how many conversations were flagged (repeat or correction); probe traffic ("other") stays out."""
    flagged = F.col("repeated_request").cast("int") + F.col("correction_followup").cast("int")
    rows = labelled.where("intent IS NOT NULL AND intent <> 'other' AND NOT has_empty_user_input").groupBy("intent").agg(count_rows().alias("conversations"), F.sum(flagged).alias("flagged"))
    whole = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.desc("flagged"), "intent"))  # a row per intent
    return rows.select("intent", "conversations", "flagged", (F.col("flagged") / F.col("conversations")).alias("rate"), (F.col("flagged") / F.sum("flagged").over(whole)).alias("share_of_flagged"), rank.alias("rank"))


def price_list(spark, prices: Sequence[tuple] = PRICES, tokens: tuple[int, int] = ASSUMED_TOKENS) -> DataFrame:
    rows = spark.createDataFrame(list(prices), "model string, prompt double, completion double")
    return rows.select("model", ((tokens[0] * F.col("prompt") + tokens[1] * F.col("completion")) / 1e6).alias("cost"))


def routing_cells(cells: DataFrame, prices: DataFrame, min_conversations: int = 1000) -> DataFrame:
    """Cells with cost and whether they may be chosen: large and priced ones, or all of an intent that has none."""
    rows = cells.where("intent <> 'other'").join(F.broadcast(prices), "model", "left")  # a row per priced model
    good = (F.col("conversations") >= min_conversations) & F.col("cost").isNotNull()
    some = F.max(good).over(Window.partitionBy("era", "intent"))
    return rows.withColumn("eligible", good | ~some)


def routing_policies(cells: DataFrame, near: float = 0.05) -> DataFrame:
    """Per era: the actual mix and three policies, with volume-weighted rates, cost per 1,000 and changes from the actual mix."""
    rates = ["one_and_done_rate", "refusal_rate", "correction_rate", "repeat_rate"]
    cost = F.coalesce("cost", F.lit(0.0))
    rows = cells.withColumn("cost", cost)
    floor = F.min(F.when(F.col("eligible"), F.col("one_and_done_rate"))).over(Window.partitionBy("era", "intent"))
    rows = rows.withColumns({"floor": floor, "volume": F.sum("conversations").over(Window.partitionBy("era", "intent"))})
    values = F.struct(*rates, "cost", "model")
    pick = lambda order, when: F.min(F.when(when, F.struct(*order, values.alias("v"))))["v"]
    ok = F.col("eligible")
    chosen = rows.groupBy("era", "intent", "volume").agg(
        pick([F.col("one_and_done_rate"), F.col("model")], ok).alias("best_friction"),
        pick([F.col("cost"), F.col("model")], ok).alias("cheapest_only"),
        pick([F.col("cost"), F.col("model")], ok & (F.col("one_and_done_rate") <= F.col("floor") + near)).alias("cost_aware"),
    )
    names = ["best_friction", "cheapest_only", "cost_aware"]
    picks = chosen.select("era", F.col("volume").alias("n"), F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.col(p).alias("v")) for p in names))).alias("x"))
    actual = rows.select("era", F.lit("baseline_actual_mix").alias("policy"), F.col("conversations").alias("n"), *rates, "cost")
    every = actual.unionByName(picks.select("era", "x.policy", "n", *(f"x.v.{c}" for c in [*rates, "cost"])))
    weighted = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    out = every.groupBy("era", "policy").agg(F.sum("n").alias("conversations"), *(weighted(c).alias(c) for c in rates), (1000 * weighted("cost")).alias("cost_per_1k"))
    base = lambda c: F.max(F.when(F.col("policy") == "baseline_actual_mix", F.col(c))).over(Window.partitionBy("era"))
    return out.withColumns({"one_and_done_change": F.col("one_and_done_rate") - base("one_and_done_rate"), "cost_change": F.try_divide("cost_per_1k", base("cost_per_1k")) - 1})


def usage_mix(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of each intent within the keys' group."""
    rows = counts.groupBy(*keys, "intent").agg(F.sum("conversations").alias("conversations"))
    return rows.withColumn("weight", F.col("conversations") / F.sum("conversations").over(Window.partitionBy(*keys)))


def weighted_intents(results: DataFrame, weights: DataFrame) -> DataFrame:
    """Per intent with weight: number and mean of its scores; n is 0 where it has none."""
    scored = results.where("score IS NOT NULL").groupBy("intent").agg(count_rows().alias("n"), F.sum("score").alias("total"))
    rows = weights.select("intent", "weight").join(scored, "intent", "left")
    return rows.select("intent", "weight", F.coalesce("n", F.lit(0)).alias("n"), (F.col("total") / F.col("n")).alias("mean"), "total")


def weighted_score(results: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: the usage-weighted mean over covered intents, the plain mean, the covered weight and the missing intents."""
    rows = weighted_intents(results, weights)
    there = F.col("n") > 0
    covered = F.sum(F.when(there, F.col("weight")))
    return rows.agg(
        (F.sum(F.when(there, F.col("weight") * F.col("mean"))) / covered).alias("usage_weighted_score"), (F.sum("total") / F.sum("n")).alias("unweighted_mean"),
        covered.alias("covered_weight"), F.array_join(F.array_sort(F.collect_list(F.when(~there, F.col("intent")))), ",").alias("missing_intents"),
    )


def friction_heat(cells: DataFrame, least: int = 1000, top: int = 3) -> DataFrame:
    """For each intent's models of largest volume, the three signals in long form, and whether the cell is large enough to be ranked."""
    rank = F.row_number().over(Window.partitionBy("intent").orderBy(F.desc("conversations"), "model"))
    rows = cells.withColumn("k", rank).where(F.col("k") <= top)
    return rows.unpivot(["intent", "model", "conversations"], ["one_and_done_rate", "repeat_rate", "correction_rate"], "signal", "rate").withColumn("rankable", F.col("conversations") >= least)

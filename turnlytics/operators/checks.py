"""Run facts, reconciliation of the metric tables, and declarative checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlytics.functions import rules as R


def run_meta(conversations: DataFrame, intent: DataFrame) -> DataFrame:
    """One row about the run: size, dates, shards, labelled share, the first week with token counts."""
    base = conversations.agg(
        F.count(F.lit(1)).alias("conversations"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.count_distinct("shard").alias("shards"),
        F.min(F.when(F.col("prompt_tokens").isNotNull(), F.col("week"))).alias("first_token_week"),
    )
    labelled = intent.agg(F.count("intent").alias("labelled"))
    first, last = R.complete_weeks(F.col("date_min"), F.col("date_max"))
    rows = base.join(F.broadcast(labelled)).withColumns({"complete_weeks_from": first, "complete_weeks_through": last})  # one row
    return rows.withColumn("labelled_share", F.col("labelled") / F.col("conversations"))


#: What readers of the published tables must know.
CAVEATS = [
    "The conversations come from one public service; findings describe its users only.",
    "A pseudo-user is a hash of network address, browser and language: people behind one network merge, and one person's devices count apart.",
    "The return rate is null for weeks whose next week is not in the data, the last week among them.",
    "Tokens are known for some conversations only; sums of them go with the number of conversations that have them.",
]


def run_facts(meta: DataFrame, coverage: DataFrame, gate: DataFrame, min_cell: int) -> DataFrame:
    """The facts that go with published tables: ``run_meta``, coverage of intents, the classifier's figures, and the caveats.  One row each."""
    figures = gate.select(F.col("n").alias("classifier_n_test"), F.col("accuracy").alias("classifier_accuracy"), F.col("macro_f1").alias("classifier_macro_f1"), F.col("gate").alias("classifier_threshold"), (~F.col("passes") & F.col("used")).alias("classifier_forced"))
    rows = meta.join(F.broadcast(coverage.select(F.col("coverage").alias("intent_coverage")))).join(F.broadcast(figures))
    return rows.withColumns({"min_cell": F.lit(min_cell), "caveats": F.array(*map(F.lit, CAVEATS))})


def expectation(rows: DataFrame, label: str, got, want, tolerance: float = 0.0) -> DataFrame:
    """One row: label, got, want, ok; got and want are aggregates of ``rows``."""
    out = rows.agg(F.coalesce(got.cast("double"), F.lit(0.0)).alias("got"), F.coalesce(want.cast("double"), F.lit(0.0)).alias("want"))
    return out.select(F.lit(label).alias("label"), "got", "want", (F.abs(F.col("got") - F.col("want")) <= tolerance).alias("ok"))


def same_weeks(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Weeks in which two tables have different numbers of conversations."""
    x, y = (t.groupBy("week").agg(F.sum("conversations").alias(n)) for t, n in ((a, "x"), (b, "y")))
    both = x.join(y, "week", "full")
    return expectation(both, label, F.count_if(~F.col("x").eqNullSafe(F.col("y"))), F.lit(0))


def within_unit(rows: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    bad = F.lit(0)
    for c in columns:
        bad = bad + F.count_if(F.col(c).isNotNull() & ~F.col(c).between(0, 1))
    return expectation(rows, label, bad, F.lit(0))


def reconcile(tables: Mapping[str, DataFrame], total: DataFrame) -> DataFrame:
    """The metric tables against each other.  ``total`` has one row: conversations, labelled."""
    t = tables
    sums = lambda name: t[name].agg(F.sum("conversations").alias("n")).join(F.broadcast(total))
    daily = t["volume_daily_model"].withColumn("week", R.monday(F.col("date").cast("timestamp")))
    rows = [expectation(sums(n), f"{n} adds up", F.max("n"), F.max("conversations")) for n in ("volume_daily_model", "depth_by_model", "volume_weekly_country", "volume_weekly_language")]
    rows += [expectation(sums(n), f"{n} adds up to the labelled", F.max("n"), F.max("labelled")) for n in ("intent_by_model", "intent_weekly")]
    rows += [same_weeks(daily, t[n], f"{n} has the weekly volume") for n in ("intensity_weekly", "data_quality_weekly")]
    rows += [same_weeks(t[part], t[whole], f"{part} adds up to {whole}") for part, whole in (("friction_weekly_model", "friction_weekly"), ("data_quality_weekly_model", "data_quality_weekly"))]
    of_model = daily.groupBy("week", "model").agg(F.sum("conversations").alias("n"))
    rows.append(expectation(t["intensity_weekly_model"].join(of_model, ["week", "model"]), "intensity_weekly_model has the models' volume", F.count_if(F.col("conversations") != F.col("n")), F.lit(0)))
    unknown = t["friction_by_responder"].join(daily.select(F.col("model").alias("responder")).distinct(), "responder", "left_anti")
    rows.append(expectation(unknown, "responders that are no model's name", F.count(F.lit(1)), F.lit(0)))
    weekly = t["intensity_weekly"]
    _, last = R.complete_weeks(F.min("date"), F.max("date"))
    through = daily.agg(last.alias("through")).join(F.broadcast(weekly.select("week")), F.col("week") == F.col("through"))  # a row per week
    rows.append(expectation(through, "the last complete week has a row", F.count(F.lit(1)), F.lit(1)))
    empty = t["friction_weekly"].join(t["data_quality_weekly"].select("week", F.col("conversations").alias("all"), "empty_input_rate"), "week")
    rows.append(expectation(empty, "friction leaves out empty inputs", F.max(F.abs(F.col("conversations") - F.round(F.col("all") * (1 - F.col("empty_input_rate"))))), F.lit(0), 1.0))
    cells = t["friction_by_intent_model_era"].alias("e").join(t["friction_by_intent_model"].alias("a"), ["intent", "model"])
    rows.append(expectation(cells, "era cells within all-time cells", F.count_if(F.col("e.conversations") > F.col("a.conversations")), F.lit(0)))
    weekly = t["intent_weekly_model"].groupBy("week").agg(F.sum("conversations").alias("part")).join(t["intent_weekly"].groupBy("week").agg(F.sum("conversations").alias("whole")), "week")
    rows.append(expectation(weekly, "intent cells within weekly intents", F.count_if(F.col("part") > F.col("whole")), F.lit(0)))
    rows.append(within_unit(t["friction_weekly"], ["repeat_rate", "one_and_done_rate", "correction_rate", "refusal_rate"], "friction rates within 0 and 1"))
    rows.append(within_unit(t["intensity_weekly"], ["return_rate", "top10_share"], "intensity rates within 0 and 1"))
    rows.append(within_unit(t["intensity_weekly_model"], ["return_rate", "top10_share"], "intensity rates of models within 0 and 1"))
    rows.append(within_unit(t["data_quality_weekly"], ["redacted_rate", "token_usage_coverage"], "quality rates within 0 and 1"))
    rows.append(within_unit(t["friction_by_responder"], ["correction_rate", "repeat_rate"], "responder rates within 0 and 1"))
    null = t["intensity_weekly"]
    rows.append(expectation(null, "return rate is null where no next week is", F.count_if(F.col("return_rate").isNull() == F.col("next_week_present")), F.lit(0)))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def run_checks(spark: SparkSession, checks: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """Declarative checks (label, SQL with one number, expected, tolerance); one that fails to run is a failed row."""
    out = None
    for label, sql, want, tolerance in checks:
        try:
            got = spark.sql(sql)
            row = got.select(F.lit(label).alias("label"), F.col(got.columns[0]).cast("double").alias("got"), F.lit(None).cast("string").alias("error"))
        except Exception as e:
            row = spark.range(1).select(F.lit(label).alias("label"), F.lit(None).cast("double").alias("got"), F.lit(type(e).__name__).alias("error"))
        row = row.withColumn("ok", F.coalesce(F.abs(F.col("got") - want) <= tolerance, F.lit(False)))
        out = row if out is None else out.unionByName(row)
    return out


def catalogue(tables: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Tables with their columns, from their schemas."""
    return spark.createDataFrame([(name, ", ".join(f.name for f in t.schema.fields)) for name, t in sorted(tables.items())], "table_name string, columns string")


#: Columns that would carry conversation text.
CONTENT_COLUMNS = {"content", "text", "intent_text", "bad_reply", "user_feedback", "prev_request", "examples"}


def content_free(table: DataFrame) -> bool:
    return not CONTENT_COLUMNS & set(table.columns)

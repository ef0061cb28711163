"""Labelling: prompts, parsing of answers, cost, resuming, agreement and precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes, and the older classes that each one merges.
CLASSES_MERGING = {
    "coding": [],
    "questions": ["information_seeking", "homework_study", "personal_advice"],
    "writing_and_business": ["writing_editing", "business_professional"],
    "creative_roleplay": [],
    "image_prompting": [],
    "translation": [],
    "other": [],
}
MEANING = {
    "coding": "programs and queries: to be made, mended, read or moved to another language",
    "questions": "somebody wants to know, learn, weigh or decide something",
    "writing_and_business": "a text of everyday or working life is to be made, shortened or improved",
    "creative_roleplay": "made-up stories, verse, characters or scenes",
    "image_prompting": "a picture is to be described for a program that draws it",
    "translation": "a text is to be put into another language, or the language itself is asked about",
    "other": "none of these, or nothing that can be understood",
}
TAXONOMY = [(name, old, MEANING[name]) for name, old in CLASSES_MERGING.items()]
CONFIDENCE = ["low", "medium", "high"]
CLASSES = [t[0] for t in TAXONOMY]


def mapped(label: Column) -> Column:
    """The class that a label (old or new) belongs to; unknown labels stay."""
    pairs = [F.lit(x) for name, old, _ in TAXONOMY for o in old for x in (o, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)


def prompts(sample: DataFrame, limit: int = 2000) -> DataFrame:
    """The request for each sampled conversation, as JSON."""
    system = "Classify the request into one of:\n" + "\n".join(f"- {name}: {text}" for name, _, text in TAXONOMY)
    message = F.struct(F.lit(system).alias("system"), F.substring("intent_text", 1, limit).alias("user"))
    return sample.select("conv_id", F.to_json(message).alias("request"), (F.length(F.lit(system)) + F.length(F.substring("intent_text", 1, limit))).alias("chars"))


def parse_label(text: Column) -> Column:
    """struct(intent, confidence) from the whole text or the first of its {...} parts that is valid; null if there is none."""
    parts = F.concat(F.array(text), F.regexp_extract_all(text, F.lit(r"(?s)(\{.*?\})"), 1))
    # parse errors give nulls
    read = F.transform(parts, lambda p: F.from_json(p, "intent STRING, confidence STRING"))
    good = F.filter(read, lambda r: r["intent"].isin(CLASSES) & r["confidence"].isin(CONFIDENCE))
    return F.try_element_at(good, F.lit(1))


def label_cost(requests: DataFrame, input_price: float, output_price: float, output_tokens: int = 30, chars_per_token: float = 4.0) -> DataFrame:
    """Estimated tokens and cost (prices per million tokens) of a batch of requests."""
    tokens = F.sum(F.ceil(F.col("chars") / chars_per_token))
    return requests.agg(F.count(F.lit(1)).alias("requests"), tokens.alias("input_tokens"), (F.count(F.lit(1)) * output_tokens).alias("output_tokens"), ((tokens * input_price + F.count(F.lit(1)) * output_tokens * output_price) / 1e6).alias("cost"))


def remaining(sample: DataFrame, progress: DataFrame) -> DataFrame:
    """Sampled conversations that no successful answer exists for yet."""
    return sample.join(progress.where("intent IS NOT NULL").select("conv_id").distinct(), "conv_id", "left_anti")


def canary_ok(answers: DataFrame, n: int = 50, least: float = 0.9) -> DataFrame:
    """One row: share of the first n answers (by id) that can be parsed, and whether the batch may go on."""
    first = answers.orderBy("conv_id").limit(n)
    rate = F.avg(parse_label(F.col("answer")).isNotNull().cast("int"))
    return first.agg(F.count(F.lit(1)).alias("n"), rate.alias("parse_rate")).withColumn("go_on", F.col("parse_rate") >= least)


def collect_labels(answers: DataFrame) -> DataFrame:
    """One valid label per conversation: the latest attempt that can be parsed."""
    good = answers.withColumn("l", parse_label(F.col("answer"))).where("l IS NOT NULL")
    return good.groupBy("conv_id").agg(F.max_by("l", "attempt").alias("l")).select("conv_id", "l.intent", "l.confidence")


def _tolerant(answer: Callable[[str], str], request: str) -> str | None:
    """One call that fails must not lose the answers of the others in its task."""
    try:
        return answer(request)
    except Exception:  # whatever the model's client raises; the missing label is counted by the gate
        return None


def label_rows(requests: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """Calls ``answer`` for each request inside tasks; the function stands for whatever model is used.  A call that fails gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([_tolerant(answer, r) for r in b.column("request").to_pylist()], pa.string())], ["conv_id", "answer"])

    return requests.select("conv_id", "request").mapInArrow(run, "conv_id long, answer string")


class GateError(ValueError):
    """A batch that must not go on, or whose outcome must not be used."""


def label_batch(requests: DataFrame, answer: Callable[[str], str], path: str, input_price: float = 0.0, output_price: float = 0.0, budget: float | None = None, canary: int = 50, least_parsed: float = 0.9, least_labelled: float = 0.9) -> DataFrame:
    """Labels a batch behind three gates, each of which stops it with ``GateError``; the labels: conv_id, intent, confidence.

    The estimated cost keeps within the budget; of the first requests, enough answers can be parsed; in the end, enough of the
    batch is labelled.  Answers are written below ``path``, so a call is paid once.  Calls that fail give null answers, which
    a later attempt makes up for (``remaining``).
    """
    spark = requests.sparkSession
    requests.write.mode("overwrite").parquet(f"{path}/requests")
    requests = spark.read.schema(requests.schema).parquet(f"{path}/requests")
    if budget is not None and (cost := label_cost(requests, input_price, output_price).first()["cost"] or 0.0) > budget:
        raise GateError(f"the batch is estimated at {cost:.2f}, over the budget of {budget:.2f}")
    first = requests.orderBy("conv_id").limit(canary)
    label_rows(first, answer).write.mode("overwrite").parquet(f"{path}/canary")
    tried = spark.read.parquet(f"{path}/canary")
    parsed = canary_ok(tried, canary, least_parsed).first()
    if parsed["n"] and not parsed["go_on"]:
        raise GateError(f"{parsed['parse_rate']:.2f} of the first {parsed['n']} answers can be parsed, {least_parsed} are asked for")
    rest = requests.join(F.broadcast(tried.select("conv_id")), "conv_id", "left_anti")  # ``canary`` rows
    label_rows(rest, answer).write.mode("overwrite").parquet(f"{path}/rest")
    answers = tried.unionByName(spark.read.parquet(f"{path}/rest")).withColumn("attempt", F.lit(1))
    labels = collect_labels(answers)
    total, labelled = answers.select("conv_id").distinct().count(), labels.count()
    if labelled < least_labelled * total:
        raise GateError(f"{labelled} of {total} are labelled, {least_labelled} of them are asked for")
    return labels


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: conversations that both rated, agreement on raw labels and on merged classes."""
    both = a.select("conv_id", F.col("intent").alias("x")).join(b.select("conv_id", F.col("intent").alias("y")), "conv_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x") == F.col("y")).cast("int")).alias("raw_agreement"), F.avg((mapped(F.col("x")) == mapped(F.col("y"))).cast("int")).alias("merged_agreement"))


def disagreements(a: DataFrame, b: DataFrame, top: int = 5) -> DataFrame:
    both = a.select("conv_id", mapped(F.col("intent")).alias("x")).join(b.select("conv_id", mapped(F.col("intent")).alias("y")), "conv_id").where("x <> y")
    pair = [F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second")]
    return both.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "first", "second").limit(top)


PROXY_LABELS = {"repeated_request": "is_repeat", "correction_followup": "is_correction", "assistant_refusal": "is_refusal"}


def proxy_precision(flags: DataFrame, labels: DataFrame, keep: float = 0.7) -> DataFrame:
    """Per proxy: how often it fired, how often people agreed, precision, recall, and keep or drop."""
    rows = flags.join(labels, "conv_id")
    long = F.explode(F.array(*(F.struct(F.lit(p).alias("proxy"), F.col(p).alias("fired"), F.col(truth).alias("truth")) for p, truth in PROXY_LABELS.items()), F.struct(F.lit("one_and_done").alias("proxy"), F.col("one_and_done").alias("fired"), (~F.col("satisfied")).alias("truth"))))
    out = rows.select(long.alias("x")).select("x.*").groupBy("proxy").agg(F.count_if("fired").alias("predicted"), F.count_if(F.col("fired") & F.col("truth")).alias("true_positives"), F.count_if("truth").alias("actual"))
    out = out.withColumns({"precision": F.try_divide("true_positives", "predicted"), "recall": F.try_divide("true_positives", "actual")})
    return out.withColumn("verdict", F.when(F.col("precision") >= keep, "keep").otherwise("drop"))


def friction_vs_outcome(flags: DataFrame, labels: DataFrame) -> DataFrame:
    fired = F.col("repeated_request") | F.col("correction_followup") | F.col("assistant_refusal") | F.col("one_and_done")
    return flags.join(labels, "conv_id").agg(F.count(F.lit(1)).alias("n_labels"), F.avg(F.when(fired, (~F.col("satisfied")).cast("int"))).alias("friction_vs_outcome"))


def survey_score(results: DataFrame, votes: DataFrame, limit: float = 120.0, passing: float = 0.8, findings: int = 3) -> DataFrame:
    """Results: participant, question, seconds, correct, caveat; votes: respondent, finding_id, would_act."""
    main = results.agg(F.median("seconds").alias("median_seconds"), F.avg((F.col("seconds") < limit).cast("int")).alias("under_limit"), F.avg(F.col("correct").cast("int")).alias("task_success"))
    kept = results.groupBy("participant").agg(F.max_by("caveat", "question").alias("caveat")).agg(F.avg(F.col("caveat").cast("int")).alias("caveat_retention"))
    acted = votes.groupBy("finding_id").agg(F.avg(F.col("would_act").cast("int")).alias("share")).where("share > 0.5")
    acted = acted.agg(F.count(F.lit(1)).alias("n_findings"), F.array_join(F.array_sort(F.collect_list("finding_id")), ",").alias("findings"))
    rows = main.join(F.broadcast(kept)).join(F.broadcast(acted))  # one row each
    return rows.withColumns({"time_pass": F.col("under_limit") >= passing, "success_pass": F.col("task_success") >= passing, "caveat_pass": F.col("caveat_retention") >= passing, "action_pass": F.col("n_findings") >= findings})


def confusion(predictions: DataFrame, classes: Sequence[str]) -> DataFrame:
    return predictions.groupBy("label").pivot("pred", list(classes)).count().na.fill(0)


def report(predictions: DataFrame) -> DataFrame:
    """Per class: precision, recall, F1 and support; a class without predictions or cases has 0."""
    sides = predictions.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col("label") == F.col("pred")).cast("int").alias("t")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    rows = sides.groupBy(F.col("c").alias("class")).agg(F.sum("t").alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = rows.withColumns({"precision": zero(F.col("tp"), F.col("predicted")), "recall": zero(F.col("tp"), F.col("support"))})
    return rows.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("tp", "predicted")


def summary(predictions: DataFrame) -> DataFrame:
    per = report(predictions).where("support > 0").agg(F.avg("f1").alias("macro_f1"))
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy")).join(F.broadcast(per))  # one row


def gate(summary_rows: DataFrame, rater_agreement: float | None, requested: float = 0.8, share: float = 0.9, force: bool = False) -> DataFrame:
    """A classifier may be used at ``share`` of the raters' agreement, else at the requested accuracy, or when forced."""
    least = round(share * rater_agreement, 4) if rater_agreement is not None else requested
    return summary_rows.withColumns({"gate": F.lit(least), "passes": F.col("accuracy") >= least}).withColumn("used", F.col("passes") | F.lit(force))


"""A training-corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, mixture.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of ``documents``; the last one adds the number of the copy.  ``run`` writes each stage's result as Parquet in the
cluster's shared folder and reads it again for the next one.

Decisions fall on rows, not on ids.  Defined results:
- A null or empty text has no language, so the first stage rejects it.
- Of rows that are near-duplicates, the one with the smallest id stays (a null id counts as the largest); of rows equal in id, any one.
  So exact repeats of a row leave one.  Rows with a null or repeated id are compared like all others.
- Passages are removed where a row with a smaller id holds them; rows with a null id keep their texts and are no reference.  ``n_chars``
  follows the text that is left.
- The mixture draws rows one by one, whatever their ids; reruns agree.
- Empty tables pass through as such.  Further columns pass through unchanged; a name that a stage needs for a column of its own gets
  underscores added until it is free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from turnlytics.llm import decontaminate, language_id, minhash, mixing, substring_dedup
from turnlytics.llm.common import Scratch
from turnlytics.llm.queries import held_out, table


def _free(name: str, docs: DataFrame) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the filters learn from the labelled documents outside the held-out fold."""
    training = held_out(docs.select("doc_id", "text", "lang")).where(~F.col("held_out")).select("doc_id", "text", "lang")
    return language_id.reject_unidentified(docs, language_id.fit(training))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8).  Where ids are null, repeat or are no whole
    numbers, rows are numbered first."""
    ids = docs.select("doc_id")
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    if whole and ids.where("doc_id IS NULL").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        # whole numbers that tell rows apart serve as they are, and a component is named after its smallest one
        gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    number = _free("row_number", docs)
    rows = Scratch(spark, "numbered").table(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    groups = minhash.near_duplicates(rows, id_column=number).select(F.col("doc_id").alias("number"), "component_id")
    members = groups.join(rows.select(F.col(number).alias("number"), "doc_id"), "number")
    # a component is named after its first row; only where another row has the smallest id, that one is looked up
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")).alias("first"))
    other = best.where("first.number <> component_id").select("component_id", F.col("first.number").alias("kept"))
    gone = members.join(other, "component_id", "left").where(F.col("number") != F.coalesce("kept", "component_id")).select(F.col("number").alias(number))
    return rows.join(gone, number, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that an earlier document holds; documents that lose all words go."""
    _, changed = substring_dedup.duplicate_passages(docs)
    changed = changed.select("doc_id", "text_key", "kept_text").alias("c")
    docs = docs.alias("d")
    rows = docs.join(changed, (F.col("d.doc_id") == F.col("c.doc_id")) & (F.xxhash64("d.text") == F.col("c.text_key")), "left")
    left = F.col("c.kept_text")
    new = {"text": F.coalesce(left, "d.text"), "n_chars": F.when(left.isNull(), F.col("d.n_chars")).otherwise(F.length(left).cast("long"))}
    return rows.where(left.isNull() | (left != "")).select(*(new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; an item under four words, which may well be common speech, removes a document only if it
    is half of it."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"), short_words=4, short_share=0.5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy that is taken, numbered from 1."""
    return mixing.draw_copies(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Readers of evaluation results, hand-made labels and labelling progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header: intent and score; an empty score, or one that is no number, is null."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select("intent", F.col("score").try_cast("double").alias("score"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header: conv_id and intent, one label per row; rows without either are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(F.col("conv_id").try_cast("long").alias("conv_id"), F.nullif(F.trim("intent"), F.lit("")).alias("intent")).where("conv_id IS NOT NULL AND intent IS NOT NULL")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of labelling attempts, each with its conversation, answer and number; a line that was cut off is left out."""
    rows = spark.read.schema("conv_id BIGINT, answer STRING, attempt INT").json(path)
    return rows.where("conv_id IS NOT NULL")

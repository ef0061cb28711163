"""Raw shards and flat tables: scanning, choosing shards, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def root_of(spark: SparkSession, path: str) -> str:
    """The folder part of a path as file addresses hold it, with a slash at its end."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getRawPath().rstrip("/") + "/"


def shard_label(path: Column, root: str = "") -> Column:
    """A file's path below the source folder (its whole path elsewhere), without extension: files of one name in two folders differ."""
    at = F.instr(path, root) if root else F.lit(0)
    below = F.when(at > 0, F.substr(path, at + len(root))).otherwise(path)
    return F.regexp_replace(below, r"\.[^./]*$", "")


def read_shards(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All shard files below a path, each row with its shard's label; columns are pruned down into nested fields."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("recursiveFileLookup", True).parquet(path).withColumn("shard", shard_label(F.col("_metadata.file_path"), root_of(spark, path)))


def chosen_shards(spec: str, available: list[str]) -> list[str]:
    """"all", "0-3" or "0,5": positions in the sorted labels."""
    labels = sorted(available)
    if spec == "all":
        return labels
    at: list[int] = []
    for part in spec.split(","):
        low, _, high = part.partition("-")
        at += range(int(low), int(high or low) + 1)
    return [labels[i] for i in dict.fromkeys(at) if i < len(labels)]


def unfinished(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of shards that the flat table does not hold yet."""
    return rows.join(done.select("shard").distinct(), "shard", "left_anti")


def with_missing(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Older tables lack some columns; those come as nulls."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The flat table at a path; an empty one of the stated columns where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def intent_coverage(conversations: DataFrame, intent: DataFrame, forced: bool = False) -> DataFrame:
    """One row: none, partial or full, by the shards that either table has; a full one that a classifier below its gate made by force
    is named so."""
    a = conversations.select("shard").distinct().withColumn("flat", F.lit(1))
    b = intent.select("shard").distinct().withColumn("labelled", F.lit(1))
    both = a.join(b, "shard", "full")
    n = both.agg(F.count("flat").alias("flat"), F.count("labelled").alias("labelled"), F.count_if(F.col("flat").isNull() | F.col("labelled").isNull()).alias("differ"))
    full = F.when(F.lit(forced), "forced_below_threshold").otherwise("full")
    return n.select(F.when(F.col("labelled") == 0, "none").when(F.col("differ") == 0, full).otherwise("partial").alias("coverage"), F.col("flat").alias("shards"), F.col("labelled").alias("labelled_shards"))

"""Publishing: one small Parquet table per metric, run facts, and what may be shown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import content_free


def write_metrics(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each table in a folder of its own, as one file; tables with conversation text are refused."""
    for name, table in tables.items():
        if not content_free(table):
            raise ValueError(f"{name} has columns with conversation text")
        table.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def published_size(spark: SparkSession, path: str, budget: int = 25_000_000) -> DataFrame:
    """Files and bytes per table, and whether all of them keep within the budget."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rows = files.groupBy(name.alias("table_name")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    whole = rows.agg(F.sum("bytes").alias("total"))
    return rows.join(F.broadcast(whole)).select("table_name", "files", (F.col("total") <= budget).alias("within_budget"))  # one row


def write_meta(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(path)


def responder_split(responders: DataFrame, models: DataFrame) -> DataFrame:
    """One row: how many responders there are, how many are no model's name; without the latter, a split by responder says nothing new."""
    other = responders.join(models.select(F.col("model").alias("responder")).distinct(), "responder", "left_anti")
    return responders.agg(F.count(F.lit(1)).alias("responders")).join(F.broadcast(other.agg(F.count(F.lit(1)).alias("no_models")))).withColumn("show_split", F.col("no_models") > 0)  # one row


def percent_change(now, before):
    """Change in percent and its direction; null where there is nothing to compare with."""
    change = F.round(100 * (F.try_divide(now, before) - 1), 1)
    return change, F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat")


#: What the columns of the published tables mean; a column has one meaning in all of them.
COLUMNS = {
    "week": "Monday of the week", "date": "day", "quarter": "first day of the quarter", "era": "name of the period", "era_start": "first day of the period", "era_end": "last day of the period",
    "model": "model family", "country": "country; small cells and unknown ones in rows of their own", "language": "language; small cells and unknown ones in rows of their own", "intent": "class of the request", "responder": "who answers for the turn", "depth_bucket": "range of user turns",
    "conversations": "number of conversations", "turns": "number of user turns", "prompt_tokens": "tokens sent", "completion_tokens": "tokens received", "conversations_with_tokens": "conversations whose tokens are known", "pseudo_users": "distinct people",
    "convs_per_user_p50": "median of conversations per person", "convs_per_user_p90": "ninth decile of conversations per person", "top10_share": "share of conversations by the most active tenth of people", "next_week_present": "whether the next week has data",
    "return_rate": "share of people who come back in the next week", "avg_weeks_active": "mean number of active weeks per person", "share_multi_week": "share of people active in two weeks or more", "median_turns": "median of user turns",
    "repeat_rate": "share with a repeated request", "one_and_done_rate": "share that ended after one short exchange", "correction_rate": "share with a push-back", "refusal_rate": "share with a refusal",
    "assistant_turns": "number of replies", "corrections": "push-backs against replies", "repeats": "repeats after replies", "redacted_rate": "share of redacted conversations", "empty_input_rate": "share with an empty input", "token_usage_coverage": "share with known tokens",
}


def register_published(spark: SparkSession, path: str, names: Sequence[str]) -> None:
    """The published tables below a path as views of their names, each column with its meaning as comment."""
    for name in names:
        rows = spark.read.parquet(f"{path}/{name}")
        rows.select(*(F.col(c).alias(c, metadata={"comment": COLUMNS[c]}) for c in rows.columns)).createOrReplaceTempView(name)


def published_catalogue(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """table_name, column_name, data_type, comment of the registered tables."""
    rows = [(n, f.name, f.dataType.simpleString(), f.metadata.get("comment")) for n in sorted(names) for f in spark.table(n).schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, comment string")


def published_query(spark: SparkSession, path: str, statement: str) -> DataFrame:
    """A user's query over the published tables and nothing else: commands do not parse, and files outside ``path`` are refused."""
    rows = spark.sql(f"SELECT * FROM (\n{statement}\n)")
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    foreign = [f for f in rows.inputFiles() if spark._jvm.org.apache.hadoop.fs.Path(f).toUri().getPath().find(root) != 0]
    if foreign:
        raise ValueError(f"only published tables may be read, not {foreign[0]}")
    return rows

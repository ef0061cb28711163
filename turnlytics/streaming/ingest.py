"""Incremental ingestion of shards, and weekly metrics over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlytics.sources.shards import root_of, shard_label
from turnlytics.sources.store import flat_store, flatten


def ingest_shards(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> int:
    """Flattens the shard files that no earlier call has seen into conversations and turns; returns how many batches ran.

    The checkpoint records files and numbers batches, the store commits both tables of a batch at once under that number.  So a repeated
    call does nothing, and a call that failed is made up for without a trace of the failed one.  Read the tables through the store.
    """
    store, root = flat_store(spark, target), root_of(spark, source)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
    stream = stream.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    stream = stream.withColumn("shard", shard_label(F.col("path"), root))

    def commit(batch: DataFrame, number: int) -> None:
        store.write(number, batch.select("path", "size", "modified", "shard").distinct(), flatten(batch))

    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def weekly_volume(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events and values per Monday week and type; late rows up to the delay still count.  Day 0 is a Thursday, so weeks start 4 days on."""
    week = F.window(time, "7 days", startTime="4 days")
    stream = stream.withColumn(time, F.to_timestamp_ltz(F.concat(F.col(time).cast("timestamp_ntz").cast("string"), F.lit("+00:00"))))  # as UTC, whatever the session's zone
    return stream.withWatermark(time, delay).groupBy(week.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.date_from_unix_date((F.unix_seconds("w.start") / 86400).cast("int")).alias("week"), "event_type", "n", "total")


def stream_to_table(changes: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregating stream to the end of its source; the table keeps each key's latest row.

    Batches write the rows that they changed, each to a folder of its own that a repeated batch replaces, so state behind the
    watermark can be dropped and nothing passes through the driver.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark, values = changes.sparkSession, [c for c in changes.columns if c not in keys]
    rows = spark.read.schema(f"{changes.schema.toDDL()}, batch BIGINT").parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")

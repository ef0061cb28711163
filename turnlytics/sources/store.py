"""Flat tables that grow batch by batch, with a manifest of the source files that each batch holds.

A batch writes its rows of every table into folders of its own, then the manifest's rows (path, size and modification time of each source
file, its shard label, the batch), and last an empty marker that bears the batch's number.  The marker is made in one step of the file system,
and readers see only batches that have one.  So a crash between two tables leaves neither, and a repeated batch replaces what the
failed one left.  Files are known by their whole path: two folders may hold files of one name.  A file that changed is
read again, and of its rows only those of the latest batch are seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlytics import schema
from turnlytics.operators import turns as T
from turnlytics.sources.shards import root_of, shard_label

FILES = "path STRING, size BIGINT, modified TIMESTAMP, shard STRING"


class FlatStore:
    """``tables``: schemas, as DDL, of the tables kept below ``path``; each has a column ``shard``."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        at, fs = self._hadoop(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def committed(self) -> list[int]:
        """Numbers of the batches that readers see: one per batch ever written."""
        return sorted(int(n) for n in self._children(f"{self.path}/_commits") if n.isdigit())

    def next_batch(self) -> int:
        return max(self.committed(), default=-1) + 1

    def write(self, batch: int, files: DataFrame, rows: dict[str, DataFrame]) -> bool:
        """Writes and commits a batch; does nothing if the batch is committed already."""
        if set(rows) != set(self.tables):
            raise ValueError(f"a batch holds all of {sorted(self.tables)}")
        if batch in self.committed():
            return False
        for name, frame in rows.items():
            frame.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{self.path}/{name}/batch={batch}")
        files.select("path", "size", "modified", "shard").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifest/batch={batch}")  # a row per file
        marker, fs = self._hadoop(f"{self.path}/_commits/{batch}")
        fs.create(marker, False).close()
        return True

    def files(self) -> DataFrame:
        """path, size, modified, shard, batch of every committed file; a file that changed has several rows."""
        return self._read("_manifest", FILES)

    def table(self, name: str) -> DataFrame:
        """The rows of committed batches, of each file those of its latest batch."""
        rows, files = self._read(name, self.tables[name]), self.files()
        latest = files.groupBy("path").agg(F.max("batch").alias("latest"))
        stale = files.join(latest, "path").where("batch < latest").select("shard", "batch").distinct()
        return rows.join(stale, ["shard", "batch"], "left_anti").drop("batch")

    def _read(self, name: str, ddl: str) -> DataFrame:
        done = set(self.committed())
        there = [b for b in self._children(f"{self.path}/{name}") if b.startswith("batch=") and int(b[6:]) in done]
        whole = f"{ddl}, batch INT"
        if not there:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/{b}" for b in there))


def flat_store(spark: SparkSession, path: str) -> FlatStore:
    """The store of ``conversations`` and ``turns``."""
    return FlatStore(spark, path, {"conversations": schema.CONVERSATIONS, "turns": schema.TURNS})


def source_files(spark: SparkSession, source: str) -> DataFrame:
    """path, size, modified, shard of the Parquet files below a folder, from the listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(source)
    return listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), shard_label(F.col("path"), root_of(spark, source)).alias("shard"))


def new_files(store: FlatStore, source: str) -> DataFrame:
    """Source files that no committed batch holds as they are now."""
    return source_files(store.spark, source).join(store.files().drop("batch"), ["path", "size", "modified"], "left_anti")


def flatten(raw: DataFrame) -> dict[str, DataFrame]:
    """Both flat tables of raw shard rows."""
    columns = [c.split()[0] for c in schema.TURNS.split(", ")]
    return {"conversations": T.nested_roll_up(raw), "turns": T.nested_turns(raw).select(*columns)}


def flatten_new(store: FlatStore, source: str, ddl: str, most_files: int = 10_000) -> int:
    """Flattens what is new below ``source``, in batches of at most so many files; returns how many batches were committed."""
    spark, count = store.spark, 0
    root = root_of(spark, source)
    while True:
        due = new_files(store, source).orderBy("path").limit(most_files)
        paths = [r["path"] for r in due.select("path").collect()]  # at most ``most_files``
        if not paths:
            return count
        raw = spark.read.schema(ddl).parquet(*paths).withColumn("shard", shard_label(F.col("_metadata.file_path"), root))
        files = source_files(spark, source).where(F.col("path").isin(paths)) if len(paths) <= 100 else source_files(spark, source).join(spark.createDataFrame([(p,) for p in paths], "path string"), "path", "left_semi")
        count += store.write(store.next_batch(), files, flatten(raw))

"""The flat store: batches appear whole, files are known by their whole path."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from turnlytics.schema import raw_shard
from turnlytics.sources import shards, store
from turnlytics.streaming import ingest


def conversation(ident, texts):
    messages = [(t, "user" if i % 2 == 0 else "assistant", ident, None, None, None, "English", False, False, None, None, None) for i, t in enumerate(texts)]
    return ("h", "m", dt.datetime(2024, 3, 4), (len(texts) + 1) // 2, "English", False, False, None, "US", "u", ("en", "ua"), messages)


def put(spark, folder, name, rows):
    """One shard file of a given name."""
    folder.mkdir(parents=True, exist_ok=True)
    made = folder.parent.parent / f"made-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, raw_shard()).coalesce(1).write.parquet(f"file://{made}")
    next(made.glob("part-*.parquet")).replace(folder / name)


def ids(frame):
    return sorted(r["conv_id"] for r in frame.select("conv_id").distinct().collect())


@pytest.fixture
def place(spark, tmp_path):
    put(spark, tmp_path / "raw/a", "part-0.parquet", [conversation(1, ["q", "r", "no, that is wrong"])])
    put(spark, tmp_path / "raw/b", "part-0.parquet", [conversation(2, ["x", "y"])])
    return tmp_path


def test_files_of_one_name_in_two_folders_are_both_kept(spark, place):
    flat = store.flat_store(spark, f"file://{place}/flat")
    assert store.flatten_new(flat, f"file://{place}/raw", raw_shard()) == 1
    assert {(r["shard"], r["conv_id"]) for r in flat.table("conversations").collect()} == {("a/part-0", 1), ("b/part-0", 2)}
    assert {(r["shard"], r["count"]) for r in flat.table("turns").groupBy("shard").count().collect()} == {("a/part-0", 3), ("b/part-0", 2)}
    assert store.flatten_new(flat, f"file://{place}/raw", raw_shard()) == 0
    put(spark, place / "raw/c", "part-0.parquet", [conversation(3, ["z"])])
    assert store.flatten_new(flat, f"file://{place}/raw", raw_shard()) == 1 and ids(flat.table("turns")) == [1, 2, 3]
    assert sorted((r["shard"], r["batch"]) for r in flat.files().collect()) == [("a/part-0", 0), ("b/part-0", 0), ("c/part-0", 1)]


def test_batches_of_few_files(spark, place):
    flat = store.flat_store(spark, f"file://{place}/flat")
    assert store.flatten_new(flat, f"file://{place}/raw", raw_shard(), most_files=1) == 2
    assert ids(flat.table("conversations")) == ids(flat.table("turns")) == [1, 2]


def test_a_crash_between_the_tables_leaves_neither(spark, place):
    flat = store.flat_store(spark, f"file://{place}/flat")
    raw = shards.read_shards(spark, f"file://{place}/raw", raw_shard())
    rows = store.flatten(raw)
    broken = rows["turns"].withColumn("idx", F.expr("raise_error('lost')").cast("int"))
    with pytest.raises(Exception, match="lost"):
        flat.write(0, store.source_files(spark, f"file://{place}/raw"), rows | {"turns": broken})
    assert flat.committed() == [] and flat.table("conversations").count() == flat.table("turns").count() == flat.files().count() == 0
    assert store.flatten_new(flat, f"file://{place}/raw", raw_shard()) == 1
    assert ids(flat.table("conversations")) == ids(flat.table("turns")) == [1, 2] and flat.table("conversations").count() == 2
    with pytest.raises(ValueError):
        flat.write(1, store.source_files(spark, f"file://{place}/raw"), {"turns": rows["turns"]})


def test_a_committed_batch_is_not_written_again(spark, place):
    flat = store.flat_store(spark, f"file://{place}/flat")
    rows = store.flatten(shards.read_shards(spark, f"file://{place}/raw", raw_shard()))
    files = store.source_files(spark, f"file://{place}/raw")
    assert flat.write(0, files, rows) and not flat.write(0, files, {k: v.where("false") for k, v in rows.items()})
    assert ids(flat.table("conversations")) == [1, 2]


def test_a_changed_file_replaces_its_rows(spark, place):
    flat = store.flat_store(spark, f"file://{place}/flat")
    store.flatten_new(flat, f"file://{place}/raw", raw_shard())
    put(spark, place / "raw/a", "part-0.parquet", [conversation(7, ["new", "rows"]), conversation(8, ["and", "more"])])
    assert store.flatten_new(flat, f"file://{place}/raw", raw_shard()) == 1
    assert ids(flat.table("conversations")) == ids(flat.table("turns")) == [2, 7, 8]


def test_ingestion_keeps_both_tables(spark, place):
    run = lambda: ingest.ingest_shards(spark, f"file://{place}/raw", f"file://{place}/flat", f"file://{place}/checkpoint", raw_shard())
    run()
    flat = store.flat_store(spark, f"file://{place}/flat")
    assert ids(flat.table("conversations")) == ids(flat.table("turns")) == [1, 2]
    assert {r["shard"] for r in flat.files().collect()} == {"a/part-0", "b/part-0"}
    put(spark, place / "raw/b", "part-1.parquet", [conversation(5, ["p", "q"])])
    run()
    run()
    assert ids(flat.table("turns")) == [1, 2, 5] and flat.table("conversations").count() == 3


def test_labels(spark):
    label = lambda path, root="": spark.range(1).select(shards.shard_label(F.lit(path), root)).first()[0]
    assert label("file:///d/raw/a.b/x.y.parquet", "/d/raw/") == "a.b/x.y"
    assert label("s3://d/raw/x", "/other/") == "s3://d/raw/x" and label("file:///d/x.parquet") == "file:///d/x"

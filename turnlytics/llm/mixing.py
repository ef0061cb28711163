"""Mixing sources to target weights by systematic sampling; DataFrame operations only.

A document's size is its number of words.  Each source gets a share of ``total`` (a part of all sizes) by its weight, but
never more than ``most`` times its own size; what exceeds that goes to the others by weight, until no target exceeds
its limit.  Within a source, every document expects target / source size copies.  Documents are laid out by size (then
id), the expected copies are summed up along that line from one random offset on, and a document is emitted once for each
whole number its interval crosses.  As neighbours on the line have like sizes, the words taken miss the target by less
than about the largest document.

The running position within a source is found in two steps: Spark sorts all rows by (source, size, id) into ranges, counts
each source's rows in each range, and numbers rows within a range.  A source with most of all rows spreads over most
ranges, so no task holds a whole source.

Defined results: a null text has size 0; documents of size 0 take 0.  A null source is a source of its own, the last one.
Sources whose documents are all empty have target 0.  Rows are placed one by one, also those with a null or repeated id; rows
equal in source, size, id and text are alike, and which of them is drawn makes no difference.  An empty table gives no rows.
A text may have any length.  Other columns, whatever their names, play no part; ``draw_copies`` passes them through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

OFFSET_STEPS = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], total: float = 1.0, most: float = 3.0) -> DataFrame:
    """Of (source, source_size): each source's target.  Work grows with the number of sources only.

    Sources are taken in the order of the level at which they reach their limit.  With the first k at theirs, the others
    share what is left at one level; the first k for which none of these exceeds its limit decides, and its level is the
    largest of all that leave the rest below their limits.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    listed = listed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    line = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rest = line.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = listed.withColumn("given", F.lit(float(total)) * F.sum("source_size").over(all_rows).cast("double"))
    level = (F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    listed = listed.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    listed = listed.withColumn("level", F.max("level").over(all_rows))
    return listed.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def random_offset(source: Column, seed: int) -> Column:
    """The source's offset in [0, 1), the same in every run."""
    key = F.concat(F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 5), 16, 10).cast("double") / OFFSET_STEPS


def _drawn(docs: DataFrame, weights: Sequence[float], total: float, most: float, seed: int, id_column: str, text_column: str, source_column: str, also: Sequence[Column] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, and the further columns asked for.  Texts are not moved."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.col(text_column)
    sized = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("tie"), *also)
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with scratch.inner("steps") as inner:
        sized = inner.table(sized, "sizes")
        kept = sized.columns
        ranged = scratch.table(sized.repartitionByRange(partitions, *order).withColumn("range", F.spark_partition_id()), "ranges")
        counts = inner.table(ranged.groupBy("source", "range").agg(F.count("*").alias("rows"), F.sum("size").alias("words")), "counts")
        targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total, most)
        along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(along), F.lit(0)))
        counts = counts.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "range", "before", "source_size", "target")
        counts = scratch.table(counts, "positions")
    rows = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("source", "range").orderBy("size", F.col("doc_id").asc_nulls_last(), "tie")))
    rows = rows.alias("r").join(counts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.range") == F.col("c.range")))
    rows = rows.select(*(f"r.{c}" for c in kept), "source_size", "target", (F.col("before") + F.col("rank")).cast("double").alias("place"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = random_offset(F.col("source"), seed)
    copies = F.floor(F.col("place") * each + start) - F.floor((F.col("place") - 1) * each + start)
    # a share of at most ``most`` crosses no more than its ceiling of whole numbers; the bound guards the last digit only
    return rows.withColumn("copies", F.least(copies, F.lit(math.ceil(most)).cast("long")))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), total: float = 1.0, most: float = 3.0, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target (its source's), copies, taken (words)."""
    rows = _drawn(docs, weights, total, most, seed, id_column, text_column, source_column)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _holds_map(kind.elementType)


def hashable(value: Column, kind: T.DataType) -> Column:
    """The value with each map, at any depth, as its entries in order, as Spark hashes no maps."""
    if not _holds_map(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: hashable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(hashable(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    entry = lambda e: F.struct(hashable(e["key"], kind.keyType).alias("key"), hashable(e["value"], kind.valueType).alias("value"))
    return F.array_sort(F.transform(F.map_entries(value), entry))


def draw_copies(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), total: float = 1.0, most: float = 3.0, seed: int = 7, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", number: str = "copy") -> DataFrame:
    """The mix itself: a row per copy, with all columns of the documents and the copy's number from 1.

    Should the documents have a column of that name, underscores are added to the new one's.
    """
    while number.lower() in {c.lower() for c in docs.columns}:
        number += "_"
    # a row is found again by two hashes of all that it holds; rows that share them are equal, so one of them takes the copies of all
    cells = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.concat(*(c.isNull().cast("int").cast("string") for c in cells))  # hashes pass over nulls
    held = [hashable(c, f.dataType) for c, f in zip(cells, docs.schema.fields, strict=True)]
    key = [F.xxhash64(nulls, *held).alias("key_1"), F.xxhash64(F.lit(1), nulls, *held).alias("key_2")]
    drawn = _drawn(docs, weights, total, most, seed, id_column, text_column, source_column, key)
    wanted = drawn.groupBy("key_1", "key_2").agg(F.sum("copies").alias("copies"), F.count("*").alias("equal")).where("copies > 0")
    rows = docs.select(F.struct(*cells).alias("row"), *key)
    single = rows.join(wanted.where("equal = 1"), ["key_1", "key_2"])
    place = F.row_number().over(Window.partitionBy("key_1", "key_2").orderBy("copies"))
    equal = rows.join(wanted.where("equal > 1"), ["key_1", "key_2"]).withColumn("place", place).where("place = 1").drop("place")
    taken = single.unionByName(equal).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("drawn"))
    return taken.select("row.*", F.col("drawn").alias(number))

"""Near-duplicate vectors by iterative quantisation.

On a bounded sample of unit vectors, a rotation of the principal axes is learned that makes sign codes balanced and close to
the vectors (iterative quantisation); several starts give several rotations and so longer codes.  Codes are cut into
substrings, one per table of the multi-index.  Vectors of one label that agree in a substring meet in a bucket and are
compared by their original vectors in double precision.  A pair that meets in several tables counts in the first one only.

The substring length follows the logarithm of the largest label, and the number of tables follows from it: a pair at the
threshold is to meet with probability ``recall``.  A first plan takes the angle's share of differing bits; then sample vectors
and partners at the threshold are encoded, and tables are added (past ``MOST_TABLES``, substrings shortened) until enough
pairs meet, as centring widens angles where vectors share a mean.  Crowded buckets are cut into blocks of
about ``block`` vectors that all tables share, and a task compares one pair of blocks at a time, once for all tables; it returns a
count per vector and links that span what is connected, never all pairs.  Equal vectors are one class with a multiplicity.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without label, link with nothing.
Vectors of different lengths link with nothing either.  Repeated rows (same id, label and vector) count once.  A null id is
never linked and its component is null.  An empty table gives no rows.  Vectors of any length are compared whole.  Ids are whole
numbers (cast to long); labels may have any type.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import Scratch
from .components import connected_components

SAMPLE_ROWS = 20_000
PROBES = 8_000
MOST_TABLES = 128
PAIRS = 1 << 16  # pairs whose keys are compared at once


def fit_rotations(sample: np.ndarray, count: int, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and ``count`` projections (side by side) whose signs are balanced codes of unit vectors."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(sample.shape[1], 64)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    v = centred @ axes
    rng, made = np.random.default_rng(seed), []
    for _ in range(count):
        r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(rounds):
            code = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(code.T @ v)
            r = (u @ w).T
        made.append(axes @ r)
    return mean, np.concatenate(made, axis=1)


def plan_tables(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Substring length and number of tables for labels of up to ``rows`` vectors."""
    length = min(max(math.ceil(math.log2(max(rows, 2))) + 3, 8), 24)
    meet = (1 - math.acos(threshold) / math.pi) ** length
    return length, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, length: int, tables: int) -> np.ndarray:
    """Bits of unit vectors: vector, table, place in the substring."""
    bits = min(x.shape[1], 64)
    per = max(1, bits // length)
    return ((x - mean) @ projection >= 0).reshape(len(x), -1, bits)[:, :, : per * length].reshape(len(x), -1, length)[:, :tables]


def table_keys(code: np.ndarray) -> np.ndarray:
    """Each table's substring as a number."""
    return (code @ (1 << np.arange(code.shape[2]))).astype(np.uint32)


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def partners(x: np.ndarray, threshold: float, seed: int = 11) -> np.ndarray:
    """For each unit vector, another one in a random direction at the threshold."""
    u = np.random.default_rng(seed).standard_normal(x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, norm, out=np.zeros_like(u), where=norm > 1e-12)
    return threshold * x + math.sqrt(1 - threshold**2) * u


def fit_tables(sample: np.ndarray, rows: int, threshold: float, recall: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Substring length, number of tables, mean and projection with which pairs at the threshold meet as often as asked."""
    bits = min(sample.shape[1], 64)
    length, tables = plan_tables(rows, threshold, recall)
    length = min(length, bits)
    probes = np.tile(sample, (-(-1000 // len(sample)), 1))[:PROBES]
    others = partners(probes, threshold)
    fitted = 0
    while True:
        if (need := -(-tables // max(1, bits // length))) > fitted:
            (mean, whole), fitted = fit_rotations(sample, need), need
        projection = whole[:, : need * bits]
        met = np.zeros(len(probes), bool)
        for at in range(0, len(probes), 500):
            x, y = (codes(v[at : at + 500], mean, projection, length, tables) for v in (probes, others))
            met[at : at + 500] = (x == y).all(axis=2).any(axis=1)
        missed = 1 - met.mean()
        if missed <= (1 - recall) + 2 * math.sqrt(recall * (1 - recall) / len(probes)) or length == 1:  # within what chance explains
            return length, tables, mean, projection
        if tables < MOST_TABLES:
            tables = min(MOST_TABLES, math.ceil(1.4 * tables))
        else:
            length = max(1, length - 2)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Of (vec_id, label, embedding): rows that can link, one for each (label, embedding), with multiplicity."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where("vec_id is not null and label is not null and embedding is not null").where(~bad).where(F.exists("embedding", lambda x: x != 0))
    named = good.withColumn("vector_key", F.md5(F.col("embedding").cast("string").cast("binary")))
    return named.groupBy("label", "vector_key").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding"))


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.99, sample_rows: int = SAMPLE_ROWS, block: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("embedding"))
    with scratch.inner("steps") as inner:
        classes = inner.table(valid_vectors(rows).withColumn("dim", F.size("embedding")), "classes")
        element = getattr(vectors.schema[vector_column].dataType, "elementType", None)
        kind = "float32" if isinstance(element, FloatType) else "float64"  # vectors travel as they are given
        found = inner.table(compare(spark, classes, inner, threshold, recall, sample_rows, block, kind), "found")
        counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        links = inner.table(found.where("n = 0").select("a", "b").distinct(), "links")
        components = connected_components(links, inner).withColumnRenamed("node", "id")
        classes = classes.join(counts, "id", "left").join(components, "id", "left")
        n_links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
        results = scratch.table(classes.select("label", "vector_key", n_links.alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "results")
    named = rows.select("vec_id", "label", F.md5(F.col("embedding").cast("string").cast("binary")).alias("vector_key")).distinct()
    named = named.alias("r").join(results.alias("c"), (F.col("r.label") == F.col("c.label")) & (F.col("r.vector_key") == F.col("c.vector_key")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def compare(spark: SparkSession, classes: DataFrame, scratch: Scratch, threshold: float, recall: float, sample_rows: int, block: int, kind: str) -> DataFrame:
    """Rows (a, b, n): with n > 0, a has n more links; with n = 0, a and b are connected."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n"), F.sum("n").alias("rows")).collect()
    parts = [_compare_dim(spark, classes.where(F.col("dim") == r["dim"]), scratch, r["dim"], r["n"], r["rows"], threshold, recall, sample_rows, block, kind) for r in sizes if r["n"] > 1]
    if not parts:
        return spark.createDataFrame([], "a long, b long, n long")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole


def _compare_dim(spark, classes, scratch, dim, largest, total, threshold, recall, sample_rows, block, kind) -> DataFrame:
    steps = 1 << 30
    share = min(steps, steps * sample_rows // total)
    sample = np.array([r[0] for r in classes.where(F.pmod(F.xxhash64("id"), F.lit(steps)) < share).select("embedding").collect()], float).reshape(-1, dim)
    if not len(sample):
        sample = np.array([classes.first()["embedding"]], float)
    sample = unit_vectors(sample)
    length, tables, mean, projection = fit_tables(sample, largest, threshold, recall)
    sent = spark.sparkContext.broadcast((mean, projection))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projection = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                given = b.column("embedding").flatten().to_numpy().reshape(-1, dim)
                code = codes(unit_vectors(given), mean, projection, length, tables)
                keys = table_keys(code)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("label"), b.column("copies"), pa.array([k.tobytes() for k in np.packbits(code.reshape(len(code), -1), axis=1)], pa.binary()), pa.array([r.tobytes() for r in given.astype(kind)], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().astype(np.int64)), tables).cast(pa.list_(pa.int64()))],
                    ["id", "label", "copies", "bits", "vector", "key_list"],
                )

    label_type = classes.schema["label"].dataType.simpleString()
    coded = scratch.table(classes.select("id", "label", "copies", "embedding").mapInArrow(encode, f"id long, label {label_type}, copies long, bits binary, vector binary, key_list array<long>"), "codes")
    entries = coded.select("id", "label", F.posexplode("key_list").alias("tab", "key"))
    entries = entries.select("id", F.xxhash64("label", "tab", "key").alias("bucket"), "tab")
    crowded = scratch.table(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    members = scratch.table(entries.join(crowded, "bucket"), "members")
    cells, homes = hot_cells(members.where(F.col("n") > 2 * block), block, scratch)
    small = members.where(F.col("n") <= 2 * block).select("id", "tab", "bucket", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(True).alias("left"))
    placed = scratch.table(small.unionByName(cells), "places")
    whole = placed.join(coded.drop("key_list").join(homes.select("id", "hot"), "id", "left"), "id")
    cell = ["bucket", "low", "high"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    whole = whole.repartition(parts, *cell).sortWithinPartitions(*cell, "id")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (b for b in batches if b.num_rows):
            # the last cell of a batch may go on in the next one
            start = _last_cell(batch)
            if start == 0 and held and not _same_cell(held[-1], batch):
                yield from _compare_cells(held, dim, length, tables, threshold, kind)
                held = []
            if start > 0:
                yield from _compare_cells([*held, batch.slice(0, start)], dim, length, tables, threshold, kind)
                held = []
            held.append(batch.slice(start))
        yield from _compare_cells(held, dim, length, tables, threshold, kind)

    columns = ["id", "tab", *cell, "left", "label", "copies", "bits", "vector", "hot"]
    return whole.select(*columns).mapInArrow(pairs, "a long, b long, n long")


def hot_cells(hot: DataFrame, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Cells of the crowded buckets, and per vector in such buckets their tables (``hot``).

    A group of near copies fills a crowded bucket in nearly every table.  So its vectors get a home, the largest bucket that they are
    in, and a block there; the tables only say which two blocks have members in one bucket, and such a pair of blocks is one cell,
    however many tables say so.  A vector travels once for each block that its own is due with, not once for each of them and table.
    """
    homes = hot.groupBy("id").agg(F.collect_set("tab").alias("hot"), F.max(F.struct("n", "bucket")).alias("home"))  # at most a tab per table
    homes = scratch.table(homes.select("id", "hot", F.col("home.bucket").alias("home")), "homes")
    sizes = scratch.table(homes.groupBy("home").agg(F.ceil(F.count("*") / block).alias("blocks")), "home-sizes")
    homes = scratch.table(homes.join(sizes, "home").select("id", "hot", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block")), "blocks")
    present = scratch.table(hot.select("id", "bucket").join(homes.select("id", "block"), "id").select("bucket", "block").distinct(), "present")
    other = present.select("bucket", F.col("block").alias("high"))
    due = scratch.table(present.withColumnRenamed("block", "low").join(other, "bucket").where("low <= high").select("low", "high").distinct(), "due")
    of = lambda side, when: homes.select("id", F.col("block").alias(side)).join(due.where(when), side).select("id", F.lit(-1).alias("tab"), F.lit(0).cast("long").alias("bucket"), "low", "high", F.lit(side == "low").alias("left"))
    return of("low", "true").unionByName(of("high", "low < high")), homes


def _cells(b) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in ("bucket", "low", "high", "tab")], axis=1)


def _last_cell(b: pa.RecordBatch) -> int:
    c = _cells(b)
    differs = np.flatnonzero((c[1:] != c[:-1]).any(axis=1))
    return int(differs[-1]) + 1 if len(differs) else 0


def _same_cell(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return bool((_cells(a.slice(a.num_rows - 1)) == _cells(b.slice(0, 1))).all())


def _compare_cells(batches: list[pa.RecordBatch], dim: int, length: int, tables: int, threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    if not batches:
        return
    t = pa.Table.from_batches(batches).combine_chunks()
    cells = _cells(t)
    edge = np.append(0, np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1)
    ids, copies, left = t.column("id").to_numpy(), t.column("copies").to_numpy(), t.column("left").to_numpy()
    labels = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
    keys = table_keys(np.unpackbits(bits, axis=1, count=tables * length).reshape(len(ids), tables, length))
    units = unit_vectors(np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(-1, dim).astype(np.float64))
    table = cells[:, 3]
    hot = np.zeros((len(ids), tables), bool)
    lists = t.column("hot").combine_chunks()
    hot[np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
    size = np.diff(np.append(edge, len(ids)))
    counts, a, b = np.zeros(len(ids), np.int64), [], []
    # cells of a few vectors all at once: each row against the rows a step, two steps ... further on
    owner = np.repeat(np.arange(len(edge)), size)
    small = size[owner] <= 16
    diagonal = cells[:, 1] == cells[:, 2]
    for step in range(1, 16):
        x = np.flatnonzero(small[:-step] & (owner[:-step] == owner[step:])) if len(ids) > step else np.zeros(0, int)
        if not len(x):
            break
        y = x + step
        x, y = (v[(diagonal[x] | (left[x] != left[y])) & (labels[x] == labels[y])] for v in (x, y))
        ok = (np.einsum("ij,ij->i", units[x], units[y]) >= threshold) & _counts_here(keys[x], keys[y], table[x], hot[x])
        np.add.at(counts, x[ok], copies[y[ok]])
        np.add.at(counts, y[ok], copies[x[ok]])
        a.append(ids[x[ok]])
        b.append(ids[y[ok]])
    for s, n in zip(edge[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        rows = np.arange(s, s + n)
        ok = (units[rows] @ units[rows].T >= threshold) & (labels[rows][:, None] == labels[rows])
        if not diagonal[s]:
            ok &= left[rows][:, None] != left[rows]
        np.fill_diagonal(ok, False)
        found = ok.copy()
        x, y = np.nonzero(ok)
        for k in range(0, len(x), PAIRS):
            i, j = x[k : k + PAIRS], y[k : k + PAIRS]
            ok[i, j] = _counts_here(keys[rows[i]], keys[rows[j]], table[s], hot[rows[i]])
        counts[rows] += ok @ copies[rows]
        root = np.arange(n)
        while True:
            new = np.minimum(root, np.where(found, root, n).min(axis=1))
            if (new == root).all():
                break
            root = new
        a.append(ids[rows[root != np.arange(n)]])
        b.append(ids[rows[root[root != np.arange(n)]]])
    some = np.flatnonzero(counts)
    yield _result(ids[some], ids[some], counts[some])
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    yield _result(a, b, np.zeros(len(a), np.int64))


def _counts_here(x: np.ndarray, y: np.ndarray, table, hot: np.ndarray) -> np.ndarray:
    """A pair that shares a crowded bucket counts in the cell of its blocks (table -1), any other one in its first table."""
    if not len(x):
        return np.zeros(0, bool)
    same = x == y
    crowded = (same & hot).any(axis=1)
    return np.where(np.asarray(table) < 0, crowded, ~crowded & (np.argmax(same, axis=1) == table))


def _result(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

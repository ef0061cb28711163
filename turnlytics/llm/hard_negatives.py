"""Hard negatives by a secondary-sort shuffle.

Anchors are a stated set of query rows, searched against all rows.  Anchors come in blocks of bounded size; for each block the rows are
scanned twice.  The first scan finds each anchor's best positives: a task keeps the best few per anchor while rows stream
through.  The second scan knows their scores, and with them the windows in which negatives may lie; a task keeps
the best few rows of each window.  So what is shuffled is a few rows per anchor and task, however many rows or copies there are.

What is left is dealt by anchor and sorted by one packed key (anchor, descending score, positives first, id), all in Spark's
shuffle.  An iterator then reads each partition once: a positive opens a window, a negative goes to every open window that admits its
score and is not yet full.  It holds the windows of one anchor and no rows.

Defined results: rows with a null id, label or vector, or with a null, NaN or infinite component take no part.  Vectors of another length
than the anchor's are not its partners; two vectors without components have score 0.  Scaled components beyond 2**53 count as 2**53
(with their sign), scores beyond 64 bits as the largest 64-bit number (with their sign).  Rows with an anchor's own id are not its
partners.  Repeated rows are rows of their own: a repeated anchor is mined once for each of its rows, a repeated partner fills as
many places.  Ties go to the smaller id.  Anchors without a positive, or whose windows are empty, give no rows; an empty table
gives none.  Ids are whole numbers (cast to long), labels may have any atomic type.  Other columns, whatever
their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_BYTES = 32 << 20  # of the anchors sent to tasks at once
CELLS = 1 << 21  # scores held at once
LONGEST = 2**63 - 1


def whole_vectors(given: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as doubles that hold whole numbers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * given), -(2.0**53), 2.0**53)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, as 64-bit numbers."""
    if not a.shape[1] or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    bound = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, -LONGEST, LONGEST).astype(np.int64)


def first_of_each(group: np.ndarray, score: np.ndarray, ident: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` entries of each group, by descending score, then id."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    start = np.searchsorted(g, g)
    return order[np.arange(len(g)) - start < most]


class Best:
    """The best few (score, id) of each of n groups so far, and the score below which a group takes no more."""

    def __init__(self, n: int, most: int):
        self.most, self.floor = most, np.full(n, -LONGEST)
        self.group, self.score, self.ident = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        group, score, ident = np.append(self.group, group), np.append(self.score, score), np.append(self.ident, ident)
        at = first_of_each(group, score, ident, self.most)
        self.group, self.score, self.ident = group[at], score[at], ident[at]
        full = np.flatnonzero(np.bincount(self.group, minlength=len(self.floor)) == self.most)
        last = np.searchsorted(self.group, full, "right") - 1
        self.floor[full] = self.score[last]


@dataclass
class Anchors:
    """A block of anchors of one length.  ``label`` holds places in ``labels``; ``windows`` the scores of each anchor's positives (best
    first), unknown ones with ``known`` false."""

    number: np.ndarray
    ident: np.ndarray
    label: np.ndarray
    labels: list
    vector: np.ndarray
    scale: float
    known: np.ndarray | None = None
    windows: np.ndarray | None = None

    def codes(self, labels: pa.Array) -> np.ndarray:
        """The places of labels in this block's list; those that no anchor has are -1."""
        found = labels.dictionary_encode()
        place = {v: k for k, v in enumerate(self.labels)}
        codes = np.array([place.get(v, -1) for v in found.dictionary.to_pylist()] or [-1])
        return codes[found.indices.to_numpy()]

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first anchor, scores, same label, other id) of some anchors against the rows of a batch."""
        dim = self.vector.shape[1]
        rows = whole_vectors(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim), self.scale)
        ident, label = batch.column("id").to_numpy(), self.codes(batch.column("label"))
        step = max(1, CELLS // max(1, batch.num_rows))
        for a in range(0, len(self.ident), step):
            part = slice(a, a + step)
            yield a, inner_products(self.vector[part], rows), self.label[part][:, None] == label[None], self.ident[part][:, None] != ident[None]


def pack_keys(number: np.ndarray, score: np.ndarray, negative: np.ndarray, ident: np.ndarray) -> pa.Array:
    """Keys whose bytes sort by number, descending score, positives first, id."""
    flip = np.uint64(1 << 63)
    parts = [number.astype(np.int64).view(np.uint64), ~(score.astype(np.int64).view(np.uint64) ^ flip), None, ident.astype(np.int64).view(np.uint64) ^ flip]
    raw = [x.astype(">u8").view(np.uint8).reshape(-1, 8) if x is not None else negative.astype(np.uint8)[:, None] for x in parts]
    data = np.ascontiguousarray(np.concatenate(raw, axis=1))
    offsets = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack_key(key: bytes) -> tuple[bytes, int, bool, int]:
    """(anchor's part, score, negative, id) of a key."""
    return key[:8], (~int.from_bytes(key[8:16], "big") & (2**64 - 1)) - 2**63, key[16] == 1, int.from_bytes(key[17:], "big") - 2**63


def _key_batch(block: Anchors, best: Best, per: int, negative: bool) -> pa.RecordBatch:
    """The kept rows of a task; ``per`` groups belong to one anchor, rows in several of its windows go out once."""
    anchor = best.group // per
    if per > 1:
        # a repeated row may stand several times in one window: as often as in the window that has it most often
        same = np.stack([best.group, best.score, best.ident], axis=1)
        each, times = np.unique(same, axis=0, return_counts=True)
        each[:, 0] //= per
        order = np.lexsort((-times, each[:, 2], each[:, 1], each[:, 0]))
        each, times = each[order], times[order]
        first = np.append(True, (each[1:] != each[:-1]).any(axis=1))[: len(each)]
        anchor, score, ident = np.repeat(each[first], times[first], axis=0).T
    else:
        score, ident = best.score, best.ident
    number = block.number[anchor]
    return pa.RecordBatch.from_arrays([pa.array(number), pa.array(block.ident[anchor]), pack_keys(number, score, np.full(len(anchor), negative), ident)], ["number", "anchor_id", "key"])


def best_positives(block: Anchors, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(block.ident), most)
    for batch in batches:
        ident = batch.column("id").to_numpy()
        for a, score, same, other in block.scored(batch):
            i, j = np.nonzero(same & other & (score >= best.floor[a : a + len(score), None]))
            best.add(i + a, score[i, j], ident[j])
    yield _key_batch(block, best, 1, False)


def best_negatives(block: Anchors, batches: Iterator[pa.RecordBatch], most: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Rows of another label that are among the best of some window."""
    per = block.windows.shape[1]
    best = Best(len(block.ident) * per, most)
    top, bottom = _bounds(block.windows, low, high)
    shut = ~block.known | (bottom > top)
    top, bottom = np.where(shut, -LONGEST, top), np.where(shut, LONGEST, bottom)
    for batch in batches:
        ident = batch.column("id").to_numpy()
        for a, score, same, other in block.scored(batch):
            part = slice(a, a + len(score))
            i, j = np.nonzero(~same & other & (score <= top[part].max(axis=1)[:, None]) & (score >= bottom[part].min(axis=1)[:, None]))
            s, i = score[i, j], i + a
            for k in range(per):
                ok = (s <= top[i, k]) & (s >= bottom[i, k]) & (s >= best.floor[i * per + k])
                best.add(i[ok] * per + k, s[ok], ident[j[ok]])
    yield _key_batch(block, best, per, True)


def _bounds(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest and smallest whole number s with low * score <= 100 * s <= high * score."""
    exact = score.astype(object)
    top, bottom = exact * high // 100, -(-exact * low // 100)
    return np.clip(top, -LONGEST, LONGEST).astype(np.int64), np.clip(bottom, -LONGEST, LONGEST).astype(np.int64)


def emit_negatives(batches: Iterator[pa.RecordBatch], negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: a positive opens a window, a negative goes to the open windows that admit it."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    current, windows = None, []
    for batch in batches:
        out: list[tuple] = []
        for anchor_id, key in zip(batch.column("anchor_id").to_pylist(), batch.column("key").to_pylist(), strict=True):
            anchor, score, negative, ident = unpack_key(key)
            if anchor != current:
                current, windows = anchor, []
            if not negative:
                windows.append([ident, score, 0])
                continue
            for window in windows:
                positive, best, taken = window
                if taken < negatives and low * best <= 100 * score <= high * best:
                    window[2] += 1
                    out.append((anchor_id, positive, taken + 1, ident, best, score))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def first_positives(batches: Iterator[pa.RecordBatch], positives: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, the first few of each anchor."""
    current, seen = None, 0
    for batch in batches:
        keep = []
        for key in batch.column("key").to_pylist():
            seen = seen + 1 if key[:8] == current else 1
            current = key[:8]
            keep.append(seen <= positives)
        yield batch.filter(pa.array(keep, pa.bool_()))


KEYED = "number long, anchor_id long, key binary"


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, block_bytes: int = BLOCK_BYTES, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """A row per anchor, positive and negative found: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vectors``.  Negatives of a positive have low <= 100 * score / positive's score <= high.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~bad).withColumn("dim", F.size("embedding"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = []
    with scratch.inner("steps") as inner:
        anchors = inner.table(rows.where("anchor").withColumn("number", F.monotonically_increasing_id()).drop("anchor"), "anchors")
        for dim, count in ((r["dim"], r["n"]) for r in anchors.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()):
            partners = rows.where(F.col("dim") == dim).select("id", "label", "embedding")
            blocks = -(-count * max(dim, 1) * 8 // block_bytes)
            for k in range(blocks):
                t = anchors.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("number"), F.lit(blocks)) == k)).orderBy("number").toArrow()  # at most about block_bytes
                if not t.num_rows:
                    continue
                labels = t.column("label").combine_chunks().dictionary_encode()
                given = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)
                block = Anchors(t.column("number").to_numpy(), t.column("id").to_numpy(), labels.indices.to_numpy(), labels.dictionary.to_pylist(), whole_vectors(given, scale), scale)
                first = _sorted(_scan(partners, block, best_positives, positives), parts).mapInArrow(lambda b: first_positives(b, positives), KEYED)
                first = inner.table(first, "positives")
                _open_windows(block, first.select("number", "key").toArrow(), positives)  # a few rows per anchor of the block
                keys = first.unionAll(_scan(partners, block, best_negatives, negatives, low, high))
                mined = _sorted(keys, parts).mapInArrow(lambda b: emit_negatives(b, negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
                found.append(scratch.table(mined, "mined"))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionAll(f)
    return whole


def _sorted(keys: DataFrame, parts: int) -> DataFrame:
    return keys.repartition(parts, "number").sortWithinPartitions("key")


def _scan(rows: DataFrame, block: Anchors, keep, *args) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)
    return rows.mapInArrow(lambda batches: keep(sent.value, (b for b in batches if b.num_rows), *args), KEYED)


def _open_windows(block: Anchors, found: pa.Table, positives: int) -> None:
    keys = [unpack_key(k) for k in found.column("key").to_pylist()]
    place = np.searchsorted(block.number, found.column("number").to_numpy())
    block.windows, block.known = np.zeros((len(block.ident), positives), np.int64), np.zeros((len(block.ident), positives), bool)
    for i, (_, score, _, _) in zip(place.tolist(), keys, strict=True):
        k = int(block.known[i].sum())
        block.windows[i, k], block.known[i, k] = score, True

"""Shared pieces of the training-data operators: columnar text helpers and tables that cut lineage.

The text helpers work on Arrow string arrays inside tasks.  They see a batch as one byte buffer with offsets and hash
every word of it at once, so no Python code runs per word.  Word hashes are 64 bits wide.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 18  # text handled by one round of vector operations; a longer document is a round of its own
BATCH_ROWS = 1000
SPACES = b" \t\n\x0b\x0c\r"

_rng = np.random.default_rng(20240607)
_BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62, dtype=np.uint64)) * 2 + 1
_WORD_BASE = int(_rng.integers(1, 2**62, dtype=np.uint64)) * 2 + 1


class Scratch:
    """Tables in the folder that the cluster shares (``spark.checkpoint.dir``), to cut lineage.

    Every table is written once and read again, so a lost executor costs at most the tasks of one step.  Tables that only
    later steps need are kept in an ``inner`` scratch and deleted after them; those that a returned DataFrame reads stay, like
    Spark's own checkpoints.  Where the setting is absent (tests on one machine), a temporary folder serves.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def inner(self, name: str) -> Iterator[Scratch]:
        """A scratch for tables that nothing needs once the block ends; they are deleted then."""
        part = Scratch.__new__(Scratch)
        part.spark, part.root, part._count = self.spark, self.path(name), 0
        try:
            yield part
        finally:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(part.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(root, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of texts have at most so many rows from now on; a lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While this holds, Arrow batches have at most so many rows; for steps whose rows hold large arrays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the setting is absent on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes together."""
    _, offsets = text_buffer(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts in them; a null counts as an empty text."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_class(member: bytes | None = None, but: bytes | None = None) -> np.ndarray:
    """A table of 256 booleans: the bytes of ``member``, or all bytes but those of ``but``."""
    table = np.zeros(256, bool) if member is not None else np.ones(256, bool)
    table[list(member if member is not None else but)] = member is not None
    return table


NON_SPACE = byte_class(but=SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words, and for each text the index of its first word (n + 1 entries)."""
    return spans(is_word[data], np.zeros(len(data) + 1, bool), offsets)


def spans(inside: np.ndarray, edge: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, given which bytes belong to words and before which bytes a word ends in any case."""
    edge[offsets] = True
    before = np.empty(len(inside), bool)
    after = np.empty(len(inside), bool)
    if len(inside):
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        if size > 8 * CHUNK_BYTES:  # one very long text; not kept
            return made[0], made[1]
        got = _powers[base] = (made[0], made[1])
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    power, inverse = powers(_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def hash_runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on, as long as n words follow (texts are not told apart)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    power, inverse = powers(_WORD_BASE, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    count = len(words) - n + 1
    return mix((sums[n:] - sums[:count]) * inverse[:count] + np.uint64(n))


def within(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of ``count`` runs of n words lie within one text, given the index of each text's first word."""
    last = np.repeat(first[1:], np.diff(first))[:count]
    return np.arange(count) + n <= last


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each position on."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

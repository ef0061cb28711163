"""Text features and the intent classifier.

Terms are named by codes (functions/text_features.py).  ``fit`` reads all rows: equal texts are kept once, with how many of each label
there are; a first pass chooses the vocabulary, a second writes features as blocks, and the solver reads only these.  Each of its rounds
sends the weights to the tasks and adds up a gradient per task, both of the vocabulary's size, however many rows there are.  ``fit_sample``
fits on a sample of stated size (``sample_rows``), in one task.  A fitted model is two sorted arrays of codes and a
weight per term and class; it is sent to tasks in parts of bounded size, and a text is scored within its row: no term is exchanged.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlytics.functions import text_features as X
from turnlytics.sources.files import shared_folder

SAMPLE_ROWS = 20_000
WORD_FEATURES, CHARACTER_FEATURES = 300_000, 400_000
TEXTS_AT_ONCE, BLOCK_TEXTS = 200, 1000
TEXT_CHARS = 1 << 20
CHUNK_CHARS = 8 << 20  # of texts whose terms are counted at once
PART_BYTES = 128 << 20  # of a model, sent to the tasks at once
DENSE_BYTES, DENSE_SHARE = 256 << 20, 0.02  # of the solver's matrix; features of a larger share of the rows may be in it
BLOCK_SHARE = 0.25  # features of a larger share of a block's rows are in its matrix
BLOCKS_AT_ONCE, SLICE = 8, 1 << 18  # blocks sent to a task at once; numbers of a gradient that are added up together


def word_list(text: Column) -> Column:
    """The words of two or more characters, and pairs of neighbouring ones."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    pairs = lambda v: F.when(F.size(v) > 1, F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(words), lambda v: F.concat(v, pairs(v))), F.lit(0))


def character_list(text: Column, low: int = 2, high: int = 4) -> Column:
    """The character n-grams within a word that has a space on either side.

    A word shorter than n gives itself once, with its spaces, and no longer n-grams.
    """
    grams = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    of_word = lambda x: F.flatten(F.transform(F.array(F.concat(F.lit(" "), x, F.lit(" "))), lambda w: F.concat(*(grams(w, n) for n in range(low, high + 1)))))
    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\S+)"), 1), of_word))


def word_terms(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per occurrence of a word or pair."""
    return rows.select(ident, F.explode(word_list(F.col(text))).alias("term"))


def character_terms(rows: DataFrame, ident: str, text: str, low: int = 2, high: int = 4) -> DataFrame:
    """One row per occurrence of a character n-gram."""
    return rows.select(ident, F.explode(character_list(F.col(text), low, high)).alias("term"))


def _counts(table: pa.Table, ident: str) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (ident, terms): the ids, the terms, and (place of the id, place of the term, count) of each pair."""
    ids = table.column(ident).combine_chunks().dictionary_encode(null_encoding="encode")
    lists = [c for c in table.column("terms").chunks if len(c)]
    sizes = np.concatenate([np.zeros(0, np.int64), *(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in lists)])
    coded = pa.chunked_array([c.flatten() for c in lists], pa.string()).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes.astype(np.int64))
    pair, n = np.unique(row * max(len(names), 1) + at, return_counts=True)
    return ids.dictionary, names, pair // max(len(names), 1), pair % max(len(names), 1), n


def _coded(names: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of terms by bucket and 64-bit code, two halves of a 128-bit hash; the codes in that order, and where each bucket begins."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names.to_pylist())), np.uint64).reshape(-1, 2)
    bucket = halves[:, 0] % np.uint64(buckets)
    order = np.lexsort((halves[:, 1], bucket))
    return order, halves[order, 1], np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _small(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype(np.uint32).tobytes(), "zstd", asbytes=True)


def tfidf(rows: DataFrame, ident: str, text: str, terms: Callable[[Column], Column], least_documents: int = 2) -> DataFrame:
    """id, term, weight: (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), scaled to unit length per document; ``terms`` gives a text's list of them.

    Texts are dealt by id into chunks of bounded size, the only time that they move.  A chunk sends each of its distinct terms once, as a code in the
    order of codes, to be counted, and gets the counts back in that order; it finds its terms again, so neither they nor any (document, term) pair moves.
    Two terms would be taken for one only if 64 bits of their hashes and their bucket agree.
    """
    size = rows.agg(F.sum(F.length(text))).first()[0] or 0
    chunks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // CHUNK_CHARS))
    dealt = rows.where(F.col(text).isNotNull()).select(F.pmod(F.xxhash64(ident), F.lit(chunks)).alias("chunk"), ident, text).repartition(chunks, "chunk").sortWithinPartitions("chunk")
    listed = dealt.select("chunk", ident, terms(F.col(text)).alias("terms"))

    def send(table: pa.Table) -> pa.Table:
        _, names, row, term, _ = _counts(table, ident)
        order, codes, edge = _coded(names, chunks)
        n, each = np.bincount(term, minlength=len(names))[order], list(itertools.pairwise(edge.tolist()))
        return pa.table({
            "bucket": pa.array(range(chunks), pa.int64()), "chunk": pa.array([table.column("chunk")[0].as_py()] * chunks, pa.int64()), "docs": pa.array([len(np.unique(row))] * chunks, pa.int64()),
            "codes": pa.array([codes[a:z].tobytes() for a, z in each], pa.binary()), "n": pa.array([_small(n[a:z]) for a, z in each], pa.binary()),
        })

    def count(table: pa.Table) -> pa.Table:
        codes = [np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()]
        n = [np.frombuffer(pa.decompress(x, 4 * len(c), "zstd"), np.uint32) for x, c in zip(table.column("n").to_pylist(), codes, strict=True)]
        _, place = np.unique(np.concatenate(codes), return_inverse=True)
        df = np.bincount(place, np.concatenate(n))
        df = np.split(np.where(df < least_documents, 0, df)[place], np.cumsum([len(c) for c in codes])[:-1])
        docs = sum(table.column("docs").to_pylist())  # every chunk sends to every bucket
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "docs": pa.array([docs] * len(df), pa.int64()), "df": pa.array([_small(x) for x in df], pa.binary())})

    sent = listed.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, docs long, codes binary, n binary")
    counted = sent.repartition(chunks, "bucket").groupBy("bucket").applyInArrow(count, "chunk long, bucket long, docs long, df binary")

    def weigh(table: pa.Table, counted: pa.Table) -> pa.Table:
        ids, names, row, term, n = _counts(table, ident)
        order, _, edge = _coded(names, chunks)
        counted = counted.sort_by("bucket")
        df = np.zeros(len(names))
        df[order] = np.concatenate([np.frombuffer(pa.decompress(x, 4 * k, "zstd"), np.uint32) for x, k in zip(counted.column("df").to_pylist(), np.diff(edge).tolist(), strict=True)])
        kept = df[term] > 0
        row, term, n = row[kept], term[kept], n[kept]
        x = (1 + np.log(n)) * (np.log((1 + counted.column("docs")[0].as_py()) / (1 + df[term])) + 1)
        weight = x / np.sqrt(np.bincount(row, x * x, len(ids)))[row] if len(n) else x
        by = np.argsort(term, kind="stable")  # files name a term that stands together once
        return pa.table([ids.take(pa.array(row[by])), names.take(pa.array(term[by])), pa.array(weight[by])], names=[ident, "term", "weight"])

    kind = rows.schema[ident].dataType.simpleString()
    return listed.groupBy("chunk").cogroup(counted.repartition(chunks, "chunk").groupBy("chunk")).applyInArrow(weigh, f"`{ident}` {kind}, term string, weight double")


@dataclass
class IntentModel:
    """``codes`` are sorted; ``weights`` has a row per code and a column per class."""

    codes: np.ndarray
    block: np.ndarray
    idf: np.ndarray
    weights: np.ndarray
    classes: list[str]
    intercepts: np.ndarray

    def parts(self, most_bytes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(codes, block, idf, weights) by ranges of codes, each of at most so many bytes."""
        per = 8 + 1 + 8 + 8 * len(self.classes)
        step = max(1, most_bytes // per)
        return [(self.codes[a : a + step], self.block[a : a + step], self.idf[a : a + step], self.weights[a : a + step]) for a in range(0, max(len(self.codes), 1), step)]

    def table(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """block, term, idf, weights: the terms by name, as found in the texts that the model was fitted on."""
        codes, spark = self.codes, rows.sparkSession

        def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for texts, _ in _text_chunks(batches, text):
                found = X.named(texts, codes)
                block, term = zip(*found.values(), strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([np.uint64(c).astype(np.int64) for c in found], pa.int64()), pa.array(block, pa.string()), pa.array(term, pa.string())], ["code", "block", "term"])

        named = rows.select(text).mapInArrow(names, "code long, block string, term string").dropDuplicates(["code"])
        values = pa.table({"code": codes.view(np.int64), "idf": self.idf, "weights": pa.array(self.weights.tolist(), pa.list_(pa.float64()))})  # a row per term of a bounded vocabulary
        return named.join(spark.createDataFrame(values), "code").select("block", "term", "idf", "weights")

    @classmethod
    def read(cls, weights: DataFrame, classes: list[str], intercepts: list[float]) -> IntentModel:
        """The model of a table (block, term, idf, weights); its size is that of the vocabulary."""
        t = weights.select("block", "term", "idf", "weights").toArrow()
        block = t.column("block").to_pylist()
        codes = np.array([X.term_code(b, term) for b, term in zip(block, t.column("term").to_pylist(), strict=True)], np.uint64)
        order = np.argsort(codes)
        table = np.array(t.column("weights").to_pylist(), float).reshape(len(codes), len(classes))
        number = np.array([X.BLOCKS.index(b) for b in block], np.int64)
        return cls(codes[order], number[order], t.column("idf").to_numpy()[order], table[order], list(classes), np.array(intercepts, float))


def _text_chunks(batches: Iterator[pa.RecordBatch], text: str, at_once: int = TEXTS_AT_ONCE) -> Iterator[tuple[list, pa.RecordBatch]]:
    """Texts a few at a time, with the rows that they are of."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            texts, size = [], 0
            while start + len(texts) < batch.num_rows and len(texts) < at_once and size < TEXT_CHARS:
                texts.append(batch.column(text)[start + len(texts)].as_py())
                size += len(texts[-1] or "")
            yield texts, batch.slice(start, len(texts))
            start += len(texts)


def vocabulary(sample: DataFrame, text: str = "text", word_features: int = WORD_FEATURES, character_features: int = CHARACTER_FEATURES, least_documents: int = 2, times: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, blocks and idf of the terms of two texts or more; of each block the most frequent ones (ties by code).  ``times``: a column
    that says how many texts a row stands for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, batch in _text_chunks(batches, text, BLOCK_TEXTS):
            t = X.Terms(texts)
            n, of = len(t.codes), np.ones(len(texts)) if times is None else batch.column(times).to_numpy(zero_copy_only=False).astype(float)
            df, tf = (np.bincount(t.term, x, n).astype(np.int64) for x in (of[t.row], of[t.row] * t.count))
            yield pa.RecordBatch.from_arrays([pa.array(t.codes.view(np.int64)), pa.array(t.block.astype(np.int32)), pa.array(df), pa.array(tf)], ["code", "block", "df", "tf"])

    found = sample.select(text, *([times] if times else [])).mapInArrow(count, "code long, block int, df long, tf long").groupBy("code", "block").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= least_documents)
    path = shared_folder(sample.sparkSession, "terms")
    found.write.parquet(path)
    found, n = sample.sparkSession.read.parquet(path), sample.agg(F.sum(times) if times else F.count(F.lit(1))).first()[0] or 0
    kept = [found.where(F.col("block") == b).orderBy(F.desc("tf"), "code").limit(k) for b, k in ((X.WORD, word_features), (X.CHARACTERS, character_features))]
    t = kept[0].unionAll(kept[1]).toArrow()  # at most the two vocabularies
    codes = t.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    return codes[order], t.column("block").to_numpy().astype(np.int64)[order], np.log((1 + n) / (1 + t.column("df").to_numpy()))[order] + 1


def unit_values(t: X.Terms, block: np.ndarray, idf: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(1 + ln count) * idf of each (row, term), and the sums of squares per row and block."""
    value = (1 + np.log(t.count)) * idf[t.term]
    squares = np.stack([np.bincount(t.row, value * value * (block[t.term] == b), n_rows) for b in range(len(X.BLOCKS))]).astype(float)
    return value, squares


def features(rows: DataFrame, codes: np.ndarray, block: np.ndarray, idf: np.ndarray, text: str = "text") -> DataFrame:
    """The rows with ``indices`` and ``values``: the weights 1 + ln tf times idf, each block of unit length."""
    sent = rows.sparkSession.sparkContext.broadcast((codes, block, idf))  # of the vocabularies' sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, block, idf = sent.value
        for texts, batch in _text_chunks(batches, text):
            t = X.Terms(texts, codes)
            value, squares = unit_values(t, block, idf, len(texts))
            value = value / np.sqrt(squares)[block[t.term], t.row]
            offsets = pa.array(np.searchsorted(t.row, np.arange(len(texts) + 1)).astype(np.int32))
            kept = [batch.column(c) for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, pa.array(t.term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(value))], [*(c for c in batch.schema.names if c != text), "indices", "values"])

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text]
    return rows.mapInArrow(run, ", ".join([*names, "indices array<int>", "values array<double>"]))


def sampled(rows: DataFrame, ident: str, sample_rows: int) -> DataFrame:
    """At most about ``sample_rows`` of the rows, chosen by a hash of the id."""
    n, steps = rows.count(), 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.col(ident), F.lit(1)), F.lit(steps)) < min(steps, steps * sample_rows // max(n, 1)))


class Softmax:
    """Multinomial regression over sparse rows: loss and gradient of the weights (a row per feature, the last one the intercepts).

    Equal rows are kept once, with how many of each label there are.  Features that stand in many rows form a dense matrix of bounded
    size; the others' products are summed class by class, as sums of contiguous numbers.
    """

    def __init__(self, sizes: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, features: int, classes: int, c: float):
        self.features, self.classes, self.c = features, classes, c
        edge = np.append(0, np.cumsum(sizes)).tolist()
        place: dict[bytes, int] = {}
        same = np.array([place.setdefault(xxhash.xxh3_128_digest(index[a:z].tobytes() + value[a:z].tobytes()), len(place)) for a, z in itertools.pairwise(edge)], np.int64)
        once = np.unique(same, return_index=True)[1]
        self.seen = np.zeros((len(once), classes))  # rows by label
        np.add.at(self.seen, (same, label), 1)
        self.times = self.seen.sum(axis=1, keepdims=True)
        kept = np.zeros(len(sizes), bool)
        kept[once] = True
        there = np.repeat(kept, sizes)
        row, index, value = np.repeat(same[kept], sizes[kept]), index[there], value[there].astype(np.float32)
        self.curvature = np.append(np.bincount(index, value.astype(float) ** 2 * self.times[row, 0], features), len(sizes)) * (classes - 1) / classes**2 + np.append(np.full(features, 1 / c), 0)
        found = np.bincount(index, minlength=features)
        often = np.argsort(-found, kind="stable")[: DENSE_BYTES // (4 * max(len(once), 1))]
        self.often = often[found[often] > DENSE_SHARE * len(once)]
        column = np.full(features, -1)
        column[self.often] = np.arange(len(self.often))
        dense = column[index] >= 0
        self.matrix = np.zeros((len(once), len(self.often)), np.float32)
        self.matrix[row[dense], column[index[dense]]] = value[dense]
        row, index, value = row[~dense], index[~dense], value[~dense]
        order = np.argsort(index, kind="stable")
        self.by_row = self._pieces(index, value, row)
        self.by_feature = self._pieces(row[order], value[order], index[order])

    @staticmethod
    def _pieces(where: np.ndarray, value: np.ndarray, group: np.ndarray, step: int = 1 << 20) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(where, value, the groups, where each begins) of so many entries at once; groups come in order."""
        out = []
        for a in range(0, len(where), step):
            g = group[a : a + step]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            out.append((where[a : a + step], value[a : a + step], g[first], first))
        return out

    @staticmethod
    def _sums(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], of: np.ndarray, n: int) -> np.ndarray:
        """Sums of value * of[where] per group."""
        out = np.zeros((n, of.shape[1]))
        for k in range(of.shape[1]):
            column = np.ascontiguousarray(of[:, k])
            for where, value, group, first in pieces:
                out[group, k] += np.add.reduceat(value * column[where], first)
        return out

    def __call__(self, flat: np.ndarray) -> tuple[float, np.ndarray]:
        w = flat.reshape(self.features + 1, self.classes)
        narrow = w[:-1].astype(np.float32)
        z = self._sums(self.by_row, narrow, len(self.seen)) + self.matrix @ narrow[self.often] + w[-1]
        z -= z.max(axis=1, keepdims=True)
        total = np.log(np.exp(z).sum(axis=1, keepdims=True))
        loss = (self.times * total).sum() - (self.seen * z).sum() + (w[:-1] ** 2).sum() / (2 * self.c)
        p = self.times * np.exp(z - total) - self.seen
        narrow = p.astype(np.float32)
        of_features = self._sums(self.by_feature, narrow, self.features)
        of_features[self.often] = self.matrix.T @ narrow
        return float(loss), np.concatenate([of_features + w[:-1] / self.c, p.sum(axis=0, keepdims=True)]).ravel()

    def fitted(self, rounds: int, tolerance: float) -> np.ndarray:
        """The weights of least loss, found in steps scaled by each weight's curvature at the start: frequent and rare features move alike."""
        scale = np.repeat(1 / np.sqrt(self.curvature), self.classes)

        def scaled(x: np.ndarray) -> tuple[float, np.ndarray]:
            loss, gradient = self(x * scale)
            return loss, gradient * scale

        return (minimise(scaled, np.zeros(len(scale)), rounds, tolerance) * scale).reshape(self.features + 1, self.classes)


def minimise(loss, start: np.ndarray, rounds: int, tolerance: float, memory: int = 6) -> np.ndarray:
    """Limited-memory BFGS with backtracking, until the loss falls by less than ``tolerance`` of itself."""
    x, (f, g) = start, loss(start)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, saved = -g, []
        for s, y, r in reversed(steps):
            saved.append(r * (s @ d))
            d = d - saved[-1] * y
        if steps:
            s, y, r = steps[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(saved), strict=True):
            d = d + (a - r * (y @ d)) * s
        slope = g @ d
        if slope >= 0:
            d, slope, steps = -g, -(g @ g), []
        size = 1.0 if steps else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        while True:
            new = x + size * d
            f_new, g_new = loss(new)
            if f_new <= f + 1e-4 * size * slope or size < 1e-12:
                break
            size /= 2
        done = f - f_new <= tolerance * abs(f_new) and (bool(steps) or size < 1e-12 or not g.any())  # the first step is a short one, whatever the loss
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1.0 / (s @ y))] if memory > 1 else [(s, y, 1.0 / (s @ y))]
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


def solve(rows: DataFrame, features: int, classes: int, c: float, rounds: int, tolerance: float) -> np.ndarray:
    """Weights (a row per feature, the last one the intercepts) for rows (label number, indices, values) of a bounded sample, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=pa.schema([("label", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])).combine_chunks()
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in t.column("indices").chunks)])
        flat = lambda name: np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in t.column(name).chunks)])
        problem = Softmax(sizes, flat("indices").astype(np.int64), flat("values"), t.column("label").to_numpy().astype(np.int64), features, classes, c)
        w = problem.fitted(rounds, tolerance)
        for a in range(0, len(w), 10_000):
            part = w[a : a + 10_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * classes), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), lists], ["feature", "weights"])

    found = rows.select("label", "indices", "values").coalesce(1).mapInArrow(run, "feature long, weights array<double>").toArrow()
    w = np.zeros((features + 1, classes))
    w[found.column("feature").to_numpy()] = found.column("weights").combine_chunks().flatten().to_numpy().reshape(-1, classes)
    return w


def fit_sample(rows: DataFrame, ident: str, sample_rows: int = SAMPLE_ROWS, c: float = 4.0, rounds: int = 3000, tolerance: float = 1e-5, word_features: int = WORD_FEATURES, character_features: int = CHARACTER_FEATURES) -> IntentModel:
    """Multinomial regression with a penalty of 1 / c, fitted on at most about ``sample_rows`` rows with a label (columns label, text)."""
    spark = rows.sparkSession
    path = shared_folder(spark, "sample")
    sampled(rows.select(ident, "label", "text"), ident, sample_rows).select("label", "text").write.parquet(f"{path}/texts")
    sample = spark.read.parquet(f"{path}/texts")
    codes, block, idf = vocabulary(sample, "text", word_features, character_features)
    classes = sorted(r["label"] for r in sample.select("label").distinct().collect())  # a row per class
    if len(classes) < 2:
        return IntentModel(codes, block, idf, np.zeros((len(codes), len(classes))), classes, np.zeros(len(classes)))
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("int") - 1
    features(sample, codes, block, idf).withColumn("label", label).write.parquet(f"{path}/features")
    w = solve(spark.read.parquet(f"{path}/features"), len(codes), len(classes), c, rounds, tolerance)
    return IntentModel(codes, block, idf, w[:-1], classes, w[-1])


BLOCK_COLUMNS = ["sizes", "feature", "place", "value", "often", "matrix", "seen"]


def feature_blocks(texts: DataFrame, codes: np.ndarray, block: np.ndarray, idf: np.ndarray) -> DataFrame:
    """The features of rows (text, seen), a row per block of texts, as bytes.

    Features that stand in many texts of a block (``often``) form a ``matrix``; the others are entries (``place`` among the block's
    ``feature`` numbers, ``value``), ``sizes`` of them per text.  ``seen``: how many of each label there are.
    """
    sent = texts.sparkSession.sparkContext.broadcast((codes, block, idf))  # of the vocabularies' sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, block, idf = sent.value
        for some, batch in _text_chunks(batches, "text", BLOCK_TEXTS):
            t = X.Terms(some, codes)
            value, squares = unit_values(t, block, idf, len(some))
            value = (value / np.sqrt(squares)[block[t.term], t.row]).astype(np.float32)
            feature, place, n = np.unique(t.term, return_inverse=True, return_counts=True)
            many = n > BLOCK_SHARE * len(some)
            number = np.where(many, np.cumsum(many), np.cumsum(~many)) - 1
            dense, at = many[place], number[place]
            matrix = np.zeros((len(some), many.sum()), np.float32)
            matrix[t.row[dense], at[dense]] = value[dense]
            seen = np.array(batch.column("seen").to_pylist(), float)
            at = at[~dense].astype(np.uint16 if (~many).sum() <= 1 << 16 else np.int32)
            out = (np.bincount(t.row[~dense], minlength=len(some)).astype(np.int32), feature[~many].astype(np.int32), at, value[~dense], feature[many].astype(np.int32), matrix, seen)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], BLOCK_COLUMNS)

    return texts.select("text", "seen").mapInArrow(run, ", ".join(f"`{c}` binary" for c in BLOCK_COLUMNS))


class Block:
    """A row of ``feature_blocks``."""

    def __init__(self, cells: list[bytes], classes: int):
        short = np.uint16 if 2 * len(cells[2]) == len(cells[3]) else np.int32
        sizes, self.feature, place, self.value, self.often, matrix, seen = (np.frombuffer(x, t) for x, t in zip(cells, (np.int32, np.int32, short, np.float32, np.int32, np.float32, float), strict=True))
        self.row, self.place = np.repeat(np.arange(len(sizes)), sizes), place.astype(np.int64)
        self.seen = seen.reshape(-1, classes)
        self.matrix = matrix.reshape(len(self.seen), len(self.often))
        self.times = self.seen.sum(axis=1, keepdims=True)

    def curvature(self, out: np.ndarray) -> None:
        """Adds each feature's squares, those of the intercepts, and how many of each label there are."""
        out[self.feature] += np.bincount(self.place, self.value.astype(float) ** 2 * self.times[self.row, 0], len(self.feature))
        out[self.often] += (self.matrix**2 * self.times).sum(axis=0)
        classes = self.seen.shape[1]
        out[-classes - 1] += self.times.sum()
        out[-classes:] += self.seen.sum(axis=0)

    def loss(self, w: np.ndarray, out: np.ndarray) -> float:
        """The loss of weights (a row per feature, the last one the intercepts); adds the gradient."""
        z, own = self.matrix @ w[self.often] + w[-1].astype(float), w[self.feature]
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(self.row, self.value * np.ascontiguousarray(own[:, k])[self.place], len(z))
        z -= z.max(axis=1, keepdims=True)
        total = np.log(np.exp(z).sum(axis=1, keepdims=True))
        p = self.times * np.exp(z - total) - self.seen
        narrow = p.astype(np.float32)
        out[self.often] += self.matrix.T @ narrow
        out[self.feature] += np.stack([np.bincount(self.place, self.value * np.ascontiguousarray(narrow[:, k])[self.row], len(self.feature)) for k in range(z.shape[1])], axis=1)
        out[-1] += p.sum(axis=0)
        return float((self.times * total).sum() - (self.seen * z).sum())


def _added_up(blocks: DataFrame, classes: int, shape: tuple[int, ...], visit: Callable[[Block, np.ndarray], float]) -> tuple[float, np.ndarray]:
    """What ``visit`` gives and adds to an array of the shape, over all blocks.  A task sends one array, cut into slices that are added up apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, total, some = np.zeros(shape), 0.0, False
        for batch in batches:
            for cells in zip(*(batch.column(c).to_pylist() for c in BLOCK_COLUMNS), strict=True):
                total, some = total + visit(Block(cells, classes), out), True
        flat = out.ravel()
        for k, a in enumerate(range(0, len(flat) if some else 0, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total if not k else 0.0]), pa.array([flat[a : a + SLICE].astype(np.float32).tobytes()], pa.binary())], ["slice", "total", "sums"])

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("total").to_pylist(), table.column("sums").to_pylist(), strict=True))  # sums of floats hang on their order
        sums = sum(np.frombuffer(x, np.float32).astype(float) for _, x in rows)
        return pa.table({"slice": table.column("slice")[:1], "total": pa.array([sum(t for t, _ in rows)]), "sums": pa.array([sums.tobytes()], pa.binary())})

    kinds = "slice int, total double, sums binary"
    found = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, kinds).groupBy("slice").applyInArrow(add, kinds).toArrow().sort_by("slice")  # an array of the vocabulary's size
    sums = [np.frombuffer(x) for x in found.column("sums").to_pylist()]
    return sum(found.column("total").to_pylist()), np.concatenate(sums).reshape(shape) if sums else np.zeros(shape)


def solve_blocks(blocks: DataFrame, features: int, classes: int, c: float, rounds: int, tolerance: float) -> np.ndarray:
    """The weights of least loss (a row per feature, the last one the intercepts) over all blocks, in steps scaled by each weight's curvature at the start."""
    spark, n = blocks.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(n)
    spark.conf.set(n, str(BLOCKS_AT_ONCE))
    try:
        squares, labels = np.split(_added_up(blocks, classes, (features + 1 + classes,), lambda b, out: b.curvature(out) or 0.0)[1], [features + 1])
        start = np.vstack([np.zeros((features, classes)), np.log(labels / labels.sum())])  # without features, the least loss
        scale = np.repeat(1 / np.sqrt(squares * (classes - 1) / classes**2 + np.append(np.full(features, 1 / c), 0)), classes)

        def scaled(x: np.ndarray) -> tuple[float, np.ndarray]:
            w = (x * scale).reshape(features + 1, classes)
            sent = spark.sparkContext.broadcast(w.astype(np.float32))  # of the vocabulary's size
            loss, gradient = _added_up(blocks, classes, w.shape, lambda b, out: b.loss(sent.value, out))
            sent.destroy()
            gradient[:-1] += w[:-1] / c
            return loss + (w[:-1] ** 2).sum() / (2 * c), gradient.ravel() * scale

        return (minimise(scaled, start.ravel() / scale, rounds, tolerance) * scale).reshape(features + 1, classes)
    finally:
        spark.conf.set(n, before)


def fit(rows: DataFrame, c: float = 4.0, rounds: int = 3000, tolerance: float = 1e-5, word_features: int = WORD_FEATURES, character_features: int = CHARACTER_FEATURES) -> IntentModel:
    """Multinomial regression with a penalty of 1 / c, fitted on all rows with a label (columns label, text)."""
    spark = rows.sparkSession
    path = shared_folder(spark, "fit")
    rows = rows.where("label IS NOT NULL")
    classes = sorted(r["label"] for r in rows.select("label").distinct().collect())  # a row per class
    seen = [F.count_if(F.col("label") == k) for k in classes]
    rows.groupBy("text").agg(F.array(*seen).cast("array<double>").alias("seen"), F.count(F.lit(1)).alias("times")).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    codes, block, idf = vocabulary(texts, "text", word_features, character_features, times="times")
    if len(classes) < 2:
        return IntentModel(codes, block, idf, np.zeros((len(codes), len(classes))), classes, np.zeros(len(classes)))
    feature_blocks(texts, codes, block, idf).write.option("compression", "zstd").parquet(f"{path}/blocks")
    w = solve_blocks(spark.read.parquet(f"{path}/blocks"), len(codes), len(classes), c, rounds, tolerance)
    return IntentModel(codes, block, idf, w[:-1], classes, w[-1])


def predict(rows: DataFrame, model: IntentModel, ident: str = "doc_id", text: str = "text", least: int = 5, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows without their text, with pred and proba_max.  Texts that are null or shorter than ``least`` get none (null, 0.0).
    proba_max is a double: a float in between would turn some roundings.

    Models beyond ``part_bytes`` are sent in several parts; then the parts' sums meet by ``ident``, which names a row.
    """
    spark, parts, k = rows.sparkSession, model.parts(part_bytes), len(model.classes)
    if not k:
        return rows.drop(text).withColumns({"pred": F.lit(None).cast("string"), "proba_max": F.lit(0.0)})
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text]

    def partial(sent, kept: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, block, idf, weights = sent.value
            for texts, batch in _text_chunks(batches, text):
                place: dict[str | None, int] = {}
                same = np.array([place.setdefault(x, len(place)) for x in texts], np.int64)  # repeated texts are scored once
                t, n = X.Terms(list(place), codes), len(place)
                value, squares = unit_values(t, block, idf, n)
                edge = np.searchsorted(t.row, np.arange(n))
                sums = np.zeros((len(X.BLOCKS), n, k))
                some = np.flatnonzero(np.bincount(t.row, minlength=n)) if n else np.zeros(0, int)
                for b in range(len(X.BLOCKS)):
                    if len(some):
                        sums[b, some] = np.add.reduceat((value * (block[t.term] == b))[:, None] * weights[t.term], edge[some], axis=0)
                n, squares, sums = len(texts), squares[:, same], sums[:, same]
                lists = [pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * w).astype(np.int32)), pa.array(x.reshape(-1))) for x, w in ((squares.T, len(X.BLOCKS)), (sums.transpose(1, 0, 2), len(X.BLOCKS) * k))]
                short = pa.array([len(x or "") < least for x in texts])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), short, *lists], [*kept, "__short", "__squares", "__sums"])

        return run

    kept = [f.name for f in rows.schema.fields if f.name != text]
    added = ["__short boolean", "__squares array<double>", "__sums array<double>"]
    frames = [rows.mapInArrow(partial(spark.sparkContext.broadcast(p), kept), ", ".join([*others, *added])) for p in parts]
    out = frames[0]
    if len(frames) > 1:
        add = lambda c: F.transform(F.sequence(F.lit(0), F.size(F.first(c)) - 1), lambda i: F.aggregate(F.collect_list(c), F.lit(0.0), lambda s, x: s + F.get(x, i)))  # noqa: E731  a list per part
        every = frames[0].select(ident, "__squares", "__sums")
        for f in frames[1:]:
            every = every.unionAll(f.select(ident, "__squares", "__sums"))
        out = frames[0].drop("__squares", "__sums").join(every.groupBy(ident).agg(add("__squares").alias("__squares"), add("__sums").alias("__sums")), ident)
    blocks = range(len(X.BLOCKS))
    score = F.array(*(F.lit(float(b)) + sum((F.coalesce(F.try_divide(F.get("__sums", F.lit(j * k + i)), F.sqrt(F.get("__squares", F.lit(j)))), F.lit(0.0)) for j in blocks), F.lit(0.0)) for i, b in enumerate(model.intercepts)))
    out = out.withColumn("__score", score).withColumn("__top", F.array_max("__score"))
    total = F.aggregate(F.transform("__score", lambda v: F.exp(v - F.col("__top"))), F.lit(0.0), lambda a, v: a + v)
    pred = F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("__score", F.col("__top")).cast("int"))
    return out.select(*(f"`{c}`" for c in kept), F.when(~F.col("__short"), pred).alias("pred"), F.when(F.col("__short"), 0.0).otherwise(1 / total).alias("proba_max"))


def train_and_predict(rows: DataFrame, ident: str = "doc_id", sample_rows: int = SAMPLE_ROWS, least: int = 5, **options) -> DataFrame:
    """Trains on at most about ``sample_rows`` rows of the 80 % side of a hash split and predicts all: id, label, pred, proba_max, is_test."""
    rows = rows.select(ident, "label", "text").withColumn("is_test", F.pmod(F.xxhash64(ident), F.lit(5)) == 0)
    model = fit_sample(rows.where("NOT is_test AND label IS NOT NULL"), ident, sample_rows, **options)
    return predict(rows, model, ident, least=least).select(ident, "label", "pred", F.col("proba_max").cast("float").alias("proba_max"), "is_test")


def predict_shards(conversations: DataFrame, model: IntentModel) -> DataFrame:
    """INTENT rows (conv_id, intent, proba_max, shard) of conversations; those with an empty input or hardly a text get none."""
    usable = F.when(~F.col("has_empty_user_input"), F.col("intent_text"))
    rows = conversations.select("conv_id", "shard", usable.alias("text"))
    return predict(rows, model, "conv_id").select("conv_id", F.col("pred").alias("intent"), F.col("proba_max").cast("float").alias("proba_max"), "shard")


def softmax_scores(rows: DataFrame, weights: DataFrame, classes: list[str], intercepts: list[float], ident: str = "doc_id", text: str = "text", least: int = 5, part_bytes: int = PART_BYTES) -> DataFrame:
    """Predictions from exported weights (block, term, idf, a weight per class): id, pred, proba_max."""
    return predict(rows.select(ident, F.col(text).alias("text")), IntentModel.read(weights, classes, intercepts), ident, "text", least, part_bytes)

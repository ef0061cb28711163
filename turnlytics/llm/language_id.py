"""Language identification with bit-sliced Bloom filters of n-grams.

A language's n-grams are those of its training texts with at least ``min_share`` of all its n-grams and at least
``min_ratio`` of the share they have in any other language.  All languages share one filter whose slots hold a bit per
language: the AND of an n-gram's slots is the set of languages that hold it.  A document's n-grams are looked up at once,
set bits are counted per language, and each count is corrected for that language's share of false positives, which
follows from the part of the slots that have its bit.  The largest corrected count decides.

Texts are lower-cased; runs of ASCII non-letters count as one space, and a text starts and ends with one.  n-grams are of
bytes.  Fitting takes every language, and at most about ``per_language`` texts for each, chosen by a hash of id and text; a language
has at most 1 / min_share n-grams, which bounds what the driver gathers and sends.  n-grams seen once are left out unless a
language of fewer than ``few_texts`` texts holds them.  Prediction reads every whole text and uses nothing but the text.

Rejecting asks for a share of known n-grams: half of what nearly all training texts of the language have, with a margin for
short texts.  Texts of a handful of n-grams pass with any evidence.

Defined results: a null text, or one without a letter, is ``und`` with score 0.  A text none of whose n-grams are known gets
the most frequent training language with score 0.  Ties go to the language that is more frequent, then first by name.
Without training rows, every text is ``und``.  Repeated rows give repeated results.  Empty tables give no rows.  Texts of any
length are read whole.  Other columns, whatever their names, play no part; ``reject_unidentified`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_CODES, as_long, mix, powers, small_batches, text_buffer, text_chunks

UNDETERMINED = "und"
_GRAM_BASE = 0x9E3779B97F4A7C15
CLEAN = np.arange(256, dtype=np.uint8)
CLEAN[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Filter:
    """Slots of the bit-sliced filter; with more than 64 languages a slot has several words.

    A floor is the share of known n-grams that a text of the language has at least.
    """

    languages: list[str]
    sizes: Sequence[int]
    hashes: int
    slots: np.ndarray
    false_positives: np.ndarray
    floors: np.ndarray | None = None

    def masks(self, grams: np.ndarray) -> np.ndarray:
        found = None
        for k in range(self.hashes):
            here = self.slots[_slot(grams, k, len(self.slots))]
            found = here if found is None else found & here
        return found


def _slot(grams: np.ndarray, k: int, n: int) -> np.ndarray:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return ((grams + np.uint64(k) * step) & np.uint64(n - 1)).astype(np.int64)


def _grams(texts: pa.Array, sizes: Sequence[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each size: the n-gram hashes of all texts, and the index of each text's first one (n + 1 entries)."""
    data, offsets = text_buffer(pc.utf8_lower(texts))
    n = len(offsets) - 1
    data = np.insert(CLEAN[data], np.repeat(offsets[:-1], 1), 32)
    offsets = offsets + np.arange(n + 1)
    keep = np.ones(len(data), bool)
    if len(data):
        keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offsets[:-1]] = True
    total = np.append(0, np.cumsum(keep))
    data, offsets = data[keep], total[offsets]
    blank = data[offsets[1:] - 1] != 32  # a text that doesn't end with a space gets one
    data = np.insert(data, offsets[1:][blank], 32)
    offsets = offsets + np.append(0, np.cumsum(blank))
    power, inverse = powers(_GRAM_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * power[: len(data)], out=sums[1:])
    hashes, firsts = [], []
    for size in sizes:
        count = max(len(data) - size + 1, 0)
        here = mix((sums[size : size + count] - sums[:count]) * inverse[:count] + np.uint64(size))
        inside = np.arange(count) + size <= np.repeat(offsets[1:], np.diff(offsets))[:count]
        total = np.append(0, np.cumsum(inside))
        hashes.append(here[inside])
        firsts.append(total[np.minimum(offsets, count)])
    return hashes, firsts


def fit(training: DataFrame, sizes: Sequence[int] = (3, 5), per_language: int = 2000, min_share: float = 1e-5, min_ratio: float = 0.25, few_texts: int = 200, slots: int = 1 << 20, hashes: int = 3, floors: bool = True) -> Filter:
    """Learn from (doc_id, text, lang).  ``floors`` are needed to reject texts, not to identify them."""
    small_batches(training.sparkSession)
    known = training.where("text is not null and lang is not null")
    counts = [(r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()]  # a row per language
    languages = [x for x, _ in counts]
    if not languages:
        return Filter([], sizes, hashes, np.zeros(slots, np.uint8), np.zeros(0), np.zeros(0))
    steps = 1 << 30
    share = F.element_at(F.create_map(*[F.lit(y) for x, n in counts for y in (x, min(steps, steps * per_language // n))]), F.col("lang"))
    number = F.element_at(F.create_map(*[F.lit(y) for i, x in enumerate(languages) for y in (x, i)]), F.col("lang"))
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)) < share).select(number.alias("number"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for b in text_chunks(batch, "text", 1 << 20):
                found, firsts = _grams(b.column("text"), sizes)
                owner = b.column("number").to_numpy()
                for hashes_here, first in zip(found, firsts, strict=True):
                    by = np.repeat(owner, np.diff(first))
                    for i in np.unique(owner):
                        keys, n = np.unique(hashes_here[by == i], return_counts=True)
                        if i in seen:
                            keys, back = np.unique(np.concatenate([seen[i][0], keys]), return_inverse=True)
                            n = np.bincount(back, np.concatenate([seen[i][1], n]), len(keys)).astype(np.int64)
                        seen[i] = keys, n
        for i, (keys, n) in seen.items():
            for at in range(0, len(keys), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), i), pa.int32()), pa.array(as_long(keys[part])), pa.array(n[part], pa.int64())], ["number", "gram", "n"])

    grams = sample.mapInArrow(count, "number int, gram long, n long").groupBy("gram", "number").agg(F.sum("n").alias("n"))
    grams = grams.groupBy("gram").agg(F.collect_list(F.struct("number", "n")).alias("by"), F.sum("n").alias("n"))  # a list has an entry per language
    rare = next((i for i, (_, n) in enumerate(counts) if n < few_texts), len(counts))  # languages are numbered from the most frequent on
    grams = grams.where((F.col("n") > 1) | F.exists("by", lambda x: x["number"] >= rare))
    grams = grams.persist()
    try:
        totals = {r["number"]: r["n"] for r in grams.select(F.explode("by").alias("b")).groupBy("b.number").agg(F.sum("b.n").alias("n")).collect()}
        part = F.element_at(F.create_map(*[F.lit(y) for i in range(len(languages)) for y in (i, float(max(totals.get(i, 0), 1)))]), F.col("b.number"))
        shares = grams.select("gram", F.explode("by").alias("b")).select("gram", F.col("b.number").alias("number"), (F.col("b.n") / part).alias("share"))
        best = shares.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("number", "share")).alias("by"))
        chosen = best.where(F.col("top") >= min_share).select("gram", F.expr(f"transform(filter(by, x -> x.share >= {min_share!r} and x.share >= {min_ratio!r} * top), x -> x.number)").alias("numbers")).toArrow()
    finally:
        grams.unpersist()
    keys = chosen.column("gram").to_numpy().view(np.uint64)
    lists = chosen.column("numbers").combine_chunks()
    numbers, owners = lists.flatten().to_numpy(), np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
    kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= bits or bits == 64)
    width = -(-len(languages) // 64)
    table = np.zeros((slots, width), kind)
    for k in range(hashes):
        at = _slot(keys, k, slots)
        for i in range(len(languages)):
            table[at[owners[numbers == i]], i // 64] |= kind(1 << (i % 64))
    filled = np.array([np.count_nonzero(table[:, i // 64] & kind(1 << (i % 64))) / slots for i in range(len(languages))])
    model = Filter(languages, sizes, hashes, table[:, 0].copy() if width == 1 else table, filled**hashes)
    if floors:
        model.floors = learn_floors(sample, model)
    return model


def learn_floors(sample: DataFrame, model: Filter) -> np.ndarray:
    """Per language, half of what all but one in a hundred of its training texts (number, text) have as share of known n-grams."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                counts, total = evidence(sent.value, b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("number"), pa.array(counts.max(axis=1) / np.maximum(total, 1))], ["number", "share"])

    low = sample.where(has_letter(F.col("text"))).mapInArrow(shares, "number int, share double").groupBy("number").agg(F.percentile_approx("share", 0.01).alias("low"))
    floors = np.zeros(len(model.languages))
    for r in low.collect():  # a row per language
        floors[r["number"]] = r["low"] / 2
    return floors


def evidence(model: Filter, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the corrected count per language, and the number of n-grams."""
    n = len(texts)
    hits, total = np.zeros((n, len(model.languages))), np.zeros(n)
    found, firsts = _grams(texts, model.sizes)
    for grams, first in zip(found, firsts, strict=True):
        total += np.diff(first)
        masks = model.masks(grams)
        for i in range(len(model.languages)):
            column = masks[:, i // 64] if masks.ndim == 2 else masks
            sums = np.append(0, np.cumsum((column >> column.dtype.type(i % 64)) & column.dtype.type(1), dtype=np.int64))
            hits[:, i] += np.diff(sums[first])
    fp = model.false_positives
    return np.maximum((hits - total[:, None] * fp) / np.maximum(1 - fp, 1e-9), 0.0), total


def predict_batch(model: Filter, texts: pa.Array, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    counts, _ = evidence(model, texts)
    together = counts.sum(axis=1)
    best = counts.argmax(axis=1)
    score = np.divide(counts.max(axis=1), together, out=np.zeros(len(best)), where=together > 0)
    return [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, lettered, strict=True)], np.clip(np.where(lettered, score, 0.0), 0.0, 1.0)


def known(model: Filter, texts: pa.Array) -> np.ndarray:
    """Has a text as many known n-grams of its best language as the floor asks, less three standard deviations?"""
    if not model.languages:
        return np.zeros(len(texts), bool)
    counts, total = evidence(model, texts)
    floor = model.floors[counts.argmax(axis=1)]
    most = counts.max(axis=1)
    return (most > 0) & (most >= total * floor - 3 * np.sqrt(total * floor * (1 - floor)))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Filter, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, lang_pred, score (the best language's part of all evidence)."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), has_letter(F.col(text_column)).alias("lettered"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                languages, score = predict_batch(sent.value, b.column("text"), b.column("lettered").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(languages, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def reject_unidentified(docs: DataFrame, model: Filter, text_column: str = "text") -> DataFrame:
    """The documents, all columns unchanged, whose language is found: those with a letter and enough n-grams of a learned language."""
    if model.floors is None:
        raise ValueError("the filter was fitted without floors")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, flag = docs.columns, "__lettered"
    while flag in names:
        flag += "_"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, text_column):
                good = b.column(flag).to_numpy(zero_copy_only=False) & known(sent.value, b.column(text_column))
                yield b.filter(pa.array(good)).select(names)

    return docs.withColumn(flag, has_letter(F.col(text_column))).mapInArrow(keep, docs.schema)

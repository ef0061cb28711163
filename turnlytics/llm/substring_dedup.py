"""Substring de-duplication by relative Lempel-Ziv parsing.

Every document is factored against reference blocks: ``block`` consecutive words of an earlier document (one with a smaller id)
and the words that complete its last windows; a window is ``window`` consecutive words.  The parse goes from left to right.  At the
first position whose window stands in a block, every place in the blocks that has it is extended word by word, and the
longest match becomes a factor.  The parse goes on at the factor's end; windows that straddle this boundary are looked
up as well, so no duplicate passage is lost between two references.  Factors have at least ``window`` words; the words that they
cover are removed.  Matches compare the words themselves, hashes only find them.

Which blocks a document needs: each window has an anchor, the least hash of its runs of ``gram`` words; windows with equal words
have equal anchors, and neighbours mostly share theirs, so documents are first compared by anchors alone (about one for
twenty words).  Windows are listed only where another document has the same anchor, and the first document that holds a
window gives the block.  Blocks are some hundred words, so what a document is sent follows the length of what it repeats,
not the length of the documents that it repeats.  Documents whose whole word sequence stands in an earlier one are a
single factor.

Defined results: null texts have no words.  Rows with a null id are left as they are and are no reference.  Rows are told apart by
id and text: rows that repeat both get the same result, rows that repeat an id with another text are parsed on their own and are no
reference for each other.  Empty tables give empty results.  Texts of any length are parsed whole.  Of equal matches, the one
in the smallest reference, then the first there, is taken.  Other columns, whatever their names, play no part.  Ids may have any
type that can be ordered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, Scratch, as_long, hash_runs, hash_words, list_array, sliding_min, small_batches, text_buffer, text_chunks, within, word_spans

BLOCK = 128


def _windows(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: each window's hash, its anchor and whether it lies within one text; each text's first word."""
    data, offsets = text_buffer(texts)
    starts, ends, first = word_spans(data, offsets, NON_SPACE)
    words = hash_words(data, starts, ends)
    hashes = hash_runs(words, window)
    anchors = sliding_min(hash_runs(words, gram), window - gram + 1) if len(hashes) else hashes
    return hashes, anchors, within(first, window, len(hashes)), first


def _sketch(docs: DataFrame, window: int, gram: int, kind: str) -> DataFrame:
    """doc_id, text_key, n_words, digest of the words joined by one space, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                _, anchors, inside, first = _windows(b.column("text"), window, gram)
                new = inside.copy()
                new[1:] &= (anchors[1:] != anchors[:-1]) | ~inside[:-1]
                total = np.append(0, np.cumsum(new))
                per = np.diff(total[np.minimum(first, len(new))])
                data, offsets = text_buffer(b.column("text"))
                raw = data.tobytes()
                digests = [hashlib.sha256(b" ".join(raw[a:z].split())).hexdigest() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = [b.column("doc_id"), b.column("text_key"), pa.array(np.diff(first), pa.int64()), pa.array(digests), list_array(as_long(anchors[new]), per, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_words", "digest", "anchors"])

    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, n_words long, digest string, anchors array<long>")


def _list_windows(texts: DataFrame, window: int, gram: int, kind: str) -> DataFrame:
    """Of (doc_id, text, anchors): the windows that have one of the anchors, as (doc_id, window, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                hashes, anchors, inside, first = _windows(b.column("text"), window, gram)
                wanted, parts = b.column("anchors"), []
                for i in range(b.num_rows):
                    a, z = first[i], min(first[i + 1], len(hashes))
                    if a < z:
                        at = np.flatnonzero(inside[a:z] & np.isin(as_long(anchors[a:z]), wanted[i].values.to_numpy()))
                        parts.append((np.full(len(at), i), as_long(hashes[a:z][at]), at))
                if parts:
                    row, w, start = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(w, pa.int64()), pa.array(start, pa.int32())], ["doc_id", "window", "start"])

    return texts.mapInArrow(run, f"doc_id {kind}, window long, start int")


def _cut_blocks(texts: DataFrame, window: int, block: int, kind: str) -> DataFrame:
    """Of (doc_id, text, numbers): the text's blocks with these numbers, as (source, number, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                row, number, words = [], [], []
                for i, (text, numbers) in enumerate(zip(b.column("text").to_pylist(), b.column("numbers").to_pylist(), strict=True)):
                    parts = text.encode().split()
                    for k in sorted(numbers):
                        if k * block + window <= len(parts):
                            row.append(i)
                            number.append(k)
                            words.append(b" ".join(parts[k * block : (k + 1) * block + window - 1]).decode())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(words, pa.string())], ["source", "number", "words"])

    return texts.mapInArrow(run, f"source {kind}, number int, words string")


def joined_blocks(blocks: list[dict], window: int, block: int = BLOCK) -> list[tuple]:
    """(source, first word, words) of the blocks in order; blocks that follow each other in one text become one."""
    out: list[tuple] = []
    for b in sorted(blocks, key=lambda b: (b["source"], b["number"], b["words"])):
        words, start = b["words"].encode().split(), b["number"] * block
        if out and out[-1][0] == b["source"] and out[-1][1] + len(out[-1][2]) == start + window - 1 and out[-1][2][1 - window :] == words[: window - 1]:
            out[-1][2].extend(words[window - 1 :])
        else:
            out.append((b["source"], start, words))
    return out


def parse(words: list[bytes], references: list[tuple], window: int) -> list[dict]:
    """The factors of a document, given its words and references (source, place of their first word in it, words)."""
    every = words + [w for _, _, part in references for w in part]
    n, first = len(words), np.cumsum([0, len(words), *(len(part) for _, _, part in references)])
    data, offsets = text_buffer(pa.array([b" ".join(every)], pa.binary()))
    starts, ends, _ = word_spans(data, offsets, NON_SPACE)
    hashes = hash_words(data, starts, ends)
    runs = hash_runs(hashes, window)
    inside = within(first, window, len(runs))
    mine, places = runs[: max(n - window + 1, 0)], np.flatnonzero(inside[n:]) + n
    places = places[np.argsort(runs[places], kind="stable")]
    low, high = (np.searchsorted(runs[places], mine, side) for side in ("left", "right"))
    found = np.flatnonzero(low < high)
    factors: list[dict] = []
    at = 0
    while at < len(found):
        i = int(found[at])
        longest, where = 0, -1
        for r in places[low[i] : high[i]].tolist():
            most = min(n - i, int(first[np.searchsorted(first, r, "right")]) - r)
            differs = np.flatnonzero(hashes[i : i + most] != hashes[r : r + most])
            length = int(differs[0]) if len(differs) else most
            if every[i : i + length] != every[r : r + length]:  # equal hashes of different words
                length = next(k for k in range(length) if every[i + k] != every[r + k])
            if length > longest:
                longest, where = length, r
        on = i + 1
        if longest >= window:
            k = int(np.searchsorted(first, where, "right")) - 2
            source, place, _ = references[k]
            factors.append({"first_word": i, "words": longest, "source": source, "source_word": place + where - int(first[k + 1])})
            on = max(on, i + longest - window + 1)  # from here on, windows straddle the factor's end
        at = int(np.searchsorted(found, on))
    return factors


def _cut(texts: DataFrame, window: int, block: int, kind: str) -> DataFrame:
    """Of (doc_id, text_key, text, blocks): doc_id, text_key, n_removed, factors, the kept words joined by one space."""
    factor = f"array<struct<first_word:int,words:int,source:{kind},source_word:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.schema.field("blocks").type.value_type.field("source").type
            item = pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("source", source), ("source_word", pa.int32())])
            schema = pa.schema([("doc_id", source), ("text_key", pa.int64()), ("n_removed", pa.int64()), ("factors", pa.list_(item)), ("kept_text", pa.string())])
            for b in text_chunks(batch, "text"):
                rows = []
                for row in b.to_pylist():
                    words = row["text"].encode().split()
                    factors = parse(words, joined_blocks(row["blocks"], window, block), window)
                    gone = bytearray(len(words))
                    for f in factors:
                        gone[f["first_word"] : f["first_word"] + f["words"]] = b"\1" * f["words"]
                    kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
                    if factors:
                        rows.append({"doc_id": row["doc_id"], "text_key": row["text_key"], "n_removed": sum(gone), "factors": factors, "kept_text": kept.decode()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return texts.mapInArrow(run, f"doc_id {kind}, text_key long, n_removed long, factors {factor}, kept_text string")


def duplicate_passages(docs: DataFrame, window: int = 50, gram: int = 12, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables.  All documents: doc_id, text_key, n_words, digest (SHA-256 of the words joined by one space).  The changed ones:
    doc_id, text_key, n_removed, factors (first word, words, reference document and place in it), kept_text (kept words
    joined by one space).  ``text_key`` is Spark's xxhash64 of the text."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "passages")
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column)).alias("text_key"), F.col(text_column).alias("text"))
    kind, row = narrow.schema["doc_id"].dataType.simpleString(), ["doc_id", "text_key"]
    sketches = scratch.table(_sketch(narrow, window, gram, kind), "sketches")
    long_ones = sketches.where(f"doc_id is not null and n_words >= {window}")
    with scratch.inner("steps") as inner:
        repeated = inner.table(long_ones.groupBy("digest").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("digest", "source"), "repeated")
        copies = inner.table(long_ones.select(*row, "digest", "n_words").join(repeated, "digest").where("doc_id > source").select(*row, "n_words", "source").dropDuplicates(row), "copies")
        anchors = inner.table(long_ones.join(copies.select(*row), row, "left_anti").select(*row, F.explode("anchors").alias("anchor")), "anchors")
        common = inner.table(anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "common-anchors")
        wanted = anchors.join(common, "anchor").groupBy(*row).agg(F.collect_set("anchor").alias("anchors"))
        texts = inner.table(narrow.join(wanted, row), "texts")
        windows = inner.table(_list_windows(texts, window, gram, kind), "windows")
        firsts = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.max("doc_id").alias("last")).where("f.doc_id < last")
        firsts = inner.table(firsts.select("window", F.col("f.doc_id").alias("source"), F.floor(F.col("f.start") / block).cast("int").alias("number")), "first-windows")
        needs = inner.table(windows.join(firsts, "window").where("doc_id > source").select("doc_id", "source", "number").distinct(), "needs")
        numbers = needs.groupBy("source").agg(F.collect_set("number").alias("numbers")).withColumnRenamed("source", "doc_id")  # at most a text's own blocks
        blocks = inner.table(_cut_blocks(texts.select("doc_id", "text").join(numbers, "doc_id"), window, block, kind).distinct(), "blocks")
        sent = needs.join(blocks, ["source", "number"]).groupBy("doc_id").agg(F.collect_list(F.struct("source", "number", "words")).alias("blocks"))
        cut = _cut(texts.select(*row, "text").join(sent, "doc_id"), window, block, kind).dropDuplicates(row)
        whole = F.array(F.struct(F.lit(0).alias("first_word"), F.col("n_words").cast("int").alias("words"), F.col("source"), F.lit(0).alias("source_word")))
        gone = copies.select(*row, F.col("n_words").alias("n_removed"), whole.alias("factors"), F.lit("").alias("kept_text"))
        changed = scratch.table(cut.unionByName(gone), "changed")
    return sketches.select(*row, "n_words", "digest"), changed

"""Benchmark decontamination by pigeonhole edit matching.

An item of m words may stand in a document with up to k = floor(max_error * m) word edits.  Cut into k + 1 pieces, at least one piece
then stands there unchanged.  Tasks look up the hashes of all word runs that have a piece's length in a sorted table of piece
hashes; around each hit, Myers' bit-parallel algorithm (a bit per word of the item) finds the least edit distance of the item
to any run of the document's words.  Items whose budget is 0 are one piece, so a hit of theirs is the whole item.

Words are runs of characters other than ASCII non-alphanumerics, lower-cased.  In scripts that write no spaces between words
(``UNSPACED``) every character is a word, and the punctuation of these scripts separates words.  The items go to the tasks
in blocks of at most ``block_words`` words, one pass over the documents per block, so what is sent has a fixed bound.

Every item with a word is searched.  As a word or two may stand anywhere by chance, ``remove_leaks`` lets an item of fewer than
``short_words`` words remove a document only if the item makes up at least ``short_share`` of the document's words.

Defined results: null, empty and wordless texts match nothing, on either side; empty tables give no rows (and remove nothing).
Texts of any length are searched whole.  Repeated rows of either table give repeated rows.  Of several places of an item in
a document, the one with the least distance, then the first, is returned.  Other columns of either table, whatever their
names, play no part in searching and pass unchanged through removing.  Ids may have any type.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_class, hash_runs, hash_words, small_batches, spans, text_buffer, text_chunks
from .license_scan import NOT_WORD

IS_WORD = byte_class(but=NOT_WORD)

# Code points (first, last) of scripts without spaces between words, and of their punctuation.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
PUNCTUATION = [(0x3000, 0x3004), (0x3008, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]


def _among(points: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    found = np.zeros(len(points), bool)
    for low, high in ranges:
        found |= (points >= low) & (points <= high)
    return found


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word (n + 1 entries)."""
    data, offsets = text_buffer(pc.utf8_lower(texts))
    inside, edge = IS_WORD[data], np.zeros(len(data) + 1, bool)
    lead = np.flatnonzero(data >= 0xE0)  # characters of three or four bytes
    if len(lead):
        size = np.where(data[lead] >= 0xF0, 4, 3)
        tail = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) & 63 for i in (1, 2, 3)]
        three = (data[lead].astype(np.int64) & 15) << 12 | tail[0] << 6 | tail[1]
        four = (data[lead].astype(np.int64) & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
        point = np.where(size == 4, four, three)
        own, gap = _among(point, UNSPACED), _among(point, PUNCTUATION)
        edge[lead[own]] = edge[(lead + size)[own]] = True
        for i in range(3):
            inside[lead[gap] + i] = False
    starts, ends, first = spans(inside, edge, offsets)
    return hash_words(data, starts, ends), first


def pieces(m: int, errors: int) -> list[tuple[int, int]]:
    """(start, length) of the errors + 1 pieces of m words."""
    n = errors + 1
    cuts = [m * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class Items:
    """A block of items (id, text, how many rows hold them) with the table of their pieces."""

    def __init__(self, rows: list[tuple[object, str, int]], max_error: float):
        hashes, first = words_of(pa.array([t for _, t, _ in rows], pa.string()))
        self.ids, self.words, self.errors, self.times = [], [], [], []
        found = defaultdict(list)
        for i, (item, _, times) in enumerate(rows):
            words = hashes[first[i] : first[i + 1]]
            if not len(words):
                continue
            errors = min(int(max_error * len(words)), len(words) - 1)
            for start, length in pieces(len(words), errors):
                found[length].append((int(hash_runs(words[start : start + length], length)[0]), len(self.ids), start))
            self.ids.append(item)
            self.words.append(words)
            self.errors.append(errors)
            self.times.append(times)
        self.exact = np.array([e == 0 for e in self.errors], bool)
        self.tables = {}
        for length, entries in sorted(found.items()):
            entries.sort()
            keys = np.array([e[0] for e in entries], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.tables[length] = keys, np.array([e[1:] for e in entries], np.int64), seen

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int], list[int]]]:
        """Whole items: (document, item, first place).  Others: (document, item) -> where in ``hashes`` the item would start if all
        words before its piece were there."""
        rows = []
        for length, (keys, entries, seen) in self.tables.items():
            runs = hash_runs(hashes, length)
            at = np.flatnonzero(seen[(runs >> np.uint64(44)).astype(np.int64)])
            left, right = np.searchsorted(keys, runs[at], "left"), np.searchsorted(keys, runs[at], "right")
            doc = np.searchsorted(first, at, "right") - 1
            some = (left < right) & (at + length <= first[doc + 1])
            at, left, doc, count = at[some], left[some], doc[some], (right - left)[some]
            entry = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
            item, start = entries[entry].T
            rows.append(np.stack([np.repeat(doc, count), item, np.repeat(at, count) - start]))
        found = np.unique(np.concatenate(rows, axis=1), axis=1) if rows else np.zeros((3, 0), np.int64)
        new = np.append(True, (found[:2, 1:] != found[:2, :-1]).any(axis=0))[: found.shape[1]]
        exact = self.exact[found[1]] if found.shape[1] else new
        out: dict[tuple[int, int], list[int]] = defaultdict(list)
        for d, i, s in found[:, ~exact].T.tolist():
            out[d, i].append(s)
        return found[:, exact & new].T.tolist(), out


def least_distance(pattern: list, text: list, anchored: bool = False) -> tuple[int, int]:
    """Myers: the least edit distance of the pattern to any run of words that ends in the text, and the first end that has it.

    ``anchored``: to runs that start where the text does.
    """
    m = len(pattern)
    where: dict = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        same = where.get(w, 0)
        across = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = ((up << 1) | anchored) & full
        down = (down << 1) & full
        plus = down | (full & ~((same | minus) | up))
        minus = up & (same | minus)
        if score < best:
            best, end = score, j
    return best, end


def verify(words: np.ndarray, item: np.ndarray, starts: list[int], errors: int, low: int, high: int) -> tuple[int, int, int] | None:
    """The best place near the given starts: distance, first word and end, or None if all exceed the errors."""
    regions: list[list[int]] = []
    for s in sorted(starts):
        a, z = max(low, s - errors), min(high, s + len(item) + errors)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(z, regions[-1][1])
        else:
            regions.append([a, z])
    pattern, best = item.tolist(), None
    for a, z in regions:
        text = words[a:z].tolist()
        distance, end = least_distance(pattern, text)
        if distance <= errors and (best is None or distance < best[0]):
            _, back = least_distance(pattern[::-1], text[:end][::-1], anchored=True)
            best = distance, a + end - back, a + end
            if not distance:
                break
    return best


def item_blocks(benchmark: DataFrame, id_column: str, text_column: str, block_words: int) -> Iterator[list[tuple[object, str, int]]]:
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text")).where("text is not null")
    rows = rows.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_words)))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"], r["times"]) for r in part.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.2, block_words: int = 2_000_000, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and item that stands in it: doc_id, item_id, distance, first_word, end_word (exclusive), item_words."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind, item_kind = narrow.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)
    parts = []
    for rows in item_blocks(benchmark, item_id, item_text, block_words):
        sent = spark.sparkContext.broadcast(Items(rows, max_error))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for b in text_chunks(batch, "text"):
                    found = [(x[0], items.ids[x[1]], *x[2:]) for x in _leaks(items, b.column("text"))[0] for _ in range(items.times[x[1]])]
                    if found:
                        doc, item, distance, start, end, size = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(item, item_type), *(pa.array(x, pa.int64()) for x in (distance, start, end, size))], ["doc_id", "item_id", "distance", "first_word", "end_word", "item_words"])

        parts.append(narrow.mapInArrow(search, f"doc_id {kind}, item_id {item_kind}, distance long, first_word long, end_word long, item_words long"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole


def _leaks(items: Items, texts: pa.Array) -> tuple[list[tuple[int, int, int, int, int, int]], np.ndarray]:
    """Document, item, distance, first word, end and words of the item; and how many words each document has."""
    hashes, first = words_of(texts)
    whole, near = items.hits(hashes, first)
    out = []
    for d, i, start in whole:
        m = len(items.words[i])
        out.append((d, i, 0, start - int(first[d]), start - int(first[d]) + m, m))
    for (d, i), starts in near.items():
        got = verify(hashes, items.words[i], starts, items.errors[i], int(first[d]), int(first[d + 1]))
        if got:
            out.append((d, i, got[0], got[1] - int(first[d]), got[2] - int(first[d]), len(items.words[i])))
    return out, np.diff(first)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.2, short_words: int = 0, short_share: float = 0.5, block_words: int = 2_000_000, text_column: str = "text") -> DataFrame:
    """The documents, all columns unchanged, in which no item stands.  With ``short_words``, items of fewer words remove a document
    only if they are ``short_share`` of it.  Documents are not moved between tasks."""
    for rows in item_blocks(benchmark, "item_id", "text", block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Items(rows, max_error))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in text_chunks(batch, text_column):
                    good = np.ones(b.num_rows, bool)
                    found, words = _leaks(sent.value, b.column(text_column))
                    good[[x[0] for x in found if x[5] >= short_words or x[5] >= short_share * words[x[0]]]] = False
                    yield b.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

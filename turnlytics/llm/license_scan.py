"""Licence scans with a positional index of rare words.

Templates are the words of licence texts and notices.  Word weights are inverse document frequencies that Spark counts over all
documents (a vector with an entry per licence word, so its size is that of the templates).  The index holds postings (template,
position) of a template's rarest words, as many as weigh more than a notice may lack: whoever holds enough of the template
holds one of them.  Each of these words that a file has is looked up, and a posting gives the place where the template would start.

At each such place the template's other words are first intersected at exactly their relative positions.  Where that does not reach
``min_share`` of the template's weight, words may be inserted, missing or changed: within ``slack`` (a part of the template's length) on
either side, the heaviest sequence of template words in order counts.  One of the notice's mandatory key phrases must
stand whole in that window.

Exact phrases (``PHRASES``) must stand word by word.  Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased.

Defined results: null texts count as empty: no words, no places, empty labels, score 0.  Repeated rows give repeated results.  An empty
table gives no rows.  Texts of any length are scanned whole.  Other columns, whatever their names, play no part.  Ids may
have any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .common import LOWER, byte_class, hash_words, small_batches, text_buffer, text_chunks, word_spans

NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
IS_WORD = byte_class(but=NOT_WORD)

# Phrases whose places are counted, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

NOTICES = license_texts.all_notices()


class Index:
    """Postings and weights of the licence words."""

    def __init__(self, phrases: list, notices: list):
        self.phrases = [(p.split(), label) for p, label in phrases]
        self.notices = [(t.split(), label, [k.split() for k in keys]) for label, t, keys in notices]
        words = {w for p, _ in self.phrases for w in p} | {w for t, _, keys in self.notices for x in (t, *keys) for w in x}
        self.words = sorted(words)
        at = {w: i for i, w in enumerate(self.words)}
        self.phrases = [([at[w] for w in p], label) for p, label in self.phrases]
        self.notices = [([at[w] for w in t], label, [[at[w] for w in k] for k in keys]) for t, label, keys in self.notices]
        text = " ".join(self.words).encode()
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), byte_class(but=b" "))
        hashes = hash_words(data, starts, ends)
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
        self.idf = np.ones(len(self.words))

    def weigh(self, idf: np.ndarray, min_share: float) -> None:
        """Set the weights and list the postings of each notice's rarest words."""
        self.idf = idf
        entries = []
        for t, (template, _, _) in enumerate(self.notices):
            weight = idf[np.array(template)]
            lacking = (1 - min_share) * weight.sum()
            for q in sorted(range(len(template)), key=lambda i: (-weight[i], i)):
                entries.append((template[q], t, q))
                lacking -= weight[q]
                if lacking < 0:
                    break
        entries.sort()
        self.postings = np.array(entries, np.int64).reshape(-1, 3)
        self.posting_from = np.searchsorted(self.postings[:, 0], np.arange(len(self.words) + 1))

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the licence words, and which word each is."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[slot] == hashes[at]
        return at[hit], self.order[slot[hit]]


def _words(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(b.column("text"))
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_WORD)
    return hash_words(data, starts, ends), first


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", phrases: list = PHRASES, notices: list = NOTICES, min_share: float = 0.8, slack: float = 0.2) -> DataFrame:
    """A row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template's weight found in place, or the share in order that made a label if that is larger: 1 for
    an exact phrase, 0 without any of the postings' words.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    index = Index(phrases, notices)
    size = len(index.words)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for b in text_chunks(batch, "text"):
                hashes, first = _words(b)
                at, ids = index.ids(hashes)
                doc = np.searchsorted(first, at, "right") - 1
                found += np.bincount(np.unique(doc * size + ids) % size, minlength=size)
                total += b.num_rows
        yield pa.RecordBatch.from_pydict({"word": pa.array(range(size + 1), pa.int32()), "n": pa.array([*found, total], pa.int64())})

    counts = {r["word"]: r["n"] for r in narrow.select("text").mapInArrow(frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.get(size, 0)
    index.weigh(np.array([1 + np.log((1 + total) / (1 + counts.get(i, 0))) for i in range(size)]), min_share)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                yield _scan(b, index, min_share, slack)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def heaviest_in_order(template: np.ndarray, weight: np.ndarray, window: np.ndarray) -> float:
    """The greatest weight of template words that stand in the window in the template's order."""
    best = np.zeros(len(window) + 1)
    for word, w in zip(template, weight, strict=True):
        here = window == word
        if here.any():
            best[1:] = np.maximum(best[1:], np.where(here, best[:-1] + w, 0.0))
            np.maximum.accumulate(best, out=best)
    return float(best[-1])


def _scan(b: pa.RecordBatch, index: Index, min_share: float, slack: float) -> pa.RecordBatch:
    hashes, first = _words(b)
    n = b.num_rows
    at, ids = index.ids(hashes)
    word = np.full(len(hashes), -1, np.int32)
    word[at] = ids
    doc = np.searchsorted(first, at, "right") - 1
    places, base, more, score = [], [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)

    def there(start: np.ndarray, d: np.ndarray, template: np.ndarray) -> np.ndarray:
        """For each start and each word of the template: does it stand at its place, within the document?"""
        pos = start[:, None] + np.arange(len(template))
        ok = (pos >= first[d][:, None]) & (pos < first[d + 1][:, None])
        return ok & (word[np.where(ok, pos, 0)] == template) if len(word) else ok

    for template, label in index.phrases:
        rare = min(range(len(template)), key=lambda i: (-index.idf[template[i]], i))
        mine = ids == template[rare]
        start, d = at[mine] - rare, doc[mine]
        hit = there(start, d, np.array(template)).all(axis=1)
        places.append(np.stack([start[hit], d[hit]]))
        for x in np.unique(d[hit]):
            base[x].add(label)
        score[d[hit]] = 1.0
    for t, start, d in _starts(index, at, ids, doc):
        _judge(index.notices[t], index.idf, start, d, word, first, there, more, score, min_share, slack)
    start, d = np.concatenate(places, axis=1) if places else np.zeros((2, 0), np.int64)
    local = start - first[d]
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, d, local)
    np.maximum.at(high, d, local)
    none = high < 0
    join = lambda x: ",".join(sorted(x))
    return pa.RecordBatch.from_arrays(
        [
            b.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(np.bincount(d, minlength=n), pa.int64()),
            pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none),
            pa.array([join(x) for x in base]), pa.array([join(x | y) for x, y in zip(base, more, strict=True)]), pa.array(np.clip(score, 0.0, 1.0)),
        ],
        ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    )


def _starts(index: Index, at: np.ndarray, ids: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per template, the places (and their documents) where it would start by one of its postings."""
    low, count = index.posting_from[ids], np.diff(index.posting_from)[ids]
    entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    template, position = index.postings[entry, 1], index.postings[entry, 2]
    found = np.stack([template, np.repeat(doc, count), np.repeat(at, count) - position])
    for t in np.unique(template):
        d, start = np.unique(found[1:, template == t], axis=1)
        yield int(t), start, d


def _judge(notice: tuple, idf: np.ndarray, start: np.ndarray, d: np.ndarray, word: np.ndarray, first: np.ndarray, there, more: list[set], score: np.ndarray, min_share: float, slack: float) -> None:
    """Add the notice's label and score to the documents that hold it near one of the given starts."""
    template, label, keys = np.array(notice[0]), notice[1], [np.array(k) for k in notice[2]]
    m, weight = len(template), idf[np.array(notice[0])]
    total, around = weight.sum(), max(1, int(slack * m))
    step = max(1, (1 << 22) // m)
    share = np.concatenate([there(start[i : i + step], d[i : i + step], template) @ weight for i in range(0, len(start), step)]) / total
    np.maximum.at(score, d, share)
    # what stands in the window in any order bounds what stands there in order
    low, high = np.maximum(start - around, first[d]), np.minimum(start + m + around, first[d + 1])
    bound = np.zeros(len(start))
    for w, times in zip(*np.unique(template, return_counts=True), strict=True):
        stands = np.flatnonzero(word == w)
        bound += idf[w] * np.minimum(np.searchsorted(stands, high) - np.searchsorted(stands, low), times)
    enough = min_share * total * (1 - 1e-12)
    keyed = lambda window: any((np.lib.stride_tricks.sliding_window_view(window, len(k)) == k).all(axis=1).any() for k in keys if len(k) <= len(window))
    # neighbouring starts are tried together first: what their common window lacks, none of them has
    edge = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (start[1:] // around != start[:-1] // around)))
    for a, z in zip(edge, np.append(edge[1:], len(start)), strict=True):
        if label in more[d[a]] or not (bound[a:z] >= enough).any():
            continue
        whole = word[low[a] : high[z - 1]]
        if not keyed(whole) or not (share[a:z] * total >= enough).any() and heaviest_in_order(template, weight, whole) < enough:
            continue
        for i in a + np.argsort(-bound[a:z], kind="stable"):
            window = word[low[i] : high[i]]
            if bound[i] >= enough and keyed(window):
                held = share[i] if share[i] * total >= enough else heaviest_in_order(template, weight, window) / total
                if held * total >= enough:
                    more[d[i]].add(label)
                    score[d[i]] = max(score[d[i]], held)
                    break

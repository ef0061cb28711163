"""Token counts without making tokens.

An Aho-Corasick automaton enumerates all vocabulary matches of a text, and dynamic programming carries counts from position to
position, by the tokenizer's own rule:

- Unigram vocabularies (Viterbi): best score and its piece count.  Of equal scores, the path whose last piece starts first
  stays.  A character that is no piece by itself costs the lowest score less 10.
- Merge vocabularies (byte-pair encoding): a prefix has one encoding, so its count and last piece are carried.  A match follows
  the last piece of the prefix before it if merging the two texts together (best score first, then leftmost) gives just
  these two pieces; neighbours that all pass this test are the encoding of the whole.  The outcome for a pair of pieces is
  kept.

``n_tokens`` is the count by the rule of the vocabulary's own type, ``n_unigram`` and ``score`` are the Viterbi count and score of its
pieces; for unigram vocabularies the two counts are one.  With byte pieces an unknown character counts as its UTF-8 bytes,
else a run of such characters counts as one.  A text starts with the space symbol, and spaces become that symbol.

No piece holds a space symbol after another character (checked when a vocabulary is loaded; without that, texts stay whole),
so the best path of a text is that of its words, one after the other.  A task scores each distinct word of a chunk once and
keeps a bounded table of word counts for later chunks.  Words are identified by 64-bit hashes.  Word scores are added per
text, which equals the whole-text sum exactly for vocabularies with whole-number scores.

Defined results: null and empty texts have 0 tokens and score 0.  Repeated rows give repeated results.  An empty table gives no rows.
A text of any length is counted whole.  Other columns, whatever their names, play no part.  Ids may have any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, small_batches, text_buffer, text_chunks

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 2_000_000
TABLE_CHUNK = 1 << 20  # the table of words is rebuilt once a chunk


@dataclass
class Vocabulary:
    """``merges``: whether tokens are made by merging (byte-pair encoding), not by the best sum of scores."""

    pieces: list[str]
    scores: list[float]
    byte_fallback: bool
    merges: bool = False

    def __getstate__(self):
        return (self.pieces, self.scores, self.byte_fallback, self.merges)

    def __setstate__(self, state):
        self.pieces, self.scores, self.byte_fallback, self.merges = state

    @cached_property
    def score_of(self) -> dict[str, float]:
        return dict(zip(self.pieces, self.scores, strict=True))

    @cached_property
    def inner(self) -> frozenset[str]:
        """Characters that stand in pieces but are none."""
        return frozenset(c for p in self.pieces for c in p) - self.single

    @cached_property
    def pairs(self) -> dict[tuple[str, str], bool]:
        return {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging neighbours: the best score first, then the leftmost."""
        parts, score = list(text), self.score_of
        while True:
            best, at = float("-inf"), -1
            for k in range(len(parts) - 1):
                if (s := score.get(parts[k] + parts[k + 1], float("-inf"))) > best:
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, last: str, piece: str) -> bool:
        """Do the two pieces stay apart, and whole, when their texts are merged?  An empty ``last`` asks for the piece alone."""
        got = self.pairs.get((last, piece))
        if got is None:
            if len(self.pairs) >= CACHED_WORDS:
                self.pairs.clear()
            got = self.pairs[last, piece] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return got

    @cached_property
    def automaton(self):
        a = ahocorasick.Automaton()
        for piece, score in zip(self.pieces, self.scores, strict=True):
            a.add_word(piece, (len(piece), score, piece))
        a.make_automaton()
        return a

    @cached_property
    def single(self) -> frozenset[str]:
        return frozenset(p for p in self.pieces if len(p) == 1)

    @cached_property
    def unknown(self) -> float:
        return min(self.scores) - UNKNOWN_PENALTY

    @cached_property
    def splits(self) -> bool:
        """Whether no piece spans the start of a word, so that words can be counted one by one."""
        return self.byte_fallback and SPACE in self.single and not any(SPACE in p.lstrip(SPACE) for p in self.pieces)

    @cached_property
    def alone(self) -> np.ndarray:
        """Of each byte: is it an ASCII character that no piece holds?  Such a character is a word of its own."""
        used = {c for p in self.pieces for c in p}
        return np.array([b < 128 and b != 32 and chr(b) not in used for b in range(256)])


def load_vocabulary(path: str) -> Vocabulary:
    """The normal pieces of a sentencepiece model file with their scores; control, byte and unknown pieces match nothing."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    bytes_there = sum(model.is_byte(i) for i in ids) == 256
    kind = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec.model_type
    return Vocabulary([model.id_to_piece(i) for i in normal], [model.get_score(i) for i in normal], bytes_there, kind == sentencepiece_model_pb2.TrainerSpec.BPE)


def count_words(vocabulary: Vocabulary, words: list[str]) -> tuple[list[int], list[int], list[float]]:
    """Token count, Viterbi count and Viterbi score of each word, the space symbol being in place."""
    own, counts, scores, plain = [0] * len(words), [0] * len(words), [0.0] * len(words), []
    for k, w in enumerate(words):
        if vocabulary.single.issuperset(w):
            plain.append(k)
        else:
            counts[k], scores[k] = _with_unknown(vocabulary, w)
            own[k] = _merged_with_unknown(vocabulary, w) if vocabulary.merges else counts[k]
    text = "\0".join([words[k] for k in plain]) + "\0"  # one scan for all words that have no unknown character
    best, pieces, length = [float("-inf")] * (len(text) + 1), [0] * (len(text) + 1), [0] * (len(text) + 1)
    tokens: list = [None] * (len(text) + 1)
    last = [""] * (len(text) + 1)
    at = 0
    for k in plain:
        best[at], tokens[at] = 0.0, 0
        at += len(words[k]) + 1
    merges, follows = vocabulary.merges, vocabulary.follows
    for end, (n, score, piece) in vocabulary.automaton.iter(text):
        stop = end + 1
        score += best[stop - n]
        if score > best[stop] or (score == best[stop] and n > length[stop]):
            best[stop], length[stop], pieces[stop] = score, n, pieces[stop - n] + 1
        if merges and tokens[stop] is None and tokens[stop - n] is not None and follows(last[stop - n], piece):
            tokens[stop], last[stop] = tokens[stop - n] + 1, piece
    at = 0
    for k in plain:
        at += len(words[k])
        counts[k], scores[k] = pieces[at], best[at]
        own[k] = counts[k] if not merges else tokens[at] if tokens[at] is not None else len(vocabulary.merged(words[k]))
        at += 1
    return own, counts, scores


def _merged_with_unknown(vocabulary: Vocabulary, word: str) -> int:
    """Tokens of a word, some of whose characters are no pieces; those that stand in no piece part the word."""
    cost = lambda part: 1 if part in vocabulary.score_of else len(part.encode()) if vocabulary.byte_fallback else 1
    if vocabulary.inner.intersection(word):
        return sum(map(cost, vocabulary.merged(word)))
    parts, known = [""], []
    for c in word:
        if c in vocabulary.single:
            parts[-1] += c
        else:
            parts.append("")
            known.append(c)
    return sum(map(cost, known)) + sum(count_words(vocabulary, [p for p in parts if p])[0])


def _with_unknown(vocabulary: Vocabulary, word: str) -> tuple[int, float]:
    ending: dict[int, list] = {}
    for end, match in vocabulary.automaton.iter(word):
        ending.setdefault(end + 1, []).append(match)
    best, pieces, lost = [0.0], [0], [False]
    for stop, c in enumerate(word, 1):
        found = max(((best[stop - n] + score, n) for n, score, _ in ending.get(stop, ())), default=None)
        if c not in vocabulary.single and (found is None or best[-1] + vocabulary.unknown > found[0]):
            extra = len(c.encode()) if vocabulary.byte_fallback else 0 if lost[-1] else 1
            best.append(best[-1] + vocabulary.unknown)
            pieces.append(pieces[-1] + extra)
            lost.append(True)
        else:
            best.append(found[0])
            pieces.append(pieces[stop - found[1]] + 1)
            lost.append(False)
    return pieces[-1], best[-1]


class WordTable:
    """Counts of words seen so far, as sorted arrays; emptied when it is full."""

    def __init__(self, vocabulary: Vocabulary, limit: int = CACHED_WORDS):
        self.vocabulary, self.limit = vocabulary, limit
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((3, 0))

    def look_up(self, hashes: np.ndarray, first: np.ndarray, text_of) -> np.ndarray:
        """Tokens, Viterbi counts and scores of distinct, sorted hashes; ``text_of(i)`` is the word at place i of ``first``."""
        slot = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.keys):
            known = self.keys[np.minimum(slot, len(self.keys) - 1)] == hashes
        values = np.zeros((3, len(hashes)))
        values[:, known] = self.values[:, slot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            values[:, new] = count_words(self.vocabulary, [text_of(i) for i in first[new]])
            if len(self.keys) + len(new) > self.limit:
                self.__init__(self.vocabulary, self.limit)
                slot = np.zeros(len(hashes), np.int64)
            self.keys = np.insert(self.keys, slot[new], hashes[new])
            self.values = np.insert(self.values, slot[new], values[:, new], axis=1)
        return values


_tables: dict[str, WordTable] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_tokens, n_unigram, score (of the best path).

    The driver reads the vocabulary file; what it sends to the tasks has the size of the vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _tables:  # kept while the worker process lives
            _tables.clear()
            _tables[vocabulary_path] = WordTable(sent.value)
        for batch in batches:
            for b in text_chunks(batch, "text", TABLE_CHUNK):
                own, counts, scores = count_texts(_tables[vocabulary_path], b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own, pa.int64()), pa.array(counts, pa.int64()), pa.array(scores)], ["doc_id", "n_tokens", "n_unigram", "score"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"doc_id {kind}, n_tokens long, n_unigram long, score double")


def count_texts(table: WordTable, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vocabulary = table.vocabulary
    data, offsets = text_buffer(pc.replace_substring(texts, SPACE, " "))
    filled = np.flatnonzero(np.diff(offsets))
    data = np.insert(data, offsets[filled], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    if vocabulary.splits and len(data):
        space, alone = data == 32, vocabulary.alone[data]
        first[1:] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    hashes, at, back = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    values = table.look_up(hashes, at, lambda i: raw[starts[i] : ends[i]].decode().replace(" ", SPACE))
    edge = np.searchsorted(starts, offsets)
    own, counts, scores = (np.diff(np.append(np.zeros(1), np.cumsum(v[back]))[edge]) for v in values)
    return own.astype(np.int64), counts.astype(np.int64), scores

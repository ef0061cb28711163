"""Alignment of two tokenizers' tokens over a corpus, with an identity map as the fast path.

Both tokenizers cut the same bytes.  Byte offsets at which tokens of both end cut a text into groups; within a group each
token of A is linked with each token of B.  For every id pair the documents that hold it linked are counted, and each document
is told how its links stand in these counts.

An array gives for each A id the B id of the same bytes, so a link that the array foretells is named by its A id alone.  Such
links are counted in vectors of vocabulary length, one per task, and looked up in one such vector.  Only the other links, of
groups that are not one to one or join other bytes, are pairs: they are counted by an exchange on the pair.  The most
frequent pairs, at most ``heavy`` of them, go to all tasks as sorted arrays, so no pair is hot in the join that looks up the rest.

Neither tokenizer joins text across a space that follows a character other than white space (checked when the two are loaded;
without that, texts stay whole).  So texts are cut there, each distinct piece of a chunk is encoded once, and all pieces of a
chunk are aligned together by vector operations.

Defined results: a text that is null or empty, or whose joined tokens of A or of B differ from a space and the text, has no tokens: zeros
and an empty ``groups_sha256``.  Each row is a document, so repeated rows count each and null ids do no harm.  Texts of any length are
aligned whole.  An empty table gives no rows.  Other columns, whatever their names, play no part.  Ids may have any type.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, list_array, small_batches, text_chunks

SPACE = "▁"
CHUNK = 1 << 21
JOINED = 256  # pieces encoded together
HEAVY = 1 << 20  # pairs sent to all tasks: 17 bytes each
PIECE = re.compile(r"\s+\S*(?:[^\S ]\s*\S*)*")  # a piece ends before a space that follows a character other than white space
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 characters for themselves, the other
    bytes in order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Tokenizer A (a byte-level vocabulary file of ``tokenizers``) and B (a ``sentencepiece`` model), as the files' contents."""

    def __init__(self, a_file: str, b_file: bytes):
        self.a_file, self.b_file = a_file, b_file

    def __getstate__(self):
        return self.a_file, self.b_file

    def __setstate__(self, state):
        self.a_file, self.b_file = state

    @classmethod
    def load(cls, a_path: str, b_path: str) -> Tokenizers:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())

    @cached_property
    def a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.a_file)
        made.encode_special_tokens = True
        return made

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_file)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        code = byte_alphabet()
        plain = self.a.get_vocab(with_added_tokens=False)
        tokens = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        return [b"" if (t := tokens.get(i)) is None else bytes(code[c] for c in t) if plain.get(t) == i else t.encode() for i in range(max(tokens) + 1)]

    @cached_property
    def b_bytes(self) -> list[bytes]:
        out = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            out.append(bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := BYTE_PIECE.fullmatch(piece)) else piece.replace(SPACE, " ").encode())
        return out

    @cached_property
    def splits(self) -> bool:
        """Whether both encode a text piece by piece."""
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import pre_tokenizers

        spec = sentencepiece_model_pb2.ModelProto.FromString(self.b_file).normalizer_spec
        plain = spec.name == "identity" and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        inner = any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.b.get_piece_size()))
        by_byte = isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel) and self.a.pre_tokenizer.use_regex and not self.a.pre_tokenizer.add_prefix_space
        return bool(plain and not inner and by_byte and self.a.normalizer is None)

    @cached_property
    def identity(self) -> np.ndarray:
        """For each A id the B id of the same bytes, or -1; of several B ids, the first that is no byte piece."""
        place: dict[bytes, int] = {}
        for i in sorted(range(len(self.b_bytes)), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                place.setdefault(self.b_bytes[i], i)
        return np.array([place.get(t, -1) if t else -1 for t in self.a_bytes], np.int64)

    @cached_property
    def one_to_one(self) -> list[str]:
        """The group of each A id with its same-bytes B id, as text."""
        return [f"{a}|{b}" for a, b in enumerate(self.identity.tolist())]

    @cached_property
    def tables(self) -> tuple:
        """Of A and B: all token bytes joined, and where each token starts."""
        return tuple((np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)])) for t in (self.a_bytes, self.b_bytes))

    def cut(self, text: str) -> list[str]:
        return PIECE.findall(" " + text) if self.splits else [" " + text]

    def encode(self, pieces: list[str]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """The pieces, in another order, and of A and B all ids and how many each piece has.

        Pieces that may follow each other in a text are encoded together; if a tokenizer then cuts across their ends, one by one.
        """
        together, alone = [], []
        for p in pieces:
            (alone if not self.splits or p[-1].isspace() or SPACE in p else together).append(p)
        order, parts = [], ([], [])
        for k in range(0, len(together), JOINED):
            group = together[k : k + JOINED]
            text = "".join(group)
            ends = np.cumsum([len(p.encode()) for p in group])
            found = []
            for ids, (_, start) in zip((self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])), self.tables, strict=True):
                ids = np.array(ids, np.int64)
                length = np.cumsum(start[ids + 1] - start[ids])
                stop = np.searchsorted(length, ends)
                if stop[-1] == len(ids) or (length[stop] != ends).any():
                    break
                found.append((ids, np.diff(np.append(-1, stop))))
            if len(found) < 2:
                alone += group
                continue
            order += group
            for part, f in zip(parts, found, strict=True):
                part.append(f)
        if alone:
            space = self.b.piece_to_id(SPACE)
            a = [e.ids for e in self.a.encode_batch_fast(alone, add_special_tokens=False)]
            b = [self.b.encode(p[1:]) if p != " " else [space] for p in alone]
            order += alone
            for part, ids in zip(parts, (a, b), strict=True):
                part.append((np.fromiter((x for i in ids for x in i), np.int64), np.array([len(i) for i in ids], np.int64)))
        empty = np.zeros(0, np.int64)
        return order, [tuple(np.concatenate([empty, *x]) for x in zip(*part, strict=True)) or (empty, empty) for part in parts]


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then the same for the next, and so on."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(before - starts, counts)


class Aligned:
    """Distinct pieces with their groups and links.  ``place``: where each given piece stands; ``ok``: whether tokens of both give the piece's bytes."""

    def __init__(self, tokenizers: Tokenizers, pieces: list[str]):
        n, identity, width = len(pieces), tokenizers.identity, len(tokenizers.b_bytes)
        order, lists = tokenizers.encode(pieces)
        place = {p: k for k, p in enumerate(order)}
        self.place = np.array([place[p] for p in pieces], np.int64)
        raw = [p.encode() for p in order]
        size = np.array([len(r) for r in raw], np.int64)
        self.ok = np.ones(n, bool)
        flat, counts = [], []
        for (all_ids, count), (_, start) in zip(lists, tokenizers.tables, strict=True):
            total = np.append(0, np.cumsum(start[all_ids + 1] - start[all_ids]))
            edge = np.append(0, np.cumsum(count))
            self.ok &= total[edge[1:]] - total[edge[:-1]] == size
            flat.append(all_ids)
            counts.append(count)
        while True:  # once or twice: pieces of the right length may still have other bytes
            kept, text = [], np.frombuffer(b"".join([r for r, ok in zip(raw, self.ok, strict=True) if ok]), np.uint8)
            owner = np.repeat(np.flatnonzero(self.ok), size[self.ok])
            wrong = np.zeros(n, bool)
            for all_ids, count, (data, start) in zip(flat, counts, tokenizers.tables, strict=True):
                ids = all_ids[np.repeat(self.ok, count)]
                length = start[ids + 1] - start[ids]
                wrong[owner[data[runs(start[ids], length)] != text]] = True
                kept.append((ids, np.cumsum(length)))
            if not wrong.any():
                break
            self.ok &= ~wrong
        (a, a_end), (b, b_end) = kept
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        a_size, b_size = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        piece_end = np.cumsum(size * self.ok)
        piece = np.searchsorted(piece_end, ends)  # pieces without tokens end where the one before ends, so the first is the owner
        a_first, b_first = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
        one = (a_size == 1) & (b_size == 1)
        one[one] = identity[a[a_first[one]]] == b[b_first[one]]
        words, other = [""] * len(ends), np.flatnonzero(~one)
        for g, x in zip(np.flatnonzero(one).tolist(), a[a_first[one]].tolist(), strict=True):
            words[g] = tokenizers.one_to_one[x]
        a_list, b_list = list(map(str, a.tolist())), list(map(str, b.tolist()))
        for g, s, c, t, d in zip(*(x.tolist() for x in (other, a_first[other], a_size[other], b_first[other], b_size[other])), strict=True):
            words[g] = ",".join(a_list[s : s + c]) + "|" + ",".join(b_list[t : t + d])
        edge = np.searchsorted(piece, np.arange(n + 1)).tolist()
        self.groups = [";".join(words[s:t]) for s, t in zip(edge, edge[1:], strict=False)]
        every = lambda of: np.bincount(piece, of, n).astype(np.int64) if len(ends) else np.zeros(n, np.int64)
        self.numbers = np.stack([every(a_size), every(b_size), every(np.ones(len(ends))), every(a_size * b_size)])
        # links of the other groups, one by one; those that the identity map foretells join the one-to-one groups
        left = runs(a_first[other], a_size[other])
        times = np.repeat(b_size[other], a_size[other])
        link_a, link_b = np.repeat(a[left], times), b[runs(np.repeat(b_first[other], a_size[other]), times)]
        link_piece = np.repeat(np.repeat(piece[other], a_size[other]), times)
        same = identity[link_a] == link_b
        self.same = _by_piece(n, np.append(piece[one], link_piece[same]), np.append(a[a_first[one]], link_a[same]))
        self.pairs = _by_piece(n, link_piece[~same], link_a[~same] * width + link_b[~same])


def _by_piece(n: int, piece: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values in the order of pieces, where each piece's start, and how many it has."""
    order = np.argsort(piece, kind="stable")
    count = np.bincount(piece, minlength=n) if len(piece) else np.zeros(n, np.int64)
    return value[order], np.cumsum(count) - count, count


def align(tokenizers: Tokenizers, texts: list[str | None]) -> dict:
    """Columns of a chunk: the four numbers, digest, distinct foretold A ids and pairs of each text with their occurrences."""
    index: dict[str, int] = {}
    cut = [tokenizers.cut(t) if t else [] for t in texts]
    place = np.fromiter((index.setdefault(p, len(index)) for pieces in cut for p in pieces), np.int64)
    done = Aligned(tokenizers, list(index))
    place = done.place[place]
    count = np.array([len(p) for p in cut], np.int64)
    row = np.repeat(np.arange(len(texts)), count)
    bad = np.zeros(len(texts), bool)
    bad[row[~done.ok[place]]] = True
    edge = np.append(0, np.cumsum(count)).tolist()
    groups, where = done.groups, place.tolist()
    digests = ["" if not c or b else hashlib.sha256(";".join([groups[k] for k in where[s:t]]).encode()).hexdigest() for c, b, s, t in zip(count.tolist(), bad.tolist(), edge, edge[1:], strict=False)]
    keep = ~bad[row]
    place, row = place[keep], row[keep]
    numbers = [np.bincount(row, x[place], len(texts)).astype(np.int64) if len(row) else np.zeros(len(texts), np.int64) for x in done.numbers]
    out = {"numbers": numbers, "digest": digests}
    for name, (value, start, size) in (("same", done.same), ("pairs", done.pairs)):
        at = runs(start[place], size[place])
        own, value = np.repeat(row, size[place]), value[at]
        order = np.lexsort((value, own))
        own, value = own[order], value[order]
        first = np.append(True, (own[1:] != own[:-1]) | (value[1:] != value[:-1]))[: len(own)]
        begin = np.flatnonzero(first)
        out[name] = value[first], np.diff(np.append(begin, len(own))), np.bincount(own[first], minlength=len(texts)) if len(own) else np.zeros(len(texts), np.int64)
    return out


def align_documents(docs: DataFrame, tokenizers: Tokenizers, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct links with their occurrences:
    ``same`` (A ids of links that the identity map foretells), ``pairs`` (A id * B's vocabulary size + B id of the others)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizers)  # the size of the two vocabulary files
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text", CHUNK):
                got = align(sent.value, b.column("text").to_pylist())
                lists = [list_array(x, got[k][2], t) for k, t in (("same", pa.int32()), ("pairs", pa.int64())) for x in got[k][:1]]
                times = [list_array(got[k][1], got[k][2], pa.int32()) for k in ("same", "pairs")]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in got["numbers"]), pa.array(got["digest"]), lists[0], times[0], lists[1], times[1]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pairs", "pairs_n"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>")


def count_same(aligned: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each A id linked as the identity map foretells; a vector of vocabulary length per task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(b.column("same").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["a", "n"])

    found = aligned.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()  # at most a row per A id
    out = np.zeros(size, np.int64)
    out[found.column("a").to_numpy()] = found.column("n").to_numpy()
    return out


def link_counts(aligned: DataFrame, a_size: int, b_size: int, scratch: Scratch) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """Documents per foretold A id; pair, n of the other pairs; the highest count of each A id over all its pairs."""
    same = count_same(aligned, a_size)
    counts = scratch.table(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "counts")
    found = counts.groupBy(F.expr(f"pair div {b_size}").alias("a")).agg(F.max("n").alias("n")).toArrow()  # at most a row per A id
    best = same.copy()
    at = found.column("a").to_numpy()
    best[at] = np.maximum(best[at], found.column("n").to_numpy())
    return same, counts, best


def frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A count from which on there are at most ``most`` pairs, and these pairs, sorted, with their counts."""
    level = F.floor(F.log2("n")).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()  # at most 63 rows
    least, total = 2**62, 0
    for r in sorted(levels, reverse=True):
        if (total := total + r["n"]) > most:
            break
        least = 2 ** r["level"]
    t = counts.where(F.col("n") >= least).orderBy("pair").toArrow()
    return least, t.column("pair").to_numpy(), t.column("n").to_numpy()


def cross_tokenizer_links(docs: DataFrame, tokenizers: Tokenizers, heavy: int = HEAVY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` are the links whose pair's count is its A id's highest, ``count_sum`` is the sum of counts over the links.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    a_size, b_size = len(tokenizers.a_bytes), len(tokenizers.b_bytes)
    aligned = scratch.table(align_documents(docs, tokenizers, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "aligned")
    same, counts, best = link_counts(aligned, a_size, b_size, scratch)
    least, keys, values = frequent(counts, heavy)
    sent = spark.sparkContext.broadcast((same, best, keys, values, b_size))  # two vectors of vocabulary length and at most ``heavy`` pairs

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, best, keys, values, b_size = sent.value
        for b in batches:
            own, times = (b.column(c).flatten().to_numpy() for c in ("same", "same_n"))
            totals = _row_sums(b.column("same"), times * (same[own] == best[own]), times * same[own])
            pairs, times = (b.column(c).flatten().to_numpy() for c in ("pairs", "pairs_n"))
            at, known = _find(keys, pairs)
            n = np.where(known, values[at] if len(values) else 0, 0)
            totals = [x + y for x, y in zip(totals, _row_sums(b.column("pairs"), times * (known & (n == best[pairs // b_size])), times * n), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *map(pa.array, totals)], ["row", "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, keys, _, _ = sent.value
        for b in batches:
            pairs, times = (b.column(c).flatten().to_numpy() for c in ("pairs", "pairs_n"))
            rows = np.repeat(b.column("row").to_numpy(), np.diff(b.column("pairs").offsets.to_numpy()))
            _, known = _find(keys, pairs)
            yield pa.RecordBatch.from_arrays([pa.array(x[~known]) for x in (rows, pairs, times.astype(np.int64))], ["row", "pair", "times"])

    narrow = aligned.select("row", "pairs", "pairs_n")
    frequent_part = aligned.select("row", "same", "same_n", "pairs", "pairs_n").mapInArrow(score, "row long, n_best long, count_sum long")
    highest = spark.createDataFrame(pa.table({"a": np.arange(a_size), "best": best}))  # a row per A id
    rare = counts.where(F.col("n") < least).withColumn("a", F.expr(f"pair div {b_size}")).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    rare_part = narrow.mapInArrow(rest, "row long, pair long, times long").join(rare, "pair").select("row", (F.col("times") * F.col("is_best")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = frequent_part.unionByName(rare_part).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether the key there is the wanted one."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _row_sums(lists: pa.ListArray, *values: np.ndarray) -> list[np.ndarray]:
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [np.diff(np.append(0, np.cumsum(v.astype(np.int64)))[offsets]) for v in values]

"""Byte strings that stand more than once in a corpus, by prefix-free parsing.

A position is a trigger where its rolling hash is the least of ``REACH`` consecutive ones, so triggers depend on nothing but the
bytes around them and are never further apart.  Each window of ``length`` bytes belongs to one trigger, the least hash among its
first ``REACH`` positions; equal windows have theirs at equal places.  A phrase is what reaches from the first window of a trigger
to the trigger.  A suffix of the corpus is then a suffix of a phrase, followed by the parse from the trigger on.

The order of corpus suffixes comes from two smaller orders.  The dictionary order sorts phrases by their bytes read
backwards from the trigger, so phrases with a common suffix of any length are neighbours; the parse order sorts what
follows the trigger.  For each suffix length, the pair (group in the dictionary, group in the parse) places every window, and windows
are equal where neighbours share both: common bytes before the trigger and after it make up ``length``.  Equal contexts (phrase and
following bytes) are one entry, so copies cost one comparison, however many there are.

Only phrases that can matter are sorted.  The bytes from a trigger on that lie in all its windows (its core) must stand twice in the corpus.
A first parse with sparser triggers, one for about 60 bytes, counts cores by 64-bit hash, and windows whose core stands once
fall away.  Entries are dealt by core, and a task sorts the entries of many cores at once.  A core that stands more than ``crowded``
times is not sorted in one task: its windows are counted one by one by an exchange.  Texts that stand several times are parsed once.

Defined results: null texts are empty.  Each row is a document; rows that repeat a text, whatever their ids, hold it several times.
Windows never span two documents; texts under ``length`` bytes have none.  Empty tables give empty results.  Very long texts are
parsed whole, in overlapping pieces of bounded size.  Texts, cores and contexts are told apart by 128-bit hashes.  Other columns,
whatever their names, play no part.  Ids may have any type that can be hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_long, hash_words, list_array, sliding_min, small_batches, text_buffer, text_chunks

REACH = 64
GRAM = 12
SEGMENT = 1 << 22
CROWDED = 50_000
AT_ONCE = 50_000  # entries sorted together, and what is left of the last core


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then the same for the next, and so on."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(before - starts, counts)


def sketch_reach(length: int) -> int:
    """The reach of the sparser triggers that choose what is parsed."""
    return max(REACH, length * 5 // 8)


def parse(data: np.ndarray, offsets: np.ndarray, length: int, reach: int = REACH, wanted: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Of joined texts: each trigger's text, place in ``data``, and least and greatest distance of its windows' starts.

    With ``wanted`` (cores for each text), only windows count whose core under the sparser triggers is one of their text's.
    """
    if len(data) <= SEGMENT or len(offsets) > 2:
        return _parse(data, offsets, length, reach, wanted)
    parts = []
    for at in range(0, len(data) - length + 1, SEGMENT):
        piece = data[at : at + SEGMENT + length - 1]
        text, t, *rest = _parse(piece, np.array([0, len(piece)]), length, reach, wanted)
        parts.append((text, t + at, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _parse(data: np.ndarray, offsets: np.ndarray, length: int, reach: int, wanted: list[np.ndarray] | None) -> tuple[np.ndarray, ...]:
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    start = runs(offsets[:-1], windows)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text = np.repeat(np.arange(len(windows)), windows)
    every = np.arange(len(data) - GRAM + 1)
    placed = (hash_words(data, every, every + GRAM) & np.uint64(0xFFFFFFFF00000000)) | every.astype(np.uint64)
    nearest = lambda n: (sliding_min(placed, n)[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if wanted is not None:
        trigger = nearest(sketch_reach(length))
        first, last = _ranges(text, trigger, start)
        core, owner = as_long(cores_of(data, trigger[first], length)), text[first]
        edge = np.searchsorted(owner, np.arange(len(windows) + 1)).tolist()
        due = np.concatenate([np.isin(core[a:z], w) for a, z, w in zip(edge, edge[1:], wanted, strict=False)])
        keep = np.repeat(due, last - first + 1)
        start, text = start[keep], text[keep]
        if not len(start):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
    trigger = nearest(reach)
    first, last = _ranges(text, trigger, start)
    t = trigger[first]
    return text[first], t, t - start[last], t - start[first]


def _ranges(text: np.ndarray, trigger: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the windows in a row that belong to one trigger."""
    new = np.append(True, (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(start)) - 1


def cores_of(data: np.ndarray, trigger: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the bytes from sparse triggers on that stand in all their windows."""
    return hash_words(data, trigger, trigger + length - sketch_reach(length) + 1)


def _sketch(docs: DataFrame, length: int) -> DataFrame:
    """id_key, digest and n_bytes with the distinct cores of each text, and those that stand in it more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                data, offsets = text_buffer(b.column("text"))
                text, trigger, _, _ = parse(data, offsets, length, sketch_reach(length))
                core = cores_of(data, trigger, length)
                order = np.lexsort((core, text))
                text, core = text[order], core[order]
                new = np.append(True, (text[1:] != text[:-1]) | (core[1:] != core[:-1]))[: len(text)]
                begin = np.flatnonzero(new)
                twice = begin[np.diff(np.append(begin, len(text))) > 1]
                lists = [list_array(as_long(core[at]), np.bincount(text[at], minlength=b.num_rows), pa.int64()) for at in (begin, twice)]
                yield pa.RecordBatch.from_arrays([b.column("id_key"), b.column("digest"), b.column("n_bytes"), *lists], ["id_key", "digest", "n_bytes", "cores", "own"])

    return docs.mapInArrow(run, "id_key long, digest binary, n_bytes long, cores array<long>, own array<long>")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """Of (number, text, cores): (number, trigger, key, core, context) of the triggers that have one of the cores.

    A context is the least and greatest distance of the trigger's windows, the bytes before the trigger and those after its core.
    """
    size = length - REACH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                data, offsets = text_buffer(b.column("text"))
                text, t, low, high = parse(data, offsets, length, REACH, [w.values.to_numpy() for w in b.column("cores")])
                raw, rows = data.tobytes(), [[], [], []]
                for p, x, y in zip(t.tolist(), low.tolist(), high.tolist(), strict=True):
                    core = xxhash.xxh3_128_digest(raw[p : p + size])
                    context = bytes((x, y)) + raw[p - y : p] + raw[p + size : p + length - x]
                    for column, value in zip(rows, (xxhash.xxh3_128_digest(core + context), core, context), strict=True):
                        column.append(value)
                numbers = b.column("number").take(pa.array(text))
                yield pa.RecordBatch.from_arrays([numbers, pa.array(t - offsets[text]), *(pa.array(c, pa.binary()) for c in rows)], ["number", "trigger", "key", "core", "context"])

    return texts.mapInArrow(run, "number long, trigger long, key binary, core binary, context binary")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal contexts of a task as one entry with their number, so that copies are not shuffled one by one."""

    def out(held: dict) -> pa.RecordBatch:
        columns = zip(*((core, key, context, n) for key, (core, context, n) in held.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["core", "key", "context", "n"])

    held: dict[bytes, list] = {}
    for batch in batches:
        for core, key, context in zip(*(batch.column(c).to_pylist() for c in ("core", "key", "context")), strict=True):
            known = held.get(key)
            if known is None:
                held[key] = [core, context, 1]
            else:
                known[2] += 1
        if len(held) >= AT_ONCE:
            yield out(held)
            held = {}
    if held:
        yield out(held)


def neighbours(rows: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows within their cores, and how many bytes each shares with the one before (-1: another core)."""
    wide = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.lexsort((*wide.T[::-1], core))
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    common[core[order[1:]] != core[order[:-1]]] = -1
    return order, np.append(-1, common)


def repeated_windows(core: np.ndarray, contexts: list[bytes], many: np.ndarray) -> np.ndarray:
    """For each entry the windows (bit: distance from the trigger) that another entry holds too, or that stand in an entry of ``many``
    occurrences.  Entries are distinct; ``core`` numbers their cores."""
    n = len(contexts)
    joined = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.cumsum([0, *map(len, contexts)])
    low, high = joined[at[:-1]].astype(np.int64), joined[at[:-1] + 1].astype(np.int64)
    before, after = (np.full((n, REACH), 255, np.uint8) for _ in range(2))  # no text holds the byte 255
    row, place = np.repeat(np.arange(n), high), runs(np.zeros(n, np.int64), high)
    before[row, place] = joined[np.repeat(at[:-1] + 1 + high, high) - place]
    size = REACH - 1 - low
    row, place = np.repeat(np.arange(n), size), runs(np.zeros(n, np.int64), size)
    after[row, place] = joined[np.repeat(at[:-1] + 2 + high, size) + place]
    dictionary, common_before = neighbours(before, core)
    following, common_after = neighbours(after, core)
    masks = np.zeros(n, np.uint64)
    in_dictionary, in_parse = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(REACH):
        owned = (low <= x) & (x <= high)
        if not owned.any():
            continue
        in_dictionary[dictionary] = np.cumsum(common_before < x)  # phrases that share x bytes before the trigger
        in_parse[following] = np.cumsum(common_after < REACH - 1 - x)
        corpus = in_dictionary * (n + 1) + in_parse
        entries = np.flatnonzero(owned)
        order = entries[np.argsort(corpus[entries])]
        same = corpus[order[1:]] == corpus[order[:-1]]
        found = owned & many
        found[order[1:][same]] = found[order[:-1][same]] = True
        masks[found] |= np.uint64(1 << x)
    return masks


def _sort_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by core: key and mask of those that hold a repeated window; entries that several tasks sent are one."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        number = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        _, first, place = np.unique(number, return_index=True, return_inverse=True)
        many = np.bincount(place, t.column("n").to_numpy()) > 1
        t = t.take(pa.array(first))
        core = t.column("core").combine_chunks().dictionary_encode().indices.to_numpy()
        masks = repeated_windows(core, t.column("context").to_pylist(), many)
        some = np.flatnonzero(masks)
        return pa.RecordBatch.from_arrays([t.column("key").combine_chunks().take(pa.array(some)), pa.array(as_long(masks[some]))], ["key", "mask"])

    held, count = [], 0
    for batch in (b for b in batches if b.num_rows):
        cores = batch.column("core")
        if count >= AT_ONCE:  # the last core may go on in this batch
            last = held[-1].column("core")[-1]
            stop = next((i for i in range(batch.num_rows) if cores[i] != last), batch.num_rows)
            held.append(batch.slice(0, stop))
            batch = batch.slice(stop)
            if batch.num_rows:
                yield solve(held)
                held, count = [], 0
        if batch.num_rows:
            held.append(batch)
        count += batch.num_rows
    if held:
        yield solve(held)


def _list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each entry as (window, key, bit, n)."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            window, key, bit, times = [], [], [], []
            for r in batch.slice(k, 1000).to_pylist():
                x, y = r["context"][:2]
                before, after = r["context"][2 : 2 + y], r["context"][2 + y :]
                for d in range(x, y + 1):
                    window.append(xxhash.xxh3_128_digest(r["core"] + bytes((d,)) + before[y - d :] + after[: REACH - 1 - d]))
                    key.append(r["key"])
                    bit.append(d)
                    times.append(r["n"])
            yield pa.RecordBatch.from_arrays([pa.array(window, pa.binary()), pa.array(key, pa.binary()), pa.array(bit, pa.int32()), pa.array(times, pa.int64())], ["window", "key", "bit", "n"])


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """Of (digest, text, found): the text without its repeated windows, as (digest, n_removed, spans, kept)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                removed, spans, kept = [], [], []
                data, offsets = text_buffer(b.column("text"))
                for i, found in enumerate(b.column("found")):
                    own, items = data[offsets[i] : offsets[i + 1]], found.values
                    trigger, mask = items.field("trigger").to_numpy(), items.field("mask").to_numpy().view(np.uint64)
                    row, bit = np.nonzero((mask[:, None] >> np.arange(REACH, dtype=np.uint64)) & np.uint64(1))
                    start = trigger[row] - bit
                    cover = np.bincount(start, minlength=len(own) + 1) - np.bincount(start + length, minlength=len(own) + 1)
                    gone = np.append(np.cumsum(cover[:-1]) > 0, False)
                    edge = np.flatnonzero(np.diff(gone, prepend=False)).reshape(-1, 2)
                    removed.append(int(gone.sum()))
                    spans.append([{"start": s, "end": e} for s, e in edge.tolist()])
                    kept.append(own[~gone[:-1]].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["digest", "n_removed", "spans", "kept"])

    return texts.mapInArrow(run, "digest binary, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def repeated_bytes(docs: DataFrame, length: int = 200, crowded: int = CROWDED, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables.  All documents: doc_id, digest (of the text), n_bytes, text.  By digest, the texts that hold bytes to remove: digest, n_removed,
    spans (start and end of each run of removed bytes), kept (the other bytes).  ``length`` is at least 80."""
    if length < REACH + GRAM:
        raise ValueError(f"windows have at least {REACH + GRAM} bytes")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "bytes")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(id_column)).alias("id_key"), F.unhex(F.md5(text)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = F.xxhash64("digest").alias("short")  # names a text where a mix-up costs time only
    with scratch.inner("steps") as inner:
        long_ones = inner.table(_sketch(narrow.where(f"n_bytes >= {length}").select("id_key", "digest", "n_bytes", "text"), length), "sketches")
        copied = inner.table(long_ones.groupBy("digest").agg(F.min("id_key").alias("id_key"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("n")).where("n > 1"), "copied")
        once = long_ones.select("digest", "id_key", "cores", "own").join(copied.select("digest"), "digest", "left_anti")
        first = long_ones.select("digest", "id_key", "cores", "own").join(copied.select("digest", "id_key"), ["digest", "id_key"]).dropDuplicates(["digest"])
        parsed = inner.table(once.unionByName(first).select(short, "id_key", "cores", "own"), "parsed")
        cores = parsed.select("short", F.explode("cores").alias("core"))
        common = inner.table(cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "common-cores")
        due = cores.join(common, "core").unionByName(parsed.select("short", F.explode("own").alias("core")))
        due = due.groupBy("short").agg(F.collect_set("core").alias("cores"))  # at most a text's own cores
        due = due.join(parsed.select("short", "id_key"), "short")
        chosen = narrow.where(f"n_bytes >= {length}").select(short, "id_key", "digest", "text").join(due, ["short", "id_key"])
        same_row = Window.partitionBy("short", "id_key", "digest").orderBy("digest")
        texts = chosen.withColumn("k", F.row_number().over(same_row)).where("k = 1").select("digest", "text", "cores")
        texts = inner.table(texts.withColumn("number", F.monotonically_increasing_id()), "texts")
        contexts = inner.table(_contexts(texts.select("number", "text", "cores"), length), "contexts")
        masks = inner.table(_masks(contexts, crowded, inner), "masks")
        found = contexts.select("number", "trigger", "key").join(masks, "key").groupBy("number").agg(F.collect_list(F.struct("trigger", "mask")).alias("found"))  # at most a text's own triggers
        cut = _cut(texts.select("number", "digest", "text").join(found, "number").select("digest", "text", "found"), length)
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        gone = copied.select("digest", F.col("n_bytes").alias("n_removed"), whole.alias("spans"), F.lit(b"").alias("kept"))
        changed = scratch.table(cut.join(copied.select("digest"), "digest", "left_anti").unionByName(gone), "changed")
    return narrow.select("doc_id", "digest", "n_bytes", "text"), changed


def _masks(contexts: DataFrame, crowded: int, scratch: Scratch) -> DataFrame:
    """key, mask of the contexts that hold repeated windows."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = contexts.select("core", "key", "context").mapInArrow(_combine, "core binary, key binary, context binary, n long")
    hot = scratch.table(contexts.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("core"), "hot-cores")
    some = not hot.isEmpty()
    few = entries.join(hot, "core", "left_anti") if some else entries
    masks = few.repartition(parts, "core").sortWithinPartitions("core").mapInArrow(_sort_entries, "key binary, mask long")
    if not some:
        return masks
    windows = scratch.table(entries.join(hot, "core").select("core", "key", "context", "n").mapInArrow(_list_windows, "window binary, key binary, bit int, n long"), "windows")
    twice = windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    return masks.unionByName(windows.join(twice, "window").groupBy("key").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")))

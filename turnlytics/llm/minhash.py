"""Near-duplicates by min-max hashing.

A document's set are its distinct runs of ``shingle`` words.  Each permutation gives two signature values, the least and the
greatest hash, so n values cost n / 2 hash evaluations.  Bands of ``rows`` values (all minima or all maxima of different
permutations) are bucket keys.  With the defaults (120 values in 24 bands of 5) two documents at similarity 0.85 share no
bucket with a probability under 1e-6.

Documents with equal sets form a class; only its smallest id goes on.  In each bucket, the member that meets most others in
all its buckets is compared with the rest on the full sets, so a group of copies costs one comparison per member.  The
links make parts.  Buckets that hold several parts get a second step: members outside the bucket's largest part are compared with
all members, in blocks inside tasks, unless what they can share at most rules a link out.  So every pair of a bucket that could join
two components is decided on the full sets, and no step emits all pairs of a group.

Defined results: null texts and texts without words have empty sets and are linked with nothing; texts with fewer words than
a shingle have one shingle, the whole sequence.  Rows with a null id are linked with nothing and their component is null.
``doc_id`` names one text; a repeated row gets its result repeated.  An empty table gives no rows.  Texts of any length count
whole.  Ids are whole numbers (cast to long).  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_SPACE, Scratch, as_long, batch_rows, hash_runs, hash_words, list_array, mix, small_batches, text_buffer, text_chunks, word_spans
from .components import connected_components

_rng = np.random.default_rng(77)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of n words (A-Z lower-cased)."""
    data, offsets = text_buffer(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, NON_SPACE)
    words = hash_words(data, starts, ends)
    runs = hash_runs(words, n)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= n:
            s = np.sort(runs[a : z - n + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(hash_runs(words[a:z], z - a) if z > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """A row per non-empty set: the minima, then the maxima, of all permutations (32 bits each)."""
    factors, shifts = np.random.default_rng(4321).integers(0, 2**32, (2, permutations), dtype=np.uint64).astype(np.uint32)
    factors |= np.uint32(1)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    out = np.empty((len(sets), 2 * permutations), np.uint32)
    for p in range(permutations):
        h = flat * factors[p] + shifts[p]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum.reduceat(h, at, out=out[:, p])
        np.maximum.reduceat(h, at, out=out[:, permutations + p])
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per set and band."""
    bands = values.shape[1] // rows
    keys = np.zeros((len(values), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys ^ values[:, r::rows][:, :bands].astype(np.uint64)) + np.uint64(r)
    return mix(keys + np.arange(bands, dtype=np.uint64))


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest (two longs) and its band keys (null for an empty set)."""
    permutations = bands * rows // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                sets = shingle_sets(b.column("text"), shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = sizes > 0
                keys, digests = np.zeros((len(sets), bands), np.uint64), np.zeros((2, len(sets)), np.uint64)
                if full.any():
                    some = [s for s in sets if len(s)]
                    keys[full] = band_keys(signatures(some, permutations), rows)
                    flat, at = np.concatenate(some), np.append(0, np.cumsum(sizes[full])[:-1])
                    for i, seed in enumerate((0x51ED270B, 0xA0761D65)):
                        digests[i][full] = np.add.reduceat(mix(flat ^ np.uint64(seed)), at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(sizes), *(pa.array(as_long(d)) for d in digests), list_array(as_long(keys[full].ravel()), np.where(full, bands, 0), pa.int64())],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_chunks(batch, "text"):
                sets = shingle_sets(b.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), list_array(as_long(np.concatenate(sets)), [len(s) for s in sets], pa.int64())], ["id", "items"])

    return docs.mapInArrow(run, "id long, items array<long>")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 24, rows: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept.  Linked: 100 * intersection >= percent * union."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "minhash")
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    sketched = scratch.table(sketch(narrow, shingle, bands, rows), "sketches")
    named = sketched.where("doc_id is not null and n_shingles > 0")
    with scratch.inner("links") as inner:
        classes = inner.table(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
        components = link_classes(narrow, classes, shingle, percent, inner)
        whole = classes.select("d1", "d2", "id").join(components.withColumnRenamed("node", "id"), "id", "left")
        whole = scratch.table(whole.select("d1", "d2", F.coalesce("component_id", "id").alias("component_id")), "class-components")
    result = sketched.select("doc_id", "n_shingles", "d1", "d2").join(whole, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return result.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def link_classes(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    members = classes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = scratch.table(members.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1"), "buckets")
    members = scratch.table(members.join(shared, "bucket"), "members")
    # the member that meets most others is likely the text that the others were made from
    met = scratch.table(members.groupBy("id").agg(F.sum("crowd").alias("met")), "met")
    centers = members.select("bucket", "id").join(met, "id").groupBy("bucket").agg(F.max(F.struct("met", F.col("id").alias("center"))).alias("x"))
    centers = scratch.table(centers.select("bucket", "x.center"), "centers")
    texts = docs.join(met.select("id"), docs["doc_id"] == met["id"]).select("doc_id", "text")
    sets = scratch.table(full_sets(texts, shingle).dropDuplicates(["id"]), "sets")
    pairs = members.select("bucket", "id").join(centers, "bucket").where("id <> center")
    pairs = scratch.table(pairs.select(F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b")).distinct(), "pairs")
    links = scratch.table(linked(pairs, sets, percent), "links")
    parts = connected_components(links, scratch).select(F.col("node").alias("id"), F.col("component_id").alias("part"))
    members = scratch.table(members.select("bucket", "id", "n").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "parted")
    more = outlier_links(members, sets, percent, scratch)
    if more.isEmpty():
        return parts.select(F.col("id").alias("node"), F.col("part").alias("component_id"))
    return connected_components(links.unionAll(more), scratch)


def outlier_links(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, rows: int = 50_000, columns: int = 200_000, row_members: int = 2_000, column_members: int = 8_000) -> DataFrame:
    """Links between different parts of a bucket; members: bucket, id, n (set size), part.

    Of each bucket's largest part no two members need comparing, so outliers (all other members) meet all members.  A shingle
    that no other member of such buckets has is in no intersection, which bounds what a document can share; outliers
    that this keeps below the threshold for every size in their bucket fall away.  The rest is compared in cells inside tasks, which
    return at most one link per outlier and part.  A cell holds outliers with about ``rows`` shingles and members with about ``columns``, and about
    ``row_members`` and ``column_members`` of them at most.
    """
    sized = members.groupBy("bucket", "part").agg(F.count("*").alias("size"))
    largest = sized.groupBy("bucket").agg(F.max(F.struct("size", "part")).alias("x"), F.count("*").alias("parts")).where("parts > 1")
    largest = scratch.table(largest.select("bucket", F.col("x.part").alias("main")), "mixed")
    if largest.isEmpty():
        return members.sparkSession.createDataFrame([], "a long, b long")
    members = scratch.table(members.join(largest, "bucket"), "mixed-members")
    ids = scratch.table(members.select("id").distinct(), "mixed-ids")
    items = sets.join(ids, "id").select("id", F.explode("items").alias("item"))
    alone = items.groupBy("item").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("id").agg(F.count("*").alias("alone"))
    alone = scratch.table(alone, "alone")
    # percent times both sizes together is at most 100 + percent times what the two share; in whole numbers, as ties count
    members = members.join(alone, "id", "left").withColumn("can_share", F.col("n") - F.coalesce("alone", F.lit(0)))
    members = scratch.table(members.withColumn("reach", (100 + percent) * F.col("can_share") - percent * F.col("n")).select("bucket", "id", "n", "part", "can_share", "reach", (F.col("part") != F.col("main")).alias("outlier")), "reaches")
    limits = members.groupBy("bucket").agg(F.min("n").alias("least"), F.max("reach").alias("farthest"), F.sum("n").alias("crowd"), F.count("*").alias("crowd_members"))
    outliers = members.where("outlier").join(scratch.table(limits, "limits"), "bucket").where(f"reach >= {percent} * least AND {percent} * n <= farthest")
    outliers = scratch.table(outliers.select("bucket", "id", "n", "part", "can_share", "crowd", "crowd_members"), "outliers")
    counts = outliers.groupBy("bucket").agg(F.sum("n").alias("items"), F.count("*").alias("members"), F.max("crowd").alias("crowd_items"), F.max("crowd_members").alias("crowd_members"))
    blocks = lambda items, size, members, most: F.greatest(F.ceil(F.col(items) / size), F.ceil(F.col(members) / most))
    crowds = scratch.table(counts.select("bucket", blocks("items", rows, "members", row_members).alias("few"), blocks("crowd_items", columns, "crowd_members", column_members).alias("crowd")), "crowds")
    place = lambda n: F.pmod(F.xxhash64("id", "bucket"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["bucket", "id", "part", "can_share"]
    left = outliers.drop("crowd", "crowd_members").join(crowds, "bucket").select(*kept, F.lit(True).alias("outlier"), place("few").alias("row"), every("crowd").alias("col"))
    right = members.join(crowds, "bucket").select(*kept, F.lit(False).alias("outlier"), place("crowd").alias("col"), every("few").alias("row"))
    cells = scratch.table(left.unionByName(right), "cells")
    whole = cells.join(sets, "id").repartition("bucket", "row", "col").sortWithinPartitions("bucket", "row", "col", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (b for b in batches if b.num_rows):
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "row", "col")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if held and [held[-1].column(c)[0].as_py() for c in ("bucket", "row", "col")] != keys[0].tolist():
                yield _compare_cell(held, percent)
                held = []
            for a, z in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                held.append(batch.slice(a, z - a))
                if z < batch.num_rows:
                    yield _compare_cell(held, percent)
                    held = []
        if held:
            yield _compare_cell(held, percent)

    with batch_rows(members.sparkSession, 200):
        return scratch.table(whole.mapInArrow(compare, "a long, b long"), "more-links")


def _compare_cell(batches: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """One link of each outlier to each other part in which it has any."""
    t = pa.Table.from_batches(batches).combine_chunks()
    ids, part, can, outlier = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "part", "can_share", "outlier"))
    lists = t.column("items").combine_chunks()
    flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(ids)), sizes)
    items, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    more = times[code] > 1
    owner, code = owner[more], (np.cumsum(times > 1) - 1)[code[more]]
    width = int((times > 1).sum())
    x, y = np.flatnonzero(outlier), np.flatnonzero(~outlier)
    a, b = [], []
    may_x, may_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
    for at in range(0, len(x), 256):
        some = x[at : at + 256]
        share = np.minimum(can[some][:, None], can[y][None, :])
        open_pairs = (part[some][:, None] != part[y][None, :]) & (100 * share >= percent * (sizes[some][:, None] + sizes[y][None, :] - share))
        may_x[at : at + 256] = open_pairs.any(axis=1)
        may_y |= open_pairs.any(axis=0)
    x, y = x[may_x], y[may_y]
    step = min(max(1, (1 << 22) // max(width, 1)), 1024)
    for at in range(0, len(x), step):
        some = _indicators(x[at : at + step], owner, code, width, len(ids))
        for to in range(0, len(y), step):
            rows, columns = x[at : at + step], y[to : to + step]
            common = np.rint(some @ _indicators(columns, owner, code, width, len(ids)).T).astype(np.int64)
            union = sizes[rows][:, None] + sizes[columns][None, :] - common
            i, j = np.nonzero((100 * common >= percent * union) & (part[rows][:, None] != part[columns][None, :]))
            _, one = np.unique(np.stack([i, part[columns[j]]]), axis=1, return_index=True)
            a.append(ids[rows[i[one]]])
            b.append(ids[columns[j[one]]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in (a, b)], ["a", "b"])


def _indicators(rows: np.ndarray, owner: np.ndarray, code: np.ndarray, width: int, n: int) -> np.ndarray:
    line = np.full(n, -1)
    line[rows] = np.arange(len(rows))
    mine = line[owner] >= 0
    out = np.zeros((len(rows), width), np.float32)
    out[line[owner[mine]], code[mine]] = 1
    return out


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike.  The sets of members move once; a center's set meets them where it is dealt out."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("right"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("left", "right")).cast("long")
    return both.withColumn("common", common).where(F.col("common") * 100 >= (F.size("left") + F.size("right") - F.col("common")) * percent).select("a", "b")

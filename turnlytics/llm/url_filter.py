"""URL filters on sorted digest arrays.

Rules are (host, path, verdict).  Their keys, 64-bit xxhash digests of ``host/path``, are sorted by Spark and written as
shards: a ``keys`` file, which probing tasks map into memory, and the full rule strings with their offsets.  A task probes
the keys of all candidates of a batch with one vectorised binary search per shard and confirms every hit against the
stored string, so that two strings with one digest never mix.

Defined results: a null url, or one without ``://``, has empty host and path and meets no rule; urls that meet no rule get
``default``.  Of several rules the longest (host and path together, then the longer host) decides; of equal rules with
different verdicts, ``block`` does.  Null or empty rule hosts are ignored.  Repeated rows give repeated results.  An empty table of
pages gives no rows, an empty one of rules lets the default decide.  Urls of any length are judged whole.  Ids may have any
type.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

SHARD_RULES = 4_000_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: on to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def build_index(spark: SparkSession, rules: DataFrame, scratch: Scratch, shard_rules: int = SHARD_RULES) -> list[dict]:
    """Write the shards; the list of shards (a row for each ``shard_rules`` rules) is what the driver keeps."""
    keyed = (
        rules.where("host is not null and host <> '' and path is not null")
        .select(F.concat("host", "path").alias("rule"), F.length("host").cast("int").alias("cut"), F.col("verdict"))
        .groupBy("rule", "cut").agg(F.max(F.col("verdict") == "block").alias("block"))
    )
    keyed = keyed.mapInArrow(_digest, "digest long, rule string, cut int, block boolean, path_length int")
    target = scratch.path("shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        store, root = pafs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        # the digest order is that of unsigned values
        keys = table.column("digest").to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, table = keys[order], table.take(pa.array(order))
        name = f"{int(keys[0]):016x}-{os.urandom(4).hex()}"  # each attempt has a name of its own; the returned row names the one that counts
        with store.open_output_stream(f"{root}/{name}.keys") as out:
            out.write(keys.tobytes())
        with pa.ipc.new_file(pa.PythonFile(sink := store.open_output_stream(f"{root}/{name}.rules"), "w"), table.schema) as out:
            out.write_table(table)
        sink.close()
        lengths = sorted(set(table.column("path_length").to_pylist()))
        row = {"file": f"{target}/{name}", "low": int(keys[0]) - 2**63, "high": int(keys[-1]) - 2**63, "lengths": lengths}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("lengths", pa.list_(pa.int32()))]))

    with scratch.inner("steps") as inner:
        keyed = inner.table(keyed, "rules")
        shards = max(1, -(-keyed.count() // shard_rules))
        parts = keyed.repartitionByRange(shards, F.expr("digest")) if shards > 1 else keyed.coalesce(1)
        return [r.asDict() for r in parts.mapInArrow(write, "file string, low long, high long, lengths array<int>").collect()]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rules, cuts = b.column("rule").to_pylist(), b.column("cut").to_pylist()
        keys = np.array([xxhash.xxh64_intdigest(r.encode()) for r in rules], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), b.column("rule"), b.column("cut"), b.column("block"), pa.array([len(r) - c for r, c in zip(rules, cuts, strict=True)], pa.int32())],
            ["digest", "rule", "cut", "block", "path_length"],
        )


@lru_cache(maxsize=64)
def _shard(file: str) -> tuple[np.ndarray, pa.Table]:
    """A shard's keys and rules, mapped into memory.  Shards in a remote store are first copied beside the task; the copies' names go
    once they are mapped, so they vanish with the mapping."""
    store, path = pafs.FileSystem.from_uri(file)
    if isinstance(store, pafs.LocalFileSystem):
        return _mapped(path)
    with tempfile.TemporaryDirectory(prefix="url-rules-") as folder:
        local = os.path.join(folder, "shard")
        for end in (".keys", ".rules"):
            with store.open_input_stream(path + end) as src, open(local + end, "wb") as out:
                while piece := src.read(1 << 24):
                    out.write(piece)
        return _mapped(local)


def _mapped(path: str) -> tuple[np.ndarray, pa.Table]:
    return np.memmap(path + ".keys", np.uint64, "r"), pa.ipc.open_file(pa.memory_map(path + ".rules")).read_all()


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """A row per page: id, host, path, the rule that decides (host and path joined; null if none) and the verdict."""
    scratch = Scratch(pages.sparkSession, "url-rules")
    shards = build_index(pages.sparkSession, rules, scratch)
    lengths = sorted({n for s in shards for n in s["lengths"]})
    files = [(s["file"], np.uint64(s["low"] + 2**63), np.uint64(s["high"] + 2**63)) for s in shards]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                rule, block = _longest(b.column("host").to_pylist(), b.column("path").to_pylist(), lengths, files)
                verdict = [default if x is None else "block" if x else "allow" for x in block]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names)

    narrow = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
    host, path = host_path(F.col("url"))
    narrow = narrow.select("page_id", host.alias("host"), path.alias("path"))
    names = ["page_id", "host", "path", "rule", "verdict"]
    kind = narrow.schema["page_id"].dataType.simpleString()
    return narrow.mapInArrow(probe, f"page_id {kind}, host string, path string, rule string, verdict string")


def _longest(hosts: list[str], paths: list[str], lengths: list[int], files: list) -> tuple[list, list]:
    """For each url the longest rule that fits it, and whether that blocks."""
    texts, cuts, owners = [], [], []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        at = 0
        while host:
            suffix = host[at:]
            for n in lengths:
                if n > len(path):
                    break
                texts.append(suffix + path[:n])
                cuts.append(len(suffix))
                owners.append(i)
            at = host.find(".", at) + 1
            if not at:
                break
    best: list = [None] * len(hosts)
    keys = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in texts), np.uint64, len(texts))
    for file, low, high in files:
        mine = np.flatnonzero((keys >= low) & (keys <= high))
        if not len(mine):
            continue
        stored, table = _shard(file)
        left = np.searchsorted(stored, keys[mine], "left")
        right = np.searchsorted(stored, keys[mine], "right")
        for k, a, z in zip(mine[left < right], left[left < right], right[left < right], strict=True):
            for row in table.slice(a, z - a).to_pylist():  # more than one only where digests collide
                if row["rule"] == texts[k] and row["cut"] == cuts[k]:
                    rank = (len(texts[k]), cuts[k], row["rule"], row["block"])
                    best[owners[k]] = max(best[owners[k]], rank) if best[owners[k]] else rank
    return [x and x[2] for x in best], [x and x[3] for x in best]

"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames.  A bundle ends with a seek table in a skippable frame: the
compressed and uncompressed size of each frame, the number of frames, a flag byte and a magic number, so that any
Zstandard reader still reads the whole bundle, while a reader with the table opens one frame.  The index maps a record's
identifier to its bundle, frame and offset within the (uncompressed) frame.

Equal payloads are stored once: the row with the largest page id is the response, the others are revisits that name it.
Only digests, never payloads, are compared between rows.  Each task writes its bundles under names of its own attempt, and
only bundles that the committed index names are read back, so retried or speculative tasks leave nothing wrong behind.

Defined results: a null html is an empty payload.  Rows with a null page id are all responses, revisited by none.
Repeated rows that share the largest id are all responses.  An empty table gives no bundle and no rows.  A payload of any length is
one record in one frame.  Page ids are whole numbers (cast to long).  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# The seekable format's magic numbers.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
INDEX_SCHEMA = "record_id string, bundle string, frame int, offset int, length int"


class BundleWriter:
    """Writes records to one bundle; a frame ends once it holds ``frame_bytes``."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.pending = bytearray()
        self.total = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset that the record got."""
        at = len(self.frames), len(self.pending)
        self.pending += record
        self.total += len(record)
        if len(self.pending) >= self.frame_bytes:
            self._end_frame()
        return at

    def _end_frame(self) -> None:
        if self.pending:
            packed = self.zstd.compress(bytes(self.pending))
            self.sink.write(packed)
            self.frames.append((len(packed), len(self.pending)))
            self.pending = bytearray()

    def close(self) -> None:
        self._end_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """Of an open, seekable bundle: each frame's place, compressed size and uncompressed size."""
    size = source.size()
    source.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the file has no seek table")
    source.seek(size - 9 - 8 * count)
    table, at = [], 0
    for packed, full in struct.iter_unpack("<II", source.read(8 * count)):
        table.append((at, packed, full))
        at += packed
    return table


def read_frame(source, entry: tuple[int, int, int]) -> bytes:
    at, packed, full = entry
    source.seek(at)
    return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=full)


def make_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("no record starts here")
        fields = dict(line.split(": ", 1) for line in head[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        yield fields, data[start:stop]
        at = stop + 4


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, scratch: Scratch, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all rows as bundles; the index (record_id, bundle, frame, offset, length), already materialised."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.coalesce(F.col(payload_column), F.lit("")).alias("payload"))
    digest = [F.sha1(F.encode("payload", "UTF-8")).alias("sha1"), F.xxhash64("payload").alias("other"), F.octet_length("payload").alias("size")]
    folder = scratch.path("bundles")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, index, made = None, [], 0
        attempt = os.urandom(8).hex()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if writer is None:
                        store, root = pafs.FileSystem.from_uri(folder)
                        store.create_dir(root, recursive=True)
                        name = f"{attempt}-{made:04d}.warc.zst"
                        writer, made = BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None), frame_bytes), made + 1
                    record_id, record = _record(row)
                    frame, offset = writer.add(record)
                    index.append((record_id, f"{folder}/{name}", frame, offset, len(record)))
                    if writer.total >= bundle_bytes:
                        writer.close()
                        writer = None
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*index, strict=True)], schema=pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
                    index = []
        if writer is not None:
            writer.close()

    with scratch.inner("steps") as inner:
        digests = inner.table(rows.where("page_id is not null").select("page_id", *digest), "digests")
        shared = inner.table(
            digests.groupBy("sha1", "other", "size").agg(F.max("page_id").alias("response"), F.min("page_id").alias("least")).where("least < response").drop("least"), "shared"
        )
        revisits = inner.table(digests.join(shared, ["sha1", "other", "size"]).where("page_id < response").select("page_id", "response").distinct(), "revisits")
        marked = rows.join(revisits, "page_id", "left")
        return scratch.table(marked.select("page_id", "url", "payload", "response").mapInArrow(write, INDEX_SCHEMA), "index")


def record_name(page_id: int | None) -> str:
    """A page's record identifier; rows without a page id get a random one."""
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:none-{os.urandom(12).hex()}>"


def _record(row: dict) -> tuple[str, bytes]:
    payload = row["payload"].encode()
    name = record_name(row["page_id"])
    target = "".join(c for c in row["url"] or "" if c not in "\r\n")
    headers = [
        ("WARC-Type", "response" if row["response"] is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "text/html; charset=utf-8"), ("X-Payload-Length", str(len(payload))),
    ]
    if row["response"] is None:
        return name, make_record(headers, payload)
    headers += [("WARC-Refers-To", record_name(row["response"])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return name, make_record(headers, b"")


def read_archives(index: DataFrame, part_frames: int = 256) -> DataFrame:
    """Every record of the bundles that the index names, read frame by frame; a response's digest and length are computed from its block.

    There are as many tasks as parts of ``part_frames`` frames, a bundle being one part at least.
    """
    frames = index.groupBy("bundle", "frame").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("frame") / part_frames))
    # index rows are tiny and the frames they name are not, so the number of tasks follows the frames and is fixed: Spark
    # does not merge partitions of a stated number
    tasks = index.agg(F.count_distinct("bundle", F.floor(F.col("frame") / part_frames))).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, table = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != opened:
                    if source is not None:
                        source.close()
                    store, path = pafs.FileSystem.from_uri(row["bundle"])
                    opened, source = row["bundle"], store.open_input_file(path)
                    table = seek_table(source)
                got = list(parse_records(read_frame(source, table[row["frame"]])))
                if len(got) != row["n"]:
                    raise ValueError(f"{opened}, frame {row['frame']}: {len(got)} records, {row['n']} indexed")
                yield pa.RecordBatch.from_pylist([_described(*x) for x in got], schema=_READ)
        if source is not None:
            source.close()

    return frames.repartition(max(tasks, 1), "bundle", "part").drop("part").sortWithinPartitions("bundle", "frame").mapInArrow(read, "record_id string, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


_READ = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _described(fields: dict[str, str], block: bytes) -> dict:
    response = fields["WARC-Type"] == "response"
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    digest = payload_digest(block) if response else stated
    if digest != stated:
        raise ValueError(f"{fields['WARC-Record-ID']}: its payload has another digest")
    return {
        "record_id": fields["WARC-Record-ID"], "target_uri": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": len(block) if response else int(fields["X-Payload-Length"]),
        "payload_digest": digest, "refers_to": fields.get("WARC-Refers-To"), "payload": block if response else None,
    }


def read_record(index: DataFrame, record_id: str) -> tuple[dict[str, str], bytes]:
    """One record by its identifier: one index row, one frame."""
    row = index.where(F.col("record_id") == record_id).first()
    if row is None:
        raise KeyError(record_id)
    store, path = pafs.FileSystem.from_uri(row["bundle"])
    with store.open_input_file(path) as source:
        frame = read_frame(source, seek_table(source)[row["frame"]])
    return next(parse_records(frame[row["offset"] : row["offset"] + row["length"]]))


def page_number(record_name: Column) -> Column:
    """The page id in a record identifier; null where the page had none."""
    return F.regexp_extract(record_name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

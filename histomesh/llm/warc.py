"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and a seek
table at its end in a skippable frame (the public seekable format), so that a reader fetches one
frame without the ones before it. The index maps a record id to (bundle, frame, offset in the
decompressed frame). Bundles go to the shared folder that the cluster names; a bundle name holds
the task attempt, and the index rows are committed by Spark, so files of lost attempts are never
read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.session import durable, ensure_checkpoint_dir

# fixed values of the seekable Zstandard format and of RFC 4648
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_DATE = "2024-01-01T00:00:00Z"
FRAMES = "bundle string, frame int, record_id array<bigint>, offset array<bigint>, length array<bigint>"
RECORDS = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "url string, bundle string, frame int, offset bigint"
)


def base32_sha1(binary: Column) -> Column:
    """Bare upper-case base32 SHA-1, from four groups of 40 bits."""
    digest = F.sha1(binary)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), BASE32_HEX, BASE32)


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload, digest and the id of the response that holds the payload (``head``).

    Of equal payloads of at least ``min_bytes`` the largest page_id is the response; a null id is
    the smallest. A repeated row of that id is a response again. Heads exist only for payloads
    that occur twice or more; they are stored, so that the join's two sides are plain exchanges
    and a payload that holds a third of the rows is split by adaptive execution.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    heads = durable(
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "head", F.lit(True).alias("shared"))
    )
    joined = rows.join(heads, "digest", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("head"))
    return joined.select(
        "page_id",
        "url",
        "digest",
        F.octet_length("payload").cast("long").alias("size"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, F.col("head")).alias("refers_to"),
        revisit.alias("revisit"),
    )


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    if "://" not in path:
        path = "file://" + os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _id_of(urn: str) -> int | None:
    value = urn.strip()[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


def record_bytes(page_id: int | None, url: str, digest: str, size: int, payload: bytes | None, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header with the payload's length and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(7, f"WARC-Refers-To: {_urn(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, decompressed) sizes and the seekable footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(handle) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the end of the file."""
    size = handle.size()
    handle.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", handle.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    handle.seek(size - 9 - 8 * count)
    sizes = struct.unpack(f"<{2 * count}I", handle.read(8 * count))
    out, at = [], 0
    for packed, plain in zip(sizes[::2], sizes[1::2]):
        out.append((at, packed, plain))
        at += packed
    return out


class _Bundle:
    """One open bundle file of a task."""

    def __init__(self, folder: str, stem: str, number: int, level: int):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        self.name = f"{stem}-{number:04d}.warc.zst"
        self.out = fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.written = 0
        self.records: list[bytes] = []
        self.ids: list[int | None] = []
        self.offsets: list[int] = []
        self.filled = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.ids.append(page_id)
        self.offsets.append(self.filled)
        self.records.append(record)
        self.filled += len(record)

    def end_frame(self) -> tuple:
        plain = b"".join(self.records)
        packed = self.packer.compress(plain)
        self.out.write(packed)
        row = (self.name, len(self.frames), self.ids, self.offsets, [len(r) for r in self.records])
        self.frames.append((len(packed), len(plain)))
        self.written += len(packed)
        self.records, self.ids, self.offsets, self.filled = [], [], [], 0
        return row

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Writes rows of ``with_roles`` to bundles under ``folder``; returns one stored row per frame.

    A frame ends when it holds ``frame_bytes``; a longer record is a frame of its own.
    """
    schema = pa.schema([
        ("bundle", pa.string()), ("frame", pa.int32()), ("record_id", pa.list_(pa.int64())),
        ("offset", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())),
    ])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        bundle, number = None, 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            done = []
            for i in range(batch.num_rows):
                page_id, url, digest, size, payload, refers_to, revisit = (c[i].as_py() for c in columns)
                record = record_bytes(page_id, url, digest, size, payload, refers_to, revisit)
                if bundle is None:
                    bundle, number = _Bundle(folder, stem, number, level), number + 1
                if bundle.records and bundle.filled + len(record) > frame_bytes:
                    done.append(bundle.end_frame())
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        bundle, number = _Bundle(folder, stem, number, level), number + 1
                bundle.add(page_id, record)
            if done:
                yield batch_of(done)
        if bundle is not None:
            row = bundle.end_frame()
            bundle.close()
            yield batch_of([row])

    return durable(records.mapInArrow(write, FRAMES))


def record_index(frames: DataFrame) -> DataFrame:
    """record_id -> bundle, frame, offset and length within the decompressed frame."""
    zipped = F.arrays_zip("record_id", "offset", "length")
    return frames.select("bundle", "frame", F.explode(zipped).alias("r")).select("r.*", "bundle", "frame")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_bundles(frames: DataFrame, folder: str) -> DataFrame:
    """Reads the records that ``frames`` points to, checks every payload, returns one row each.

    A row of ``frames`` may name a part of a frame's records (a lookup by id); only the frames
    named are fetched, each by its place in the seek table.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "bundle", "frame", "offset"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        opened, handle, table = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != opened:
                    if handle is not None:
                        handle.close()
                    opened, handle = row["bundle"], fs.open_input_file(f"{base}/{row['bundle']}")
                    table = read_seek_table(handle)
                start, packed, plain = table[row["frame"]]
                handle.seek(start)
                data = zstandard.ZstdDecompressor().decompress(handle.read(packed), max_output_size=max(plain, 1))
                out = []
                for offset, length in zip(row["offset"], row["length"]):
                    fields, block = parse_record(data[offset : offset + length])
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
                    digest, kind = fields["WARC-Payload-Digest"][len("sha1:") :], fields["WARC-Type"]
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                    refers = _id_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((_id_of(fields["WARC-Record-ID"]), size, digest, kind, refers, fields["WARC-Target-URI"], opened, row["frame"], offset))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if handle is not None:
            handle.close()

    return frames.mapInArrow(read, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, **sizes: int) -> tuple[DataFrame, str]:
    """Writes ``pages`` (page_id, url, html) as bundles; returns the frame table and the folder.

    Null html is an empty payload, null url an empty target; other columns are ignored. An empty
    table gives no bundle and an empty frame table.
    """
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return write_bundles(with_roles(pages, min_bytes), folder, **sizes), folder

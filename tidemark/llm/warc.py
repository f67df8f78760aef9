"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of some whole records; an
index in a skippable frame that maps record ids to (frame, offset in the frame's
content); and the seek table of the seekable format, a skippable frame with the
compressed and decompressed size of every frame, whose footer ends the bundle.
One record is read by decompressing one frame.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the
largest page_id is the response and the others are revisits of it, which carry no
payload.  Bundles are rows (part, bundle, payload) of a Parquet table, written and
read by Spark on any file system; ``export`` copies them out as plain files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import map_arrow, small_or_shuffled, tidy, written

#: Fixed values of the Zstandard seekable format and of skippable frames.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Content of a frame and of a bundle, in bytes, after which it is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 32 << 20
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit of another page's response if refers_to is given."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    target = "".join(c for c in url or "about:blank" if c not in "\r\n")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _uri(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    if revisit:
        fields[4:4] = [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(content: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at a place: its fields, its body and where the next one begins."""
    end = content.index(b"\r\n\r\n", at)
    version, *lines = content[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    return fields, content[end + 4 : end + 4 + size], end + 4 + size + 4


class Writer:
    """Builds one bundle."""

    def __init__(self, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.zstd, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_content_size=True), frame_bytes
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, record_id: str, raw: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.size))
        self.held.append(raw)
        self.size += len(raw)
        self.total += len(raw)
        if self.size >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.frames.append(frame)
            self.table.append((len(frame), self.size))
            self.held, self.size = [], 0

    def bytes(self) -> bytes:
        self._close()
        index = zlib.compress(json.dumps(self.index).encode(), 1)
        at = sum(map(len, self.frames))
        # the seek table lists the index frame too, with no content, so that sizes add up to offsets
        table = [*self.table, (8 + len(index), 0)]
        rows = b"".join(struct.pack("<II", *x) for x in table)
        foot = rows + struct.pack("<IBI", len(table), 0, SEEKABLE)
        out = b"".join(self.frames) + struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_SEEK, len(foot)) + foot
        assert len(out) == at + 8 + len(index) + 8 + len(foot)
        return out


class Bundle:
    """Reads a bundle through its seek table."""

    def __init__(self, raw: bytes):
        self.raw, self.zstd = raw, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack_from("<IBI", raw, len(raw) - 9)
        if magic != SEEKABLE or flags & 0x7C:
            raise ValueError("not a seekable bundle")
        width = 12 if flags & 0x80 else 8
        first = len(raw) - 9 - n * width
        sizes = [struct.unpack_from("<II", raw, first + i * width) for i in range(n)]
        self.places, at = [], 0
        for packed, plain in sizes:
            self.places.append((at, packed, plain))
            at += packed

    def __len__(self) -> int:
        return len(self.places) - 1

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.places[i]
        return self.zstd.decompress(self.raw[at : at + packed], max_output_size=plain)

    def index(self) -> list[tuple[str, int, int]]:
        at, packed, _ = self.places[-1]
        return [tuple(x) for x in json.loads(zlib.decompress(self.raw[at + 8 : at + packed]))]

    def read_all(self, record_id: str) -> list[tuple[dict[str, str], bytes]]:
        """The records of an id, each from one frame; several where rows of pages share a page_id or have none."""
        return [parse(self.frame(f), o)[:2] for r, f, o in self.index() if r == record_id]

    def read(self, record_id: str) -> tuple[dict[str, str], bytes]:
        """The only record of an id, from one frame."""
        at = [(f, o) for r, f, o in self.index() if r == record_id]
        if len(at) != 1:
            raise KeyError(f"{record_id}: {len(at)} records")
        return parse(self.frame(at[0][0]), at[0][1])[:2]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self)):
            content, at = self.frame(i), 0
            while at < len(content):
                fields, body, at = parse(content, at)
                yield fields, body


def write(pages: DataFrame, path: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Writes a record per row of pages (page_id, url, html; other columns are ignored) to bundles at path.

    A null html is an empty payload, a null page_id the smallest of all.  Rows
    with the page_id of the response are responses too; rows that share a page_id,
    or have none, share a record id.  A very long page is a frame of its own.  An
    empty table gives no bundle.  Payloads are not shuffled while few of them have
    copies.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("sha", F.concat(F.sha1("payload"), F.octet_length("payload").cast("string")))
    copies = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response"))
    copies = written(copies.where("n > 1 and response is not null").select("sha", "response"), "warc-copies")
    joined = keyed.join(small_or_shuffled(copies, copies.count()), "sha", "left")
    to = F.when((F.col("page_id") != F.col("response")) | F.col("page_id").isNull(), F.col("response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, bundle = TaskContext.get().partitionId(), 0, Writer(frame_bytes=frame_bytes)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([bundle.bytes()], pa.binary())], ["part", "bundle", "payload"])

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bundle.add(_uri(page_id), record(page_id, url, payload, refers_to))
                if bundle.total >= bundle_bytes:
                    yield row()
                    n, bundle = n + 1, Writer(frame_bytes=frame_bytes)
        if bundle.total:
            yield row()

    bundles = map_arrow(joined.select("page_id", "url", "payload", to.alias("refers_to")), run, "part int, bundle int, payload binary")
    bundles.write.option("compression", "uncompressed").parquet(path)


def _number(uri: str | None) -> int | None:
    name = uri and uri[len("<urn:page:") : -1]
    return None if name in (None, "none") else int(name)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each record at path: page_id, payload_bytes, payload_digest, record_type, refers_to, url, and its part, bundle, frame.

    A response's payload is held against its digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bundle, out = Bundle(raw), []
                frames = [f for _, f, _ in bundle.index()]
                for frame, (fields, body) in zip(frames, bundle.records(), strict=True):
                    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and digest(body) != named:
                        raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
                    out.append((_number(fields["WARC-Record-ID"]), int(fields["WARC-Payload-Length"]), named, fields["WARC-Type"], _number(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], part, n, frame))
                yield _batch(out)

    files = spark.read.schema("part int, bundle int, payload binary").parquet(path)
    return files.mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, part int, bundle int, frame int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "part", "bundle", "frame"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def export(spark: SparkSession, path: str, folder: str) -> int:
    """Copies the bundles at path out to a local folder, one at a time; returns how many."""
    n = 0
    for n, row in enumerate(spark.read.parquet(path).orderBy("part", "bundle").toLocalIterator(), 1):
        Path(folder, f"pages-{row.part:05d}-{row.bundle:05d}.warc.zst").write_bytes(row.payload)
    return n


__all__ = ["Bundle", "Writer", "digest", "export", "parse", "read", "record", "write"]

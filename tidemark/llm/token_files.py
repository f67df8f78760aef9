"""Token-id files: one array of ids per file with the documents' boundaries in Elias-Fano form.

A file is a run of documents in ascending doc_id order.  Layout, little-endian::

    "TMEF" | version u16 | bytes per id u16 | documents u64 | ids u64 | null-id documents u64
    boundaries   Elias-Fano of 0, n1, n1+n2, ..., ids     (documents + 1 values)
    doc_ids      smallest id i64, then Elias-Fano of id - smallest, over documents whose id is not null
    ids          u16 or u32 each

Files are rows (part, file, ids, payload) of a Parquet table, so they are written and
read by Spark's committers on any file system and a lost executor leaves no half
file; ``export`` copies them out as plain files.  Documents with a null doc_id come
first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano
from .shared import map_arrow, small_or_shuffled, spread
from .tokens import Shipped

MAGIC, VERSION = b"TMEF", 1
HEAD = struct.Struct("<4sHHQQQ")
FILES = "part int, file int, ids long, payload binary"
#: Ids after which a file is closed; documents read at once.
FILE_IDS, READ_DOCS = 4_000_000, 4096


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: documents in ascending doc_id order (null first), the number of ids of each, and all ids."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = HEAD.pack(MAGIC, VERSION, width, len(doc_ids), len(ids), len(doc_ids) - len(known))
    # a difference of two 64-bit integers is exact modulo 2^64
    gaps = known.astype(np.uint64) - np.uint64(least & (1 << 64) - 1)
    bounds = elias_fano.encode(np.concatenate(([0], np.cumsum(sizes))))
    return head + bounds + struct.pack("<q", least) + elias_fano.encode(gaps) + ids.astype(f"<u{width}").tobytes()


class TokenFile:
    """Reads a file: document i's ids are ids(i), found by selects on the boundaries; find() searches doc_ids by select."""

    def __init__(self, raw: bytes):
        magic, version, width, self.n_docs, self.n_ids, self.n_null = HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id file")
        self.bounds = elias_fano.Sequence(raw, HEAD.size)
        (self.least,) = struct.unpack_from("<q", raw, self.bounds.end)
        self.gaps = elias_fano.Sequence(raw, self.bounds.end + 8)
        self.flat = np.frombuffer(raw, f"<u{width}", self.n_ids, self.gaps.end)

    def doc_ids(self, first: int = 0, stop: int | None = None) -> list[int | None]:
        """The doc_ids of documents first to stop, exclusive."""
        stop = self.n_docs if stop is None else min(stop, self.n_docs)
        gaps = self.gaps.range(max(0, first - self.n_null), max(0, stop - self.n_null))
        known = (gaps + np.uint64(self.least & (1 << 64) - 1)).astype(np.int64)
        return [None] * max(0, min(stop, self.n_null) - first) + known.tolist()

    def starts(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        """Where documents first to stop begin, and where the last of them ends."""
        stop = self.n_docs if stop is None else min(stop, self.n_docs)
        return self.bounds.range(first, stop + 1).astype(np.int64)

    def ids(self, i: int) -> np.ndarray:
        at = self.bounds.range(i, i + 2).astype(np.int64)
        return self.flat[at[0] : at[1]]

    def find(self, doc_id: int) -> int | None:
        """The first document with a doc_id, by binary search with select; None if there is none."""
        low, high = 0, len(self.gaps)
        while low < high:
            middle = (low + high) // 2
            if self.gaps.select(middle) + self.least < doc_id:
                low = middle + 1
            else:
                high = middle
        found = low < len(self.gaps) and self.gaps.select(low) + self.least == doc_id
        return self.n_null + low if found else None


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, file_ids: int = FILE_IDS) -> None:
    """Encodes docs (doc_id, text; other columns are ignored) and writes token-id files to path.

    A null text counts as empty; each document's ids end with end_id.  Rows with
    equal doc_id, or with none, follow each other by a hash of their text, so that
    ranges can part them however many they are.  A very long text is encoded
    whole.  An empty table gives no file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange(spread(docs), "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    shipped = Shipped(docs.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shipped.tokenizer()
        docs_in: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        part = n_file = held = 0

        def close() -> pa.RecordBatch:
            nonlocal docs_in, sizes, ids, held, n_file
            raw = pack(docs_in, np.concatenate(sizes), np.concatenate(ids))
            total = held
            docs_in, sizes, ids, held, n_file = [], [], [], 0, n_file + 1
            row = [pa.array([part], pa.int32()), pa.array([n_file - 1], pa.int32()), pa.array([total], pa.int64()), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "file", "ids", "payload"])

        for b in batches:
            part = b.column(0)[0].as_py()
            got, n = tok.encode(b.column(2))
            ends = np.cumsum(n + 1)
            with_end = np.full(int(ends[-1]), end_id, "<u4")
            inner = np.ones(len(with_end), bool)
            inner[ends - 1] = False
            with_end[inner] = got
            docs_in += b.column(1).to_pylist()
            sizes.append(n + 1)
            ids.append(with_end)
            held += len(with_end)
            if held >= file_ids:
                yield close()
        if docs_in:
            yield close()

    files = map_arrow(ordered, encode, FILES, tokens=True)
    files.write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the files at path: doc_id, part, file, place (in its file), start (in all ids), n_tokens, ids_crc32."""
    files = spark.read.schema(FILES).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                f = TokenFile(raw)
                for i in range(0, f.n_docs, READ_DOCS):  # a select on the boundaries, then the documents that follow
                    at = f.starts(i, i + READ_DOCS)
                    ids = f.flat[at[0] : at[-1]].astype("<u4")
                    cuts = (at - at[0]).tolist()
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                    n = len(crc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids(i, i + n), pa.int64()), pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array(np.arange(i, i + n)), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        ["doc_id", "part", "file", "place", "local", "n_tokens", "ids_crc32"],
                    )

    # where a part begins: its files' ids, summed part by part; a window over parts, of which there are as many as partitions
    sized = files.select("part", "file", "ids")
    parts = sized.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.expr("sum(ids) over (order by part) - ids").alias("base"))
    within = sized.select("part", "file", F.expr("sum(ids) over (partition by part order by file) - ids").alias("before"))
    starts = within.join(F.broadcast(parts), "part").select("part", "file", (F.col("base") + F.col("before")).alias("base"))
    docs = map_arrow(files.select("part", "file", "payload"), decode, "doc_id long, part int, file int, place long, local long, n_tokens long, ids_crc32 long")
    n_files = files.count()
    placed = docs.join(small_or_shuffled(starts, n_files), ["part", "file"])
    return placed.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "file", "place")


def export(spark: SparkSession, path: str, folder: str) -> int:
    """Copies the files at path out to a local folder, one at a time, in order; returns how many."""
    n = 0
    for n, row in enumerate(spark.read.parquet(path).orderBy("part", "file").toLocalIterator(), 1):
        Path(folder, f"tokens-{row.part:05d}-{row.file:05d}.tmef").write_bytes(row.payload)
    return n

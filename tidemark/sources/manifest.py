"""The manifest: which segments make up the store, as immutable versions.

A version is one JSON file, ``manifest/NNNNNNNNNN.json``, written under another
name and then given its own in one step that fails if the name is taken, so that a
reader sees all of a commit or nothing and of two writers one has a conflict.
Files are reached through Hadoop's file system, so the root may be in any store
that Spark reads.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RANGE_DELETE

MANIFEST = "manifest"


class Conflict(RuntimeError):
    """Someone else committed, or a segment of that name differs."""


@dataclass(frozen=True)
class Segment:
    segment_id: int
    level: int
    path: str
    first_key: str  # hexadecimal
    last_key: str
    min_seq: int
    max_seq: int
    entry_count: int
    rdel_count: int
    node_id: int = 0
    seal_wall: int = 0
    live_lower_bound: str = ""

    def descriptor(self) -> dict:
        """What names the contents: everything but where they are."""
        d = asdict(self)
        return {k: d[k] for k in d if k not in ("level", "path", "live_lower_bound")}

    def overlaps(self, first: str, last: str) -> bool:
        return self.first_key <= last and first <= self.last_key


@dataclass(frozen=True)
class Version:
    number: int = 0
    segments: tuple[Segment, ...] = ()
    flushed_seq: int = 0
    next_seq: int = 1
    next_segment: int = 1
    snapshots: dict[str, int] = field(default_factory=dict)
    unsealed: tuple[str, ...] = ()
    epochs: dict[str, int] = field(default_factory=dict)
    tickets: dict[str, int] = field(default_factory=dict)
    unsealed_rows: int = 0

    def level(self, n: int) -> list[Segment]:
        return [s for s in self.segments if s.level == n]

    def segment(self, segment_id: int) -> Segment | None:
        return next((s for s in self.segments if s.segment_id == segment_id), None)

    def problems(self) -> list[str]:
        """What breaks the rules of the structure; nothing in a sound store."""
        out = []
        for s in self.segments:
            if s.min_seq > s.max_seq or s.first_key > s.last_key:
                out.append(f"segment {s.segment_id}: bounds are inverted")
            if s.max_seq >= self.next_seq:
                out.append(f"segment {s.segment_id}: seq {s.max_seq} is not below the counter {self.next_seq}")
        ids = [s.segment_id for s in self.segments]
        if len(ids) != len(set(ids)):
            out.append("segment ids repeat")
        for n in {s.level for s in self.segments} - {0}:
            run = sorted(self.level(n), key=lambda s: s.first_key)
            out += [f"level {n}: segments {a.segment_id} and {b.segment_id} overlap" for a, b in zip(run, run[1:], strict=False) if a.node_id == b.node_id and b.first_key < a.last_key]  # a last key may be the end of a range delete, which is not in it
        if self.flushed_seq >= self.next_seq:
            out.append("the flushed floor is not below the counter")
        return out


class Files:
    """A few operations on any Hadoop file system, from the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Writes a whole file under a name that is not taken; False if it is."""
        target = self.path(name)
        if self.fs.exists(target):
            return False
        self.fs.mkdirs(target.getParent())
        draft = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft, False)
        stream.write(data)
        stream.close()
        try:
            self._claim(draft, target)
        except Py4JJavaError as e:
            if self.fs.exists(target):
                return False
            raise OSError(f"{name} was not written") from e
        finally:
            self.fs.delete(draft, False)
        return True

    def _claim(self, draft, target) -> None:
        """Gives a file its name, in one step that fails if the name is taken."""
        if self.fs.getUri().getScheme() == "file":  # a rename would replace what is there; a link cannot
            nio = self.jvm.java.nio.file
            local = lambda p: nio.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0))
            nio.Files.createLink(local(target), local(draft))
        else:
            options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)

    def move(self, name: str, to: str) -> bool:
        self.fs.mkdirs(self.path(to).getParent())
        return self.fs.rename(self.path(name), self.path(to))

    def copy(self, name: str, other: Files, to: str) -> None:
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(name), other.fs, other.path(to), False, self.spark._jsc.hadoopConfiguration()):
            raise OSError(f"{name} was not copied")


def _dump(v: Version) -> bytes:
    body = json.dumps(asdict(v), sort_keys=True)
    return json.dumps({"crc32": zlib.crc32(body.encode()), "manifest": body}).encode()


def _parse(raw: bytes) -> Version | None:
    try:
        outer = json.loads(raw)
        body = outer["manifest"]
        if zlib.crc32(body.encode()) != outer["crc32"]:
            return None
        d = json.loads(body)
        return Version(**d | {"segments": tuple(Segment(**s) for s in d["segments"]), "unsealed": tuple(d["unsealed"])})
    except (ValueError, KeyError, TypeError):
        return None


def latest(files: Files) -> Version:
    """The newest intact version; version 0, empty, if there is none."""
    for name in reversed([n for n in files.names(MANIFEST) if n.endswith(".json")]):
        if (v := _parse(files.read(f"{MANIFEST}/{name}"))) is not None:
            return v
    return Version()


def commit(files: Files, v: Version) -> Version:
    """Makes v the next version, in one atomic step."""
    if found := v.problems():
        raise ValueError("; ".join(found))
    taken = [int(n.split(".")[0]) for n in files.names(MANIFEST) if n.endswith(".json")]
    if taken and max(taken) > v.number and latest(files).number > v.number:
        raise Conflict(f"version {v.number} is not the latest")
    v = replace(v, number=max([v.number, *taken]) + 1)
    if not files.create(f"{MANIFEST}/{v.number:010d}.json", _dump(v)):
        raise Conflict(f"version {v.number} exists")
    return v


def frame(spark: SparkSession, v: Version) -> DataFrame:
    """The segments of a version as rows."""
    schema = "segment_id long, level int, path string, first_key string, last_key string, min_seq long, max_seq long, entry_count long, rdel_count long, node_id long, seal_wall long, live_lower_bound string"
    return spark.createDataFrame([tuple(asdict(s).values()) for s in v.segments], schema)


def segment_stats(rows: DataFrame) -> DataFrame:
    """(segment_id, first_key, last_key, min_seq, max_seq, entry_count, rdel_count) of log rows; the end of a range delete counts as a key."""
    ranged = F.col("op") == RANGE_DELETE
    top = F.when(ranged, F.col("val")).otherwise(F.col("key"))
    sums = [F.min("key").alias("first_key"), F.max(top).alias("last_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")]
    return rows.groupBy("segment_id").agg(*sums, F.count(F.lit(1)).alias("entry_count"), F.count(F.when(ranged, 1)).alias("rdel_count"))


def reaches(start=None, end=None, max_seq: int | None = None) -> Column:
    """Whether a segment, a manifest row, can hold something of [start, end) at or below a snapshot."""
    where = F.lit(True)
    if start is not None:
        where = where & (F.col("last_key") >= F.lit(start))
    if end is not None:
        where = where & (F.col("first_key") < F.lit(end))
    return where if max_seq is None else where & (F.col("min_seq") <= max_seq)


def overlapping(segments: DataFrame) -> DataFrame:
    """(segment_id, other) of the pairs of segments, manifest rows, whose key ranges meet."""
    others = F.broadcast(segments.select(F.col("segment_id").alias("other"), F.col("first_key").alias("_first"), F.col("last_key").alias("_last")))  # a row per segment
    meet = (F.col("segment_id") < F.col("other")) & (F.col("first_key") <= F.col("_last")) & (F.col("_first") <= F.col("last_key"))
    return segments.join(others, meet).select("segment_id", "other")


def level_stats(segments: DataFrame) -> DataFrame:
    """(level, segments, entries, rdels, min_seq, max_seq) of each level of manifest rows."""
    sums = [F.sum("entry_count").alias("entries"), F.sum("rdel_count").alias("rdels"), F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq")]
    return segments.groupBy("level").agg(F.count(F.lit(1)).alias("segments"), *sums)

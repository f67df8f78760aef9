"""A store: unsealed log files, sealed segments sorted by (key, seq descending), and a manifest that names them.

Writers append log files under the manifest's next sequence numbers; flush seals
them as level-0 segments, compaction rewrites segments through the retention
rules.  Whatever a manifest version does not name does not exist, so a job that
fails leaves only files that nothing reads.

A rewrite makes as many segments as its rows take, cut between keys, and range
deletes with them, so that a later step rewrites those that it meets and no more.
In a segment, point versions and range deletes are in folders of their own:
resolving reads few files for the range deletes.  All segments that a read needs
are one scan, whose rows name their segment; the manifest adds their origin.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import tick_of
from ..operators import recorder, scan
from ..operators.bins import bin_of, even_bounds
from ..operators.retention import compact
from ..plans.groups import complete
from ..plans.resolve import resolve
from ..plans.scratch import drop, new_path
from ..schema import LATEST, LOG, RANGE_DELETE, Batch, InvalidMutation, checked
from . import manifest
from .manifest import Conflict, Files, Segment, Version

#: Level-0 segments, and segments of a deeper level, from which a level is full.
FULL = 4
#: Rows from which a task of its own pays for a segment; of smaller segments a task writes several.
TASK_ROWS = 200_000
KINDS = ("points", "ranges")
COLUMNS = [f.name for f in LOG]


@dataclass(frozen=True)
class Job:
    """What one compaction step takes: segments of a level, and those of the next that are merged with them; move if nothing is rewritten."""

    level: int
    sources: tuple[Segment, ...]
    targets: tuple[Segment, ...]
    move: bool = False


class Line:
    """Segments in the order of their first keys, to find those that meet a range of keys without a look at all."""

    def __init__(self, segments: list[Segment]):
        self.segments = sorted(segments, key=lambda s: s.first_key)
        self.first = [s.first_key for s in self.segments]
        self.last = list(accumulate((s.last_key for s in self.segments), max))  # the largest so far

    def meeting(self, low: str, high: str) -> list[Segment]:
        return [s for s in self.segments[bisect_left(self.last, low) : bisect_right(self.first, high)] if s.last_key >= low]

    def beside(self, low: str, high: str) -> list[Segment]:
        """The nearest segments that lie wholly before and after a range."""
        at = bisect_right(self.first, high)
        left = next((s for s in reversed(self.segments[:at]) if s.last_key < low), None)
        return [s for s in (left, *self.segments[at : at + 1]) if s is not None]


class Store:
    """levels: how many there are; the deepest has no limit.  segment_rows: rows of a segment that a rewrite makes.

    most_segments: from so many on, levels that are not full are compacted too.
    """

    def __init__(self, spark: SparkSession, root: str, snapshots: int = 8, row_group: int = 128 << 20, levels: int = 7, segment_rows: int = 20_000_000, most_segments: int = 10_000):
        self.spark, self.files, self.most_snapshots, self.row_group = spark, Files(spark, root), snapshots, row_group
        self.levels, self.segment_rows, self.most_segments = levels, segment_rows, most_segments
        self.root = self.files.root

    # versions

    def version(self) -> Version:
        return manifest.latest(self.files)

    def commit(self, v: Version) -> Version:
        return manifest.commit(self.files, v)

    def swap(self, v: Version, gone: tuple[Segment, ...], made: tuple[Segment, ...], next_segment: int, tries: int = 5) -> Version:
        """Commits made instead of gone; writes that others commit meanwhile stay, other changes of the segments are a conflict."""
        out = set(gone)
        for _ in range(tries):
            now = self.version()
            if now.segments != v.segments or now.next_segment != v.next_segment:
                raise Conflict("the segments have changed")
            kept = tuple(s for s in now.segments if s not in out)
            try:
                return self.commit(replace(now, segments=(*kept, *made), next_segment=next_segment))
            except Conflict:
                continue
        raise Conflict("other writers were faster")

    def check(self) -> list[str]:
        return self.version().problems()

    # writing

    def write(self, batch: Batch, node_id: int = 0) -> int:
        """Appends one batch, all or nothing; returns its first sequence number, or the next one for an empty batch."""
        return self.write_group([batch], node_id)[0]

    def write_group(self, batches: list[Batch], node_id: int = 0) -> list[int]:
        """Appends the batches of several writers in one commit, each a batch of its own; returns their first sequence numbers."""
        v = self.version()
        first, ops = [], []
        for batch in batches:
            at = v.next_seq + len(ops)
            first.append(at)
            ops += [(at + i, op, key, val, expire, at, node_id, 0, None) for i, (op, key, val, expire) in enumerate(batch.ops)]
        if ops:
            self.append(self.spark.createDataFrame(ops, LOG), len(ops), v)
        return first

    def append(self, rows: DataFrame, count: int, v: Version | None = None, name: str | None = None, epochs: dict[str, int] | None = None, tickets: dict[str, int] | None = None) -> int:
        """Appends rows that are numbered from the next sequence number on; epochs and tickets of their sources are part of the commit."""
        v = v or self.version()
        if v.next_seq + count - 1 > LATEST:
            raise InvalidMutation("sequence number out of range")
        path = f"log/{name or uuid.uuid4().hex}"
        if count:
            rows.select(COLUMNS).write.mode("errorifexists").parquet(f"{self.root}/{path}")
        new = replace(v, next_seq=v.next_seq + count, unsealed=(*v.unsealed, *([path] if count else [])), unsealed_rows=v.unsealed_rows + count)
        self.commit(replace(new, epochs={**v.epochs, **(epochs or {})}, tickets={**v.tickets, **(tickets or {})}))
        return v.next_seq

    def replay(self, rows: DataFrame) -> int:
        """Takes over a log that another process left: rows (seq, op, key, val, expire_at, batch_id, pos, closes, node_id).

        Of it count the valid rows of whole groups above the highest sequence
        number here, under their own sequence numbers; what was replayed before,
        or breaks off, is left out.  Returns how many rows were taken.
        """
        v = self.version()
        good = checked(complete(rows)[0].where(F.col("seq") >= v.next_seq))[0]
        flat = good.withColumns({"seal_wall": F.lit(0).cast("long"), "segment_id": F.lit(None).cast("long")}).select(COLUMNS)
        path = f"log/{uuid.uuid4().hex}"
        flat.write.parquet(f"{self.root}/{path}")
        n, top = self.spark.read.schema(LOG).parquet(f"{self.root}/{path}").agg(F.count(F.lit(1)), F.max("seq")).first()
        if n:
            self.commit(replace(v, next_seq=top + 1, unsealed=(*v.unsealed, path), unsealed_rows=v.unsealed_rows + n))
        return n

    # reading

    def unsealed(self, v: Version | None = None) -> DataFrame:
        """Log rows above the flushed floor, of whole batches only: a file is committed whole or not at all."""
        v = v or self.version()
        rows = self.spark.read.schema(LOG).parquet(*[f"{self.root}/{p}" for p in v.unsealed]) if v.unsealed else self.spark.createDataFrame([], LOG)
        return rows.where(F.col("seq") > v.flushed_seq)

    def segment(self, s: Segment) -> DataFrame:
        """All versions of one segment, deletions included; dead entries below a narrowed bound left out."""
        return self.rows_of([s])

    def rows_of(self, segments: list[Segment], kinds: tuple[str, ...] = KINDS) -> DataFrame:
        """The rows of segments, in one scan, with the origin that the manifest gives; dead entries below narrowed bounds left out."""
        count = {"points": lambda s: s.entry_count - s.rdel_count, "ranges": lambda s: s.rdel_count}
        paths = [f"{self.root}/{s.path}/kind={k}" for s in segments for k in kinds if count[k](s)]
        if not paths:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG).parquet(*paths).drop("node_id", "seal_wall")
        origin = self.spark.createDataFrame([(s.segment_id, s.node_id, s.seal_wall, bytes.fromhex(s.live_lower_bound)) for s in segments], "segment_id long, node_id long, seal_wall long, _live binary")
        out = rows.join(F.broadcast(origin), "segment_id")  # a row per segment of the manifest
        if any(s.live_lower_bound for s in segments):
            out = out.where((F.col("key") >= F.col("_live")) | ((F.col("op") == RANGE_DELETE) & (F.col("val") > F.col("_live"))))
            out = out.withColumn("key", F.greatest("key", F.when(F.col("op") == RANGE_DELETE, F.col("_live"))))
        return out.select(COLUMNS)

    def pruned(self, v: Version, start: bytes | None = None, end: bytes | None = None, max_seq: int = LATEST) -> list[Segment]:
        """The segments that can hold something of [start, end) at or below max_seq."""
        low, high = (start or b"").hex(), None if end is None else end.hex()
        return [s for s in v.segments if s.min_seq <= max_seq and s.last_key >= low and (high is None or s.first_key < high)]

    def log(self, v: Version | None = None, start: bytes | None = None, end: bytes | None = None, max_seq: int = LATEST, without: int | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
        """The log that a read needs: unsealed rows and the segments that pass the manifest's bounds."""
        v = v or self.version()
        return self.unsealed(v).unionByName(self.rows_of([s for s in self.pruned(v, start, end, max_seq) if s.segment_id != without], kinds))

    def view(self, max_seq: int = LATEST, now: int = 0, start: bytes | None = None, end: bytes | None = None, v: Version | None = None, only: DataFrame | None = None) -> DataFrame:
        """(key, val, seq) visible at a snapshot and a tick."""
        v = v or self.version()
        some = "auto" if v.unsealed or any(s.rdel_count for s in self.pruned(v, start, end, max_seq)) else "none"
        bounds = v, start, end, max_seq, None
        return resolve(self.log(*bounds, ("points",)), max_seq, now, start, end, tombstones=some, only=only, range_log=self.log(*bounds, ("ranges",)))

    def get(self, key: bytes, max_seq: int = LATEST, now: int = 0) -> bytes | None:
        row = self.view(max_seq, now, key, key + b"\0").first()
        return None if row is None else bytes(row.val)

    def lookup(self, segment_id: int, keys: DataFrame, max_seq: int = LATEST) -> DataFrame:
        """What one segment alone says of keys: value, tombstone or missing; see scan.lookup."""
        s = self.version().segment(segment_id)
        if s is None:
            raise KeyError(segment_id)
        return scan.lookup(self.rows_of([s], ("points",)), keys, max_seq)

    def memtable(self) -> DataFrame:
        """The unsealed point versions, with their place in the run of their key."""
        return scan.memtable(self.unsealed())

    # snapshots

    def snapshot(self, name: str | None = None) -> tuple[str, int]:
        """Pins the current state against compaction; returns its name and sequence number."""
        v = self.version()
        if len(v.snapshots) >= self.most_snapshots:
            raise Conflict(f"{self.most_snapshots} snapshots are live")
        name = name or uuid.uuid4().hex
        self.commit(replace(v, snapshots={**v.snapshots, name: v.next_seq - 1}))
        return name, v.next_seq - 1

    def release(self, name: str) -> None:
        v = self.version()
        self.commit(replace(v, snapshots={k: s for k, s in v.snapshots.items() if k != name}))

    # maintenance

    def seal(self, rows: DataFrame, first_id: int, level: int, entries: int, node_id: int = 0, seal_wall: int = 0) -> list[Segment]:
        """Writes rows, of which there are so many entries, as sorted segments of about segment_rows each; their ids follow first_id.

        Every version of a key lies in one segment; a range delete is cut where
        segments are.  rows are read more than once, and should be a table.
        """
        path = f"segments/{first_id:010d}-{uuid.uuid4().hex}"
        outs = max(1, round(entries / self.segment_rows))
        bounds = even_bounds(rows, entries, outs)
        kind = F.when(F.col("op") == RANGE_DELETE, "ranges").otherwise("points")
        put = rows.withColumn("out", bin_of(F.col("key"), bounds))
        if bounds:
            last = F.when(F.col("op") == RANGE_DELETE, bin_of(F.col("val"), bounds, True)).otherwise(F.col("out"))
            edge = F.array(*[F.lit(b) for b in bounds])
            cut = put.withColumn("_low", F.col("out")).withColumn("out", F.explode(F.sequence("out", last)))
            ranged = F.col("op") == RANGE_DELETE
            put = cut.withColumns(
                {
                    "key": F.when(ranged & (F.col("out") > F.col("_low")), F.get(edge, F.col("out") - 1)).otherwise(F.col("key")),
                    "val": F.when(ranged, F.least("val", F.get(edge, F.col("out")))).otherwise(F.col("val")),
                }
            ).drop("_low")
        put = put.withColumns({"segment_id": (F.lit(first_id) + F.col("out")).cast("long"), "kind": kind})
        parts = max(min(outs, -(-entries // TASK_ROWS)), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        sorted_ = put.select(*COLUMNS, "out", "kind").repartitionByRange(parts, "out", "key").sortWithinPartitions("out", "kind", "key", F.desc("seq"))
        writer = sorted_.write.partitionBy("out", "kind").option("parquet.block.size", self.row_group)
        writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(min(100_000, self.segment_rows))).parquet(f"{self.root}/{path}")
        return self.describe(path, level, node_id, seal_wall, "out={}", first_id)

    def describe(self, path: str, level: int, node_id: int = 0, seal_wall: int = 0, below: str = "", first_id: int = 0) -> list[Segment]:
        """The manifest rows of the segments whose files are at a path, in folders named by `below` and their number from first_id."""
        rows = self.spark.read.schema(LOG).parquet(f"{self.root}/{path}")
        found = manifest.segment_stats(rows).orderBy("segment_id").collect()  # a row per segment
        folder = lambda i: f"{path}/{below.format(i - first_id)}" if below else path
        return [Segment(s.segment_id, level, folder(s.segment_id), bytes(s.first_key).hex(), bytes(s.last_key).hex(), s.min_seq, s.max_seq, s.entry_count, s.rdel_count, node_id, seal_wall) for s in found]

    def flush(self, node_id: int = 0, seal_wall: int = 0) -> Segment | None:
        """Seals the unsealed rows as level-0 segments, in one commit; returns the last of them."""
        v = self.version()
        made = self.seal(self.unsealed(v), v.next_segment, 0, v.unsealed_rows, node_id, seal_wall) if v.unsealed else []
        if not made:
            return None
        self.commit(replace(v, segments=(*v.segments, *made), flushed_seq=v.next_seq - 1, unsealed=(), unsealed_rows=0, next_segment=made[-1].segment_id + 1))
        return made[-1]

    def narrow(self, segment_id: int, bound: bytes) -> bool:
        """Raises a segment's live lower bound: what lies below it is dead to all readers; False if it is not raised."""
        v = self.version()
        s = v.segment(segment_id)
        if s is None:
            raise KeyError(segment_id)
        if bound.hex() > s.last_key:
            raise ValueError("the bound is above the segment's last key")
        if bound.hex() <= max(s.first_key, s.live_lower_bound):
            return False
        narrowed = replace(s, live_lower_bound=bound.hex(), first_key=bound.hex())
        self.commit(replace(v, segments=tuple(narrowed if x is s else x for x in v.segments)))
        return True

    # compaction: which segments, then how

    def small(self, s: Segment) -> bool:
        """Whether a segment is less than three quarters full, so that it is better merged than kept."""
        return 4 * s.entry_count < 3 * self.segment_rows

    def under_pressure(self, v: Version) -> bool:
        return len(v.segments) >= self.most_segments

    def wants(self, v: Version, level: int, pressure: bool = False) -> bool:
        """Whether a level is full or, under pressure, holds what can go down: two segments of level 0, one of a deeper level."""
        n = len(v.level(level))
        return n >= FULL or pressure and n >= (1 if level else 2)

    def jobs(self, v: Version) -> Iterator[Job]:
        """The jobs that may run: those of full levels, the deepest first, then those that pressure wants.

        Of level 0, all segments of a node, the node with most first; of a deeper
        level, one segment, that which overlaps fewest below first.
        """
        for pressure in [False, True] if self.under_pressure(v) else [False]:
            for level in reversed(range(self.levels - 1)):
                run = v.level(level)
                if not self.wants(v, level, pressure) or pressure and self.wants(v, level):
                    continue
                below = Line(v.level(level + 1))
                if level:
                    groups = [[s] for s in sorted(run, key=lambda s: (len(below.meeting(s.first_key, s.last_key)), s.segment_id))]
                else:
                    nodes = sorted({s.node_id for s in run}, key=lambda n: (-sum(s.node_id == n for s in run), n))
                    groups = [[s for s in run if s.node_id == n] for n in nodes]
                for sources in groups:
                    if (job := self.job(v, level, sources, below)) is not None:
                        yield job

    def job(self, v: Version, level: int, sources: list[Segment], below: Line | None = None) -> Job | None:
        """The job that takes sources of one node a level down; None if another node's segment there is in the way.

        It takes the segments below that they overlap, and a small one beside these
        at either end.  A segment that overlaps nothing and is not small moves.
        below: the segments of the next level, if they are in order already.
        """
        node = sources[0].node_id
        low, high = min(s.first_key for s in sources), max(s.last_key for s in sources)
        below = below or Line(v.level(level + 1))
        run = below.meeting(low, high)
        if any(s.node_id != node for s in run):
            return None
        if level and len(sources) == 1 and not run and not self.small(sources[0]):
            return Job(level, tuple(sources), (), move=True)
        beside = [s for s in below.beside(low, high) if s.node_id == node and self.small(s)]
        return Job(level, tuple(sources), (*run, *beside))

    def pending(self) -> bool:
        return next(self.jobs(self.version()), None) is not None

    def moving(self, v: Version, level: int) -> set[Segment]:
        """The segments of a level that may move down together: those of the first jobs, up to one that is no move, until the level is no longer full."""
        most = len(v.level(level)) - (1 if self.under_pressure(v) else FULL) + 1
        out: set[Segment] = set()
        spans: list[tuple[str, str]] = []  # of those, in order
        for job in self.jobs(v):
            if not job.move or job.level != level or len(out) == most:
                break
            s = job.sources[0]
            i = bisect_left(spans, (s.first_key, s.last_key))
            if not any(s.overlaps(*span) for span in spans[max(0, i - 1) : i + 1]):  # else it would not move after the other
                spans.insert(i, (s.first_key, s.last_key))
                out.add(s)
        return out

    def moved(self, v: Version) -> Version:
        """A version after all moves that come before the next rewrite, down as many levels as they go."""
        while (job := next(self.jobs(v), None)) is not None and job.move:
            down = self.moving(v, job.level)
            v = replace(v, segments=tuple(replace(s, level=s.level + 1) if s in down else s for s in v.segments))
        return v

    def compact_step(self, purge_before: int = 0) -> bool:
        """One bounded compaction, if there is a job, and one commit: all moves that come before a rewrite, or one rewrite of the segments that meet."""
        v = self.version()
        job = next(self.jobs(v), None)
        if job is None:
            return False
        if job.move and not purge_before:
            pairs = [(a, b) for a, b in zip(v.segments, self.moved(v).segments, strict=True) if a != b]
            self.swap(v, tuple(a for a, _ in pairs), tuple(b for _, b in pairs), v.next_segment)
        else:
            self.rewrite(v, [*job.sources, *job.targets], job.level + 1, purge_before)
        return True

    def compact_all(self, purge_before: int = 0) -> None:
        """Every level down to one run per node, at the deepest level that there is, or below where another node's run is in the way."""
        self.flush()
        deepest = max([1, *(s.level for s in self.version().segments)])
        for node in sorted({s.node_id for s in self.version().segments}):
            v = self.version()
            own = [s for s in v.segments if s.node_id == node]
            low, high = min(s.first_key for s in own), max(s.last_key for s in own)
            level = deepest
            while any(s.node_id != node and s.overlaps(low, high) for s in v.level(level)):
                level += 1
            self.rewrite(v, own, level, purge_before)

    def rewrite(self, v: Version, inputs: list[Segment], level: int, purge_before: int = 0) -> list[Segment]:
        """Merges segments of one node through the retention rules into segments at a level.

        What survives is a table first, so that it is counted: segments are sized by
        the rows that they get, not by those that were merged.
        """
        node = inputs[0].node_id
        low, high = min(s.first_key for s in inputs), max(s.last_key for s in inputs)
        taken = set(inputs)
        outside = [s for s in v.segments if s not in taken]
        rows, ranges = (self.rows_of(inputs, (kind,)) for kind in KINDS)
        rivals = manifest.frame(self.spark, replace(v, segments=tuple(s for s in outside if s.overlaps(low, high))))
        wall = max(s.seal_wall for s in inputs)
        kept = compact(rows, sorted(v.snapshots.values()), purge_before, not v.unsealed, rivals, node, wall, ranges)
        path = new_path(self.spark, "kept")
        try:
            kept.write.parquet(path)
            table = self.spark.read.schema(LOG).parquet(path)
            made = self.seal(table, v.next_segment, level, table.count(), node, wall)
        finally:
            drop(self.spark, [path])
        self.swap(v, tuple(inputs), tuple(made), max([v.next_segment, *(s.segment_id + 1 for s in made)]))
        return made

    def vacuum(self, versions: int = 10) -> int:
        """Deletes files that the latest version does not name, and all but the last few versions; only when nobody reads an older one."""
        v = self.version()
        named = {"/".join(s.path.split("/")[:2]) for s in v.segments} | set(v.unsealed)
        gone = 0
        for folder in ("log", "segments"):
            for name in self.files.names(folder):
                if f"{folder}/{name}" not in named:
                    gone += self.files.delete(f"{folder}/{name}")
        for name in self.files.names(manifest.MANIFEST):
            if name.endswith(".tmp") or name < f"{v.number - versions + 1:010d}":
                gone += self.files.delete(f"{manifest.MANIFEST}/{name}")
        return gone

    # statistics

    def stats(self) -> DataFrame:
        """(level, segments, entries, range deletes, min_seq, max_seq) of each level."""
        return manifest.level_stats(manifest.frame(self.spark, self.version()))

    def summary(self, boots: bytes | None = b"\xffboot") -> DataFrame:
        """One row about the store: what an opening replays, the highest seq, the recorder's boot count and oldest and newest tick, what segments there are.

        Ticks are those of keys of ten bytes that begin with zero, as the
        recorder's do; boots is the key of its counter of eight little-endian bytes.
        """
        v = self.version()
        ticks = recorder.tick_bounds(self.view(start=b"\0", end=b"\1", v=v).where(F.octet_length("key") == 10).select(tick_of(F.col("key")).alias("tick")))
        counter = self.get(boots) if boots else None
        levels = [len(v.level(n)) for n in range(self.levels)]
        return ticks.select(
            F.lit(v.unsealed_rows).cast("long").alias("replayed"),
            F.lit(v.next_seq - 1).cast("long").alias("max_seq"),
            F.lit(None if counter is None else int.from_bytes(counter, "little")).cast("long").alias("boots"),
            "oldest",
            "newest",
            F.lit(len(v.segments)).alias("segments"),
            F.lit(sum(s.entry_count for s in v.segments)).cast("long").alias("entries"),
            F.array(*[F.lit(n) for n in levels]).alias("levels"),
        )

    def segments(self, level: int | None = None) -> DataFrame:
        rows = manifest.frame(self.spark, self.version())
        return rows if level is None else rows.where(F.col("level") == level)

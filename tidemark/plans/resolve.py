"""The resolved view: the mutation log as the table of a snapshot and a clock value.

Visibility is decided per key, so bounds on keys and on the snapshot are filters
on the log, below the aggregation, and reach the Parquet scan.  Deletions and
expiry are looked at after the newest version of a key is known: an older version
never shows through.  Every function takes keys of any ordered type; binary and
string keys compare by bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tombstones import newest_cover, with_cover
from ..schema import DELETE, LATEST, RANGE_DELETE


def _key_bounds(start, end) -> Column:
    where = F.lit(True)
    if start is not None:
        where = where & (F.col("key") >= F.lit(start))
    if end is not None:
        where = where & (F.col("key") < F.lit(end))
    return where


def read(log: DataFrame, max_seq: int = LATEST, start=None, end=None, without_segment: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Point versions of the keys in [start, end) and the range tombstones that meet it, both up to a snapshot."""
    rows = log.where((F.col("seq") > 0) & (F.lit(True) if max_seq == LATEST else F.col("seq") <= max_seq))
    if without_segment is not None:
        rows = rows.where(F.col("segment_id").isNull() | (F.col("segment_id") != without_segment))
    points = rows.where((F.col("op") != RANGE_DELETE) & _key_bounds(start, end))
    ranges = rows.where((F.col("op") == RANGE_DELETE) & (F.col("key") < F.col("val")))
    if end is not None:
        ranges = ranges.where(F.col("key") < F.lit(end))
    if start is not None:
        ranges = ranges.where(F.col("val") > F.lit(start))
    return points, ranges.withColumnsRenamed({"key": "start", "val": "end"})


def newest(points: DataFrame) -> DataFrame:
    """The newest version of every key: key, op, val, expire_at, seq.  One shuffle, combined before it."""
    best = F.max_by(F.struct("op", "val", "expire_at", "seq"), "seq").alias("v")
    return points.groupBy("key").agg(best).select("key", "v.op", "v.val", "v.expire_at", "v.seq")


def live(now: int) -> Column:
    """Whether a winner has not expired; tick 0 switches expiry off."""
    return F.lit(True) if not now else (F.col("expire_at") == 0) | (F.col("expire_at") > now)


def resolve(log: DataFrame, max_seq: int = LATEST, now: int = 0, start=None, end=None, without_segment: int | None = None, tombstones: str = "auto", only: DataFrame | None = None, range_log: DataFrame | None = None) -> DataFrame:
    """(key, val, seq) visible at a snapshot and a tick, for keys in [start, end).

    log: seq, op, key, val, expire_at and, for without_segment, segment_id.
    tombstones: how the newest covering tombstone is found, see with_cover, or
    ``none`` if the log holds no range deletes.  only: a table of the keys (key)
    that are wanted, which narrows the log before the aggregation.  range_log:
    where the range deletes are, if not in log.  A point version and a tombstone
    of equal seq, which only ingested histories have, leave the point visible.

    The log is read for the points once, when the view runs, and for its range
    deletes once, now: a scan that its filter on op is pushed into.
    """
    points, ranges = read(log, max_seq, start, end, without_segment)
    if range_log is not None:
        ranges = read(range_log, max_seq, start, end, without_segment)[1]
    if only is not None:
        points = points.join(only.select("key"), "key", "left_semi")
    shown = newest(points).where(F.col("op") != DELETE)
    if tombstones != "none":
        shown = with_cover(shown, ranges, tombstones, keys=points).where(F.col("cover").isNull() | (F.col("cover") <= F.col("seq")))
    return shown.where(live(now)).select("key", "val", "seq")


def resolve_merged(log: DataFrame, now: int = 0, tombstones: str = "auto") -> DataFrame:
    """(key, val, node_id, seal_wall, seq) of a log written by several nodes, last writer wins.

    Per key and node the newest version counts, a covering range tombstone being
    one; across nodes that with the highest (seal_wall, node_id).  Two
    aggregations, independent of order, so a cycle of the pairwise rule cannot
    arise.  Rows of unsealed writes carry the largest seal_wall.
    """
    points, ranges = read(log)
    version = F.struct("seq", F.lit(1).alias("point"), "seal_wall", "op", "expire_at", "val")
    own = points.groupBy("key", "node_id").agg(F.max_by(version, F.struct("seq", F.lit(1))).alias("v"))
    cover = newest_cover(points.select("key").distinct(), ranges, tombstones, by=["node_id"], carry=["seal_wall"])
    hidden = cover.select("key", "node_id", F.struct(F.col("cover").alias("seq"), F.lit(0).alias("point"), F.col("seal_wall"), F.lit(DELETE).alias("op"), F.lit(0).cast("long").alias("expire_at"), F.lit(None).cast(log.schema["val"].dataType).alias("val")).alias("v"))
    both = own.union(hidden).groupBy("key", "node_id").agg(F.max_by("v", F.struct("v.seq", "v.point")).alias("v"))
    best = both.groupBy("key").agg(F.max_by(F.struct("node_id", "v"), F.struct("v.seal_wall", "node_id")).alias("b"))
    out = best.select("key", "b.v.val", "b.node_id", "b.v.seal_wall", "b.v.seq", "b.v.op", "b.v.expire_at")
    return out.where((F.col("op") != DELETE) & live(now)).drop("op", "expire_at")

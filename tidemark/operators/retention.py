"""What compaction may forget: the keep-set, expiry, and the dropping of hidden versions and tombstones.

For the latest view and every live snapshot, and for every tick from purge_before
on, the view before and after is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE, LATEST, RANGE_DELETE
from .tombstones import coalesce, newest_at, unshadowed, with_cover


def keep_set(points: DataFrame, snapshots: list[int]) -> DataFrame:
    """Versions that the latest view or a snapshot reads."""
    return newest_at(points, ["key"], snapshots)


def purge(points: DataFrame, purge_before: int) -> DataFrame:
    """Expired values become deletions of the same seq; none is dropped, so nothing older shows through."""
    gone = (F.col("expire_at") != 0) & (F.col("expire_at") <= purge_before) if purge_before else F.lit(False)
    return points.withColumns(
        {
            "op": F.when(gone, DELETE).otherwise(F.col("op")),
            "val": F.when(~gone, F.col("val")),
            "expire_at": F.when(gone, F.lit(0).cast("long")).otherwise(F.col("expire_at")),
        }
    )


def outside_minima(outside: DataFrame, node_id: int) -> DataFrame:
    """One row (same, foreign): the least seq of the node's segments outside, and the least (seal_wall, node_id) of those of other nodes."""
    same = F.min(F.when(F.col("node_id") == node_id, F.col("min_seq")))
    foreign = F.min(F.when(F.col("node_id") != node_id, F.struct("seal_wall", "node_id")))
    return outside.agg(same.alias("same"), foreign.alias("foreign"))


def outside_clear(outside: DataFrame | None, node_id: int = 0, wall: int = 0):
    """A predicate on seq: no segment outside holds an older version.

    outside: the manifest rows (node_id, seal_wall, min_seq) of the segments that
    are not rewritten; a few rows, summed up as two minima.
    """
    if outside is None:
        return F.lit(True)
    r = outside_minima(outside, node_id).first()
    below = F.lit(True) if r.same is None else F.col("seq") < r.same
    return below if r.foreign is None or (wall, node_id) < tuple(r.foreign) else F.lit(False)


def compact(log: DataFrame, snapshots: list[int], purge_before: int = 0, bottommost: bool = True, outside: DataFrame | None = None, node_id: int = 0, wall: int = 0, range_log: DataFrame | None = None) -> DataFrame:
    """The log rows that must survive, values expired before purge_before as deletions.

    log: seq, op, key, val, expire_at and any other columns.  bottommost: nothing
    older than these rows is below them.  outside: see outside_clear.  range_log:
    where the range deletes are, if not in log.
    """
    floor = min([LATEST, *snapshots])
    clear = outside_clear(outside, node_id, wall)
    points = purge(log.where((F.col("op") != RANGE_DELETE) & (F.col("seq") > 0)), purge_before)
    ranges = (log if range_log is None else range_log).where((F.col("op") == RANGE_DELETE) & (F.col("seq") > 0) & (F.col("key") < F.col("val")))
    spans = ranges.select(F.col("key").alias("start"), F.col("val").alias("end"), "seq")
    kept = keep_set(points, snapshots)
    # a version that the oldest reader already sees covered is hidden from all
    kept = with_cover(kept, spans.where(F.col("seq") <= floor), keys=points).where(F.col("cover").isNull() | (F.col("cover") <= F.col("seq"))).drop("cover")
    if bottommost:
        # of a key, as many versions are left as there are snapshots, and one
        newest = kept.selectExpr("*", "max(seq) over (partition by key) as newest")
        kept = newest.where(~((F.col("op") == DELETE) & (F.col("seq") == F.col("newest")) & (F.col("seq") < floor) & clear)).drop("newest")
        ranges = ranges.where(~((F.col("seq") < floor) & clear))
    served = unshadowed(ranges.withColumnsRenamed({"key": "start", "val": "end"}), snapshots).withColumnsRenamed({"start": "key", "end": "val"})
    return kept.select(log.columns).unionByName(served.select(log.columns))


def tidy_ranges(log: DataFrame) -> DataFrame:
    """Range tombstones of the log with those of one seq coalesced."""
    return coalesce(log.where(F.col("op") == RANGE_DELETE).select(F.col("key").alias("start"), F.col("val").alias("end"), "seq"))

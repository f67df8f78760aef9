"""Ordered reads of a resolved view: points, ranges, prefixes, pages, both directions.

A view is a DataFrame with a unique column ``key``; bounds are plain filters, so
on a view that is a stored table they are pushed into its scan.  For a view
straight from the log, give the bounds to resolve() instead or as well.  Nothing
is sorted unless an order is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import prefix_end
from ..plans.resolve import newest, resolve
from ..schema import DELETE, LATEST, RANGE_DELETE, InvalidMutation
from .bins import in_ranges


def get(log: DataFrame, key, max_seq: int = LATEST, now: int = 0) -> DataFrame:
    """The visible value of one key: one row or none.  The key is a filter on the log."""
    if not key:
        raise InvalidMutation("empty key")
    after = key + ("\0" if isinstance(key, str) else b"\0")
    return resolve(log, max_seq, now, key, after)


def multi_get(keys: DataFrame, log: DataFrame, max_seq: int = LATEST, now: int = 0, tombstones: str = "auto") -> DataFrame:
    """Every row of keys (key) with its value and found, true for keys that are visible; an empty value is found.

    The keys narrow the log before its aggregation.
    """
    return look_up(keys, resolve(log, max_seq, now, tombstones=tombstones, only=keys))


def look_up(keys: DataFrame, view: DataFrame) -> DataFrame:
    """multi_get on a view."""
    return keys.join(view.withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def lookup(segment: DataFrame, keys: DataFrame, max_seq: int = LATEST) -> DataFrame:
    """What one segment, or any part of a log, alone says of each of keys (key): (key, found, op, seq, val), found being value, tombstone or missing.

    Range tombstones and expiry are left to the caller, as a segment knows only its own.
    """
    points = segment.where((F.col("op") != RANGE_DELETE) & (F.col("seq") > 0) & (F.col("seq") <= max_seq)).join(keys.select("key"), "key", "left_semi")
    found = F.when(F.col("op").isNull(), "missing").when(F.col("op") == DELETE, "tombstone").otherwise("value")
    return keys.select("key").join(newest(points), "key", "left").select("key", found.alias("found"), "op", "seq", "val")


def memtable(unsealed: DataFrame) -> DataFrame:
    """Point versions of the unsealed log with their place in the run of their key, newest first; order by (key, place) to iterate."""
    return version_ranks(unsealed).withColumnRenamed("version_rank", "place")


def scan(view: DataFrame, start=None, end=None) -> DataFrame:
    """Keys in [start, end).  No start begins at the first key; an empty end is an error; start >= end gives nothing."""
    if end is not None and not end:
        raise InvalidMutation("empty end key")
    if start:
        view = view.where(F.col("key") >= F.lit(start))
    return view if end is None else view.where(F.col("key") < F.lit(end))


def prefix_scan(view: DataFrame, prefix) -> DataFrame:
    """Keys that begin with a prefix, as a range."""
    return scan(view, prefix, prefix_end(prefix))


def reverse_scan(view: DataFrame, start=None, lower=None) -> DataFrame:
    """Keys at most start (inclusive; none or empty: the last key) and above lower (exclusive)."""
    if start:
        view = view.where(F.col("key") <= F.lit(start))
    return view.where(F.col("key") > F.lit(lower)) if lower else view


def ordered(view: DataFrame, reverse: bool = False) -> DataFrame:
    return view.orderBy(F.desc("key") if reverse else F.asc("key"))


def page(view: DataFrame, limit: int, after=None, reverse: bool = False) -> DataFrame:
    """The next rows after a key, in either direction: a bounded heap per partition, no full sort."""
    if after is not None:
        view = view.where(F.col("key") < F.lit(after) if reverse else F.col("key") > F.lit(after))
    return ordered(view, reverse).limit(limit)


def store_range(view: DataFrame, start=None, end=None, reverse: bool = False) -> DataFrame:
    """Keys in [start, end) in the order asked for; the bounds mean the same in both directions."""
    return ordered(scan(view, start, end), reverse)


def first(view: DataFrame) -> DataFrame:
    return page(view, 1)


def last(view: DataFrame) -> DataFrame:
    return page(view, 1, reverse=True)


def seek(view: DataFrame, key) -> DataFrame:
    """The first key at or above one."""
    return ordered(scan(view, key)).limit(1)


def iterate(view: DataFrame, start=None, end=None, reverse: bool = False):
    """Rows to the driver, a partition at a time."""
    return store_range(view, start, end, reverse).toLocalIterator()


def seek_many(probes: DataFrame, view: DataFrame) -> DataFrame:
    """(probe, key): for each of many probes (probe) the first key at or above it, null beyond the last.

    Probes and keys lie in key ranges and are passed once, downwards; the first
    key of a range stands in for those below it.
    """
    both = probes.select(F.col("probe").alias("at"), F.lit(None).cast(view.schema["key"].dataType).alias("key")).union(view.select("key", "key"))
    put = in_ranges(both, [F.col("at")], "seek")
    own = put.selectExpr("*", "min(key) over (partition by _part order by at desc) as own").where("key is null")
    heads = put.groupBy("_part").agg(F.min("key").alias("head"))
    following = heads.selectExpr("_part", "min(head) over (order by _part desc rows between unbounded preceding and 1 preceding) as following")  # a row per range
    return own.join(F.broadcast(following), "_part").select(F.col("at").alias("probe"), F.coalesce("own", "following").alias("key"))


def version_ranks(log: DataFrame) -> DataFrame:
    """Point versions with their rank in the run of their key, newest first.

    Versions lie in ranges of (key, seq), so a key of very many is ranked in
    several tasks; what ranges before hold of it is added.
    """
    order = [F.col("key"), F.col("seq").desc()]
    put = in_ranges(log.where("op <> 3 and seq > 0").select("key", "seq", "op"), order, "versions")
    counts = put.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("n"))
    edges = counts.groupBy("_part").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    edges = edges.select("_part", F.explode(F.array_distinct(F.array("a", "b"))).alias("key"))  # only the first and last key of a range go on elsewhere
    before = counts.join(F.broadcast(edges), ["_part", "key"]).selectExpr("_part", "key", "sum(n) over (partition by key order by _part) - n as before")
    own = put.selectExpr("*", "row_number() over (partition by _part, key order by seq desc) as place")
    ranked = own.join(F.broadcast(before), ["_part", "key"], "left")  # two rows per range at most
    return ranked.select("key", "seq", "op", (F.col("place") + F.coalesce("before", F.lit(0))).cast("int").alias("version_rank"))


def as_of(log: DataFrame, watermarks: list[int]) -> DataFrame:
    """(watermark, key, op, seq): the newest version of every key at or below each of a few watermarks, in one aggregation."""
    row = F.struct("op", "seq")
    picks = [F.struct(F.lit(int(w)).cast("long").alias("watermark"), F.max_by(row, F.when(F.col("seq") <= w, F.col("seq"))).alias("v")) for w in watermarks]
    found = log.where("op <> 3 and seq > 0").groupBy("key").agg(F.array(*picks).alias("_all"))
    return found.select("key", F.explode("_all").alias("_one")).where("_one.v is not null").select("_one.watermark", "key", "_one.v.op", "_one.v.seq")


def checksum(view: DataFrame) -> DataFrame:
    """(entries, bytes) of a view: how many entries it has, and the bytes of their keys and values."""
    return view.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("val")), F.lit(0)).cast("long").alias("bytes"))

"""Time-series reports over recorder data: readings, events and traces by tick.

records: tick, kind (``r`` reading, ``e`` event, ``t`` trace), id (sensor number),
and whatever a report needs besides.  Ticks are dealt by range or by hash; no
report orders all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import value_of
from ..functions.keys import temperature, unsigned

SENSORS = 4
ALL = (1 << SENSORS) - 1


def spine(spark, first: int, last: int) -> DataFrame:
    """Every tick from first to last."""
    return spark.range(first, last + 1).withColumnRenamed("id", "tick")


def coverage(records: DataFrame) -> DataFrame:
    """(tick, bits): bit i for a reading of sensor i, bit SENSORS for an event."""
    bit = F.when(F.col("kind") == "r", F.expr("shiftleft(1, cast(id as int))")).when(F.col("kind") == "e", F.lit(1 << SENSORS)).otherwise(F.lit(0))
    return records.groupBy("tick").agg(F.bit_or(bit).alias("bits"))


def frame_class(mask: Column) -> Column:
    """whole, none, split (a prefix or a suffix of the sensors) or torn."""
    m = mask.bitwiseAND(F.lit(ALL))
    prefix = m.bitwiseAND(m + 1) == 0
    suffix = m.bitwiseOR(m - 1) == ALL
    return F.when(m == ALL, "whole").when(m == 0, "none").when(prefix | suffix, "split").otherwise("torn")


def frames(records: DataFrame, now: int) -> DataFrame:
    """One row per tick: a column for each sensor, whether there is an event, a trace, and a trace live at now.

    records: also val and expire_at.
    """
    sensors = [F.max(F.when((F.col("kind") == "r") & (F.col("id") == i), F.col("val"))).alias(f"sensor{i}") for i in range(SENSORS)]
    is_trace = F.col("kind") == "t"
    alive = is_trace & ((F.col("expire_at") == 0) | (F.col("expire_at") > now) | F.lit(now == 0))
    any_ = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    return records.groupBy("tick").agg(*sensors, any_(F.col("kind") == "e", "event"), any_(is_trace, "trace"), any_(alive, "trace_live"))


def gaps(present: DataFrame) -> DataFrame:
    """(first_tick, last_tick) of each run of ticks without a row, between the first and the last that have one.

    present: (tick).  Only neighbouring ticks are compared, within blocks of ticks
    and at their edges, so no window spans the table.
    """
    ticks = present.select("tick").distinct().withColumn("block", F.expr("tick div 65536"))
    inner = ticks.selectExpr("tick", "lag(tick) over (partition by block order by tick) as before")
    edges = ticks.groupBy("block").agg(F.min("tick").alias("tick"), F.max("tick").alias("top"))
    outer = edges.selectExpr("tick", "lag(top) over (order by block) as before")  # one row per 65,536 ticks
    both = inner.where("before is not null").union(outer.where("before is not null"))
    return both.where("tick > before + 1").selectExpr("before + 1 as first_tick", "tick - 1 as last_tick")


def sensor_stats(records: DataFrame) -> DataFrame:
    """Count, least, largest and mean value of each sensor."""
    return records.where("kind = 'r'").groupBy("id").agg(F.count("val").alias("n"), F.min("val").alias("least"), F.max("val").alias("largest"), F.avg("val").alias("mean"))


def intact(key: Column, stored: Column) -> Column:
    """Whether a stored value is the one that belongs to its key."""
    return F.coalesce(stored.cast("binary") == value_of(key), F.lit(False))


def out_of_order(records: DataFrame, by: str = "segment_id", at: str = "pos") -> DataFrame:
    """(out_of_order): rows whose key is not above that of the row before, in the physical order of a segment (by, at)."""
    line = records.selectExpr("key", f"lag(key) over (partition by `{by}` order by `{at}`) as before")
    return line.agg(F.coalesce(F.sum(F.when(F.col("key") <= F.col("before"), 1).otherwise(0)), F.lit(0)).cast("long").alias("out_of_order"))


def integrity(records: DataFrame, sound: bool = True) -> DataFrame:
    """One row: entries, readings, events, traces, bad values, whole, split and torn frames, the readings in split frames, rows out of order, and sound.

    records: also key, stored (the value's bytes), and segment_id and pos, where a
    row lies.  A value is bad if it is not the one that belongs to its key.  sound:
    whether the store's invariants hold, see Store.check.
    """
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    marked = records.withColumn("intact", intact(F.col("key"), F.col("stored")))
    counts = marked.agg(F.count(F.lit(1)).alias("entries"), of("r").alias("readings"), of("e").alias("events"), of("t").alias("traces"), F.sum(F.when(F.col("intact"), 0).otherwise(1)).alias("bad_values"))
    kinds = coverage(records.where("kind = 'r'")).select(frame_class(F.col("bits")).alias("c"), F.bit_count(F.col("bits").bitwiseAND(F.lit(ALL))).alias("n"))
    sums = [F.sum(F.when(F.col("c") == c, 1).otherwise(0)).alias(c) for c in ("whole", "split", "torn")]
    frames_ = kinds.agg(*sums, F.coalesce(F.sum(F.when(F.col("c") == "split", F.col("n"))), F.lit(0)).cast("long").alias("split_readings"))
    return counts.crossJoin(frames_).crossJoin(out_of_order(records)).withColumn("sound", F.lit(sound))  # one row each


def reading(records: DataFrame, tick: int, sensor: int) -> DataFrame:
    """One reading: tick, id, its temperature, and whether its value is intact; records also have key and stored."""
    one = records.where((F.col("kind") == "r") & (F.col("tick") == tick) & (F.col("id") == sensor))
    return one.select("tick", "id", F.round(temperature(F.col("stored")), 2).alias("celsius"), intact(F.col("key"), F.col("stored")).alias("intact"))


def summary(records: DataFrame, segments: DataFrame, replayed: DataFrame, max_seq: int, boots: DataFrame) -> DataFrame:
    """One row about a database: what an opening replays, the highest seq, the boot count, the oldest and newest tick, segments and entries in all and in each level.

    segments: manifest rows; replayed: the unsealed log; boots: the rows (val) of
    the boot counter, one or none, of eight little-endian bytes.
    """
    held = segments.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("entry_count"), F.lit(0)).alias("entries"))
    levels = segments.groupBy("level").count().agg(F.array_sort(F.collect_list(F.struct("level", "count"))).alias("l"))  # a row per level
    levels = levels.select(F.expr("concat_ws(',', transform(l, x -> concat(x.level, ':', x.count)))").alias("levels"))
    boot = boots.agg(F.max(unsigned(F.col("val"))).cast("long").alias("boots"))
    tail = replayed.agg(F.count(F.lit(1)).alias("replayed")).withColumn("max_seq", F.lit(max_seq).cast("long"))
    return tail.crossJoin(boot).crossJoin(tick_bounds(records)).crossJoin(held).crossJoin(levels)  # one row each


def tick_bounds(records: DataFrame) -> DataFrame:
    return records.agg(F.min("tick").alias("oldest"), F.max("tick").alias("newest"))


def newest_frame(records: DataFrame) -> DataFrame:
    """The records of the newest tick that has a reading."""
    top = records.where("kind = 'r'").agg(F.max("tick").alias("tick"))
    return records.join(F.broadcast(top), "tick")  # one row


def latest_events(records: DataFrame, k: int = 3) -> DataFrame:
    return records.where("kind = 'e'").orderBy(F.desc("tick")).limit(k)


def trace_counts(records: DataFrame, now: int, ticks: int = 200) -> DataFrame:
    """(live, total) of the traces in the last ticks up to the newest."""
    top = records.agg(F.max("tick").alias("top"))
    some = records.join(F.broadcast(top)).where(f"kind = 't' and tick > top - {ticks}")  # one row
    alive = (F.col("expire_at") == 0) | (F.col("expire_at") > now)
    return some.agg(F.coalesce(F.sum(F.when(alive, 1).otherwise(0)), F.lit(0)).alias("live"), F.count(F.lit(1)).alias("total"))


#: Ticks of a block, in which windows and ticks meet.
BLOCK_TICKS = 1024


def losses(ticks: DataFrame, near: DataFrame, far: DataFrame, purged: DataFrame) -> DataFrame:
    """(tick, bits, state) of every tick of a spine, from the records near and far (archived): whole, purged or lost.

    purged: (first_tick, last_tick), windows in which readings were deleted, long
    or overlapping as they may be: a window becomes the ticks of the spine's span
    that it holds, block by block.
    """
    bits = coverage(near.select("tick", "kind", "id").union(far.select("tick", "kind", "id")))
    span = ticks.agg(F.min("tick").alias("a"), F.max("tick").alias("b"))  # one row
    held = purged.crossJoin(F.broadcast(span)).select(F.greatest("first_tick", "a").alias("a"), F.least("last_tick", "b").alias("b")).where("a <= b")
    blocks = held.select("a", "b", F.explode(F.expr(f"sequence(a div {BLOCK_TICKS}, b div {BLOCK_TICKS})")).alias("block"))
    inside = blocks.select(F.explode(F.expr(f"sequence(greatest(a, block * {BLOCK_TICKS}), least(b, block * {BLOCK_TICKS} + {BLOCK_TICKS - 1}))")).alias("tick"))
    gone = inside.distinct().withColumn("purged", F.lit(True))
    out = ticks.join(bits, "tick", "left").join(gone, "tick", "left")
    whole = F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(F.lit(ALL)) == ALL
    return out.select("tick", F.coalesce("bits", F.lit(0)).alias("bits"), F.when(whole, "whole").when(F.col("purged"), "purged").otherwise("lost").alias("state"))


def first_copies(records: DataFrame) -> DataFrame:
    """Records of overlapping archives, one for each key; copies are equal."""
    return records.dropDuplicates(["key"])

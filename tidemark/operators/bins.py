"""Key ranges: the way to work on keys in order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

#: Keys sampled for the bounds, per range.
SAMPLE_PER_BIN = 40
#: Keys sampled for bounds that cut evenly, per range: a range is then within a fifth of its share, but for one in hundreds.
SAMPLE_PER_CUT = 200
#: Values looked at in one step of a search.
FAN = 16


def search(array: Column, size: int, key: Column, strict: bool = False) -> Column:
    """How many values of an ascending array of `size` values are at or below a key, or below it: a search in steps of FAN."""
    steps = [1]
    while steps[0] * FAN <= size:
        steps.insert(0, steps[0] * FAN)
    below = lambda x: x < key if strict else x <= key
    places = F.array(*[F.lit(i) for i in range(1, FAN)])
    more = lambda at, step: F.size(F.filter(places, lambda i: below(F.get(array, at + i * step - 1))))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: at + step * more(at, step))


def sampled_bounds(keys: DataFrame, column: str = "key", bins: int | None = None) -> list:
    """Ascending bounds that cut the keys into about so many ranges, by default as many as there are shuffle partitions.

    One pass over the keys; SAMPLE_PER_BIN of them for each range come to the driver.
    """
    bins = bins or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if bins < 2:
        return []
    some = keys.select(column).where(F.col(column).isNotNull()).orderBy(F.rand(1)).limit(bins * SAMPLE_PER_BIN)
    found = sorted(bytes(x) if isinstance(x, bytearray) else x for (x,) in some.collect())
    return sorted({found[i * len(found) // bins] for i in range(1, bins)}) if found else []


def even_bounds(rows: DataFrame, count: int, bins: int, column: str = "key") -> list:
    """Ascending bounds that cut rows, so many of them, into about so many ranges of nearly equal numbers of rows.

    Each row is drawn with the same chance, so no task sees more than its own.
    """
    if bins < 2:
        return []
    share = bins * SAMPLE_PER_CUT / count
    keys = rows.select(column)
    found = sorted(bytes(x) if isinstance(x, bytearray) else x for (x,) in (keys if share >= 1 else keys.sample(share, 1)).collect())
    return sorted({found[i * len(found) // bins] for i in range(1, bins)}) if found else []


def bin_of(key: Column, bounds: list, strict: bool = False) -> Column:
    """How many bounds are at or below a key, or below it."""
    return search(F.array(*[F.lit(b) for b in bounds]), len(bounds), key, strict) if bounds else F.lit(0)


def in_ranges(rows: DataFrame, order: list[Column], name: str = "ranges") -> DataFrame:
    """rows with _part, the number of the range that each lies in: a table, so that whatever is asked of it finds the same ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)


def with_rank(view: DataFrame, name: str = "rank", reverse: bool = False, column: str = "key") -> DataFrame:
    """view with the place of each key in ascending or descending order, from 1.

    The view is computed once.  A window ranks the keys of one range; the sizes of
    the ranges before, one row per range, give where its ranks begin.
    """
    put = in_ranges(view, [F.col(column)])
    order = "desc" if reverse else "asc"
    counts = put.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.selectExpr("_part", f"sum(_n) over (order by _part {order}) - _n as _before")
    ranked = put.selectExpr("*", f"row_number() over (partition by _part order by `{column}` {order}) as _at")
    return ranked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")  # a row per range

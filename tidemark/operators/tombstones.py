"""Range tombstones: the newest that covers a key, and their coalescing, clipping and shadowing.

Ranges are cut into disjoint pieces, each with the newest range that covers it, so
that a key meets one piece.  Few ranges are cut on the driver and searched in a
sorted array; many are dealt to key ranges, cut there, and met by the keys in one
ordered pass.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bins import bin_of, sampled_bounds, search

#: Distinct ranges that may come to the driver and be broadcast as pieces; more are swept key range by key range.
FEW_RANGES = 5_000


def distinct_ranges(ranges: DataFrame, by: list[str], carry: list[str]) -> DataFrame:
    """Of identical ranges only the newest decides, once the snapshot has been applied."""
    out = ranges.groupBy(*by, "start", "end").agg(F.max_by(F.struct("seq", *carry), "seq").alias("t"))
    return out.select(*by, "start", "end", "t.seq", *[f"t.{c}" for c in carry])


def _plain(key) -> bytes | None:
    """A key as bytes, which compare as Spark compares it; None stays for a range without an end."""
    return key.encode() if isinstance(key, str) else key if key is None else bytes(key)


def pieces(starts: list, ends: list, seqs: list[int]) -> list[tuple[int, int, int]]:
    """Disjoint ascending pieces of ranges: (which range's start or end opens it, which closes it, the newest range that covers it).

    A place i below len(starts) is the start of range i, others the end of range i
    less len(starts); an end of None is beyond all keys.
    """
    n = len(starts)
    edge = [_plain(x) for x in [*starts, *ends]]
    order = sorted(range(2 * n), key=lambda i: (edge[i] is None, edge[i] or b""))
    out: list[tuple[int, int, int]] = []
    heap: list[tuple[int, int]] = []
    over = [False] * n
    opened, owner, i = 0, -1, 0
    while i < 2 * n:
        here = order[i]
        while i < 2 * n and edge[order[i]] == edge[here]:
            if order[i] < n:
                heapq.heappush(heap, (-seqs[order[i]], order[i]))
            else:
                over[order[i] - n] = True
            i += 1
        while heap and over[heap[0][1]]:
            heapq.heappop(heap)
        now = heap[0][1] if heap else -1
        if now != owner:
            if owner >= 0:
                out.append((opened, here, owner))
            opened, owner = here, now
    return out


def with_cover(rows: DataFrame, ranges: DataFrame, how: str = "auto", by: list[str] | None = None, carry: list[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """rows (key, ...) with cover, the largest seq of a range start <= key < end, null if there is none, and the columns of carry from that range.

    ranges: start, end, seq and the columns of by and carry.  With by, a row comes
    out for each of their values, if a range that might cover it has that value.
    how: ``few`` takes the distinct ranges to the driver, if there are at most
    FEW_RANGES; ``sweep`` deals rows and ranges to key ranges; ``auto`` is ``few``
    if it can be.  keys: other rows with keys like those of rows, to sample bounds
    from.
    """
    by, carry = by or [], carry or []
    some = distinct_ranges(ranges, by, carry)
    if how != "sweep":
        got = some.limit(FEW_RANGES + 1).collect()
        if len(got) <= FEW_RANGES:
            return _looked_up(rows, some, got, by, carry)
        if how == "few":
            raise ValueError(f"more than {FEW_RANGES} distinct ranges")
    return _swept(rows, some, by, carry, rows if keys is None else keys)


def newest_cover(keys: DataFrame, ranges: DataFrame, how: str = "auto", by: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """(key, *by, cover, *carry): the largest seq of a range that covers a key, for keys (key) that have one; see with_cover."""
    return with_cover(keys, ranges, how, by, carry).where("cover is not null").select("key", *(by or []), "cover", *(carry or []))


def _looked_up(rows: DataFrame, some: DataFrame, got: list, by: list[str], carry: list[str]) -> DataFrame:
    """Searches sorted arrays of pieces, one broadcast row for each value of by."""
    spark, kinds = rows.sparkSession, {f.name: f.dataType for f in some.schema}
    groups: dict[tuple, list] = {} if by else {(): []}
    for r in got:
        groups.setdefault(tuple(r[c] for c in by), []).append(r)
    table, most = [], 0
    for values, own in groups.items():
        cut = pieces([r["start"] for r in own], [r["end"] for r in own], [r["seq"] for r in own])
        edge = [*(r["start"] for r in own), *(r["end"] for r in own)]
        most = max(most, len(cut))
        table.append((*values, [edge[a] for a, _, _ in cut], [edge[b] for _, b, _ in cut], [(own[i]["seq"], *(own[i][c] for c in carry)) for _, _, i in cut]))
    held = T.StructType([T.StructField("cover", T.LongType()), *[some.schema[c] for c in carry]])
    fields = [*[some.schema[c] for c in by], *[T.StructField(c, T.ArrayType(kinds["start"])) for c in ("_starts", "_ends")], T.StructField("_held", T.ArrayType(held))]
    arrays = F.broadcast(spark.createDataFrame(table, T.StructType(fields)))  # 2 * FEW_RANGES pieces at most
    at = rows.crossJoin(arrays).withColumn("_at", search(F.col("_starts"), most, F.col("key")) - 1)
    met = F.when(F.col("key") < F.get("_ends", F.col("_at")), F.get("_held", F.col("_at")))
    out = at.withColumn("_met", met)
    return out.select(*rows.columns, *by, "_met.cover", *[f"_met.{c}" for c in carry])


def _nodes(first: Column, stop: Column, levels: int) -> Column:
    """The ranges [first, stop) of bins as at most two nodes of each level of a binary tree: structs (_level, _node)."""
    out = []
    for k in range(levels + 1):
        a = F.floor((first + ((1 << k) - 1)) / (1 << k)).cast("int")
        b = F.floor(stop / (1 << k)).cast("int")
        left = F.when((a < b) & (a % 2 == 1), F.struct(F.lit(k).alias("_level"), a.alias("_node")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(F.lit(k).alias("_level"), (b - 1).alias("_node")))
        out += [left, right]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _swept(rows: DataFrame, some: DataFrame, by: list[str], carry: list[str], keys: DataFrame) -> DataFrame:
    """Deals rows and ranges to key ranges with sampled bounds; in each, one ordered pass lets every row meet the piece it lies in."""
    bounds = sampled_bounds(keys)
    bins, levels = len(bounds) + 1, max(1, len(bounds).bit_length())
    kind = rows.schema["key"].dataType
    edges = some.withColumn("_low", bin_of(F.col("start"), bounds)).withColumn("_high", bin_of(F.col("end"), bounds, True))
    # the bins where a range begins and ends see it itself; those between are whole, and see the newest of all that span them
    ends = edges.select("*", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_bin")).select("_bin", *by, "start", "end", "seq", *carry)
    inner = edges.where("_high - _low > 1").select(*by, "seq", *carry, F.explode(_nodes(F.col("_low") + 1, F.col("_high"), levels)).alias("_n"))
    of_node = inner.groupBy("_n._level", "_n._node", *by).agg(F.max_by(F.struct("seq", *carry), "seq").alias("t"))
    above = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("_bin"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level"))
    above = above.withColumn("_node", F.expr("cast(shiftright(_bin, _level) as int)"))
    spans = above.join(of_node, ["_level", "_node"]).groupBy("_bin", *by).agg(F.max_by("t", "t.seq").alias("t"))
    lowest = F.lit("" if isinstance(kind, T.StringType) else b"").cast(kind)
    spans = spans.select("_bin", *by, lowest.alias("start"), F.lit(None).cast(kind).alias("end"), "t.seq", *[f"t.{c}" for c in carry])
    both = ends.union(spans)

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        start, end = list(group["start"]), [None if pd.isna(x) else x for x in group["end"]]
        found = pieces(start, end, group["seq"].tolist())
        edge = [*start, *end]
        out = group.iloc[[i for _, _, i in found]].copy()
        out["start"], out["end"] = [edge[a] for a, _, _ in found], [edge[b] for _, b, _ in found]
        return out

    cuts = both.groupBy("_bin", *by).applyInPandas(cut, both.schema)
    cuts = cuts.select("_bin", *by, "start", F.struct("end", F.col("seq").alias("cover"), *carry).alias("_piece"))
    dealt = rows.withColumn("_bin", bin_of(F.col("key"), bounds))
    if by:
        dealt = dealt.join(cuts.select("_bin", *by).distinct(), "_bin")
    piece = cuts.schema["_piece"].dataType
    held = dealt.select("_bin", *by, F.col("key").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(piece).alias("_piece"), F.struct(*rows.columns).alias("_row"))
    shown = cuts.select("_bin", *by, F.col("start").alias("_at"), F.lit(0).alias("_side"), "_piece", F.lit(None).cast(held.schema["_row"].dataType).alias("_row"))
    line = Window.partitionBy("_bin", *by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = held.union(shown).withColumn("_piece", F.last("_piece", ignorenulls=True).over(line)).where("_side = 1")
    inside = F.col("_piece.end").isNull() | (F.col("_at") < F.col("_piece.end"))
    met = met.withColumn("_met", F.when(F.col("_piece").isNotNull() & inside, F.col("_piece")))
    return met.select(*[F.col("_row")[c].alias(c) for c in rows.columns], *by, "_met.cover", *[f"_met.{c}" for c in carry])


def coalesce(ranges: DataFrame) -> DataFrame:
    """Ranges (start, end, seq) of one seq that overlap or touch, merged."""
    seen = "max(end) over (partition by seq order by start, end rows between unbounded preceding and 1 preceding)"
    marked = ranges.where("start < end").selectExpr("start", "end", "seq", f"if({seen} >= start, 0, 1) as new")
    islands = marked.selectExpr("*", "sum(new) over (partition by seq order by start, end rows unbounded preceding) as island")
    return islands.groupBy("seq", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("start", "end", "seq")


def clip(ranges: DataFrame, low=None, high=None) -> DataFrame:
    """Ranges cut to [low, high); what is left empty goes."""
    start = F.col("start") if low is None else F.greatest("start", F.lit(low))
    end = F.col("end") if high is None else F.least("end", F.lit(high))
    return ranges.withColumn("start", start).withColumn("end", end).where("start < end")


def newest_at(rows: DataFrame, by: list[str], snapshots: list[int]) -> DataFrame:
    """The rows that the latest view or a snapshot reads: of each group, the newest of all and the newest at or below each snapshot.

    An aggregation, combined before the shuffle, of as many rows for a group as
    there are snapshots, and one; so a group of very many versions is no problem.
    """
    row = F.struct(*rows.columns)
    picks = [F.max_by(row, F.when(F.col("seq") <= s, F.col("seq"))) for s in sorted({int(s) for s in snapshots})]
    kept = rows.groupBy(*by).agg(F.array(*picks, F.max_by(row, "seq")).alias("_kept"))
    new = lambda x, i: x.isNotNull() & F.coalesce(F.get("_kept", i - 1)["seq"] != x["seq"], F.lit(True))
    return kept.select(F.explode(F.filter("_kept", new)).alias("_row")).select("_row.*")


def unshadowed(ranges: DataFrame, snapshots: list[int]) -> DataFrame:
    """Ranges that the latest view or a snapshot reads: of identical ranges, an older one goes if no snapshot lies between."""
    return newest_at(ranges, ["start", "end"], snapshots)


__all__ = ["clip", "coalesce", "distinct_ranges", "newest_at", "newest_cover", "pieces", "unshadowed", "with_cover"]

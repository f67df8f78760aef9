"""What the operators share: the shared folder, Arrow helpers, numbering without gaps, connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import drop, drop_written, new_path, shared_folder, written, written_so_far
from .tokens import forget

#: Rows of a side that may be broadcast once they have been counted.
BROADCAST_ROWS = 100_000
#: Edges, about 16 bytes each, whose components one task finds.
FEW_EDGES = 200_000
#: Rows per bucket when rows are numbered without gaps.
BUCKET_ROWS = 20_000


#: Rows of an Arrow batch at most, which the JVM and a worker hold whole: texts are long.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def spread(df: DataFrame, least: int = 0) -> int:
    """How many partitions to deal rows to."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def trim() -> None:
    """Gives free memory of this worker back to the system: idle workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library that knows how
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokens: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, in a worker that keeps no more memory than it needs: before, tokenizers are forgotten unless f uses them; after, free memory is given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokens:
            forget()
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, tokens: bool = False) -> DataFrame:
    """mapInArrow with batches of at most a few MB: f gets slices, however long the texts are; see tidy.

    The plan may run at any time, so the session's Arrow batches are bounded from
    now on, to BATCH_ROWS rows; results do not depend on it.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(x for b in batches for x in slices(b))

    return df.mapInArrow(tidy(run, tokens), schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about as many bytes at most; a row is never cut."""
    n = batch.num_rows
    step = max(1, min(n, int(n * most / max(1, batch.nbytes))))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values of the first columns in a sorted stream; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[x] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts a side whose counted rows are few; a larger one is left to a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered(df: DataFrame, group: list[str], order: list[str], salt: Column, rows: int, name: str) -> DataFrame:
    """df with a column of numbers 0, 1, 2, ... in each group, however large a group is.

    Rows are dealt to buckets by salt.  A window numbers the rows of one bucket
    of one group, which are about BUCKET_ROWS at most, and the counts of the
    buckets before give where its numbers begin.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    by = ", ".join(f"`{c}`" for c in [*group, "_bucket"])
    put = df.withColumn("_bucket", F.pmod(F.xxhash64(salt), F.lit(buckets)).cast("int"))
    counts = put.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    own = ", ".join(f"`{c}`" for c in group)
    base = counts.select(*group, "_bucket", F.expr(f"sum(_n) over (partition by {own} order by _bucket) - _n").alias("_base"))
    ranked = put.withColumn("_at", F.expr(f"row_number() over (partition by {by} order by {', '.join(order)})") - 1)
    joined = ranked.join(base, [*group, "_bucket"])
    return joined.withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_bucket", "_base", "_at")


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column], rows: int, name: str) -> DataFrame:
    """df with, for each of sums, its total over the rows that come before in a total order; df has about `rows` rows.

    Rows are dealt to ranges of the order, about BUCKET_ROWS each, in a table; a
    window adds up inside a range, and one over ranges gives what lies before it.
    """
    parts = max(1, -(-rows // BUCKET_ROWS))
    put = written(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), name)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = put.groupBy("_range").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    base = base.select("_range", *[F.coalesce(F.sum(f"_{k}").over(across), F.lit(0)).alias(f"_{k}") for k in sums])  # a row per range
    within = put.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    return within.join(small_or_shuffled(base, parts), "_range").withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_range", *[f"_{k}" for k in sums])


def joined(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least place connected with each of n places by the links (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, a: str, b: str, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of undirected edges of longs: (node, component), the component named by its smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until a
    step changes nothing.  Every step is two aggregations over edges, each in a
    table of its own, so no component is ever in one task or on the driver.  At
    most `few` edges, counted, are joined by one task instead: the same result
    without so many steps.
    """
    spark = edges.sparkSession
    before = written_so_far()
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    if now.count() <= few:

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if columns:
                u, v = (np.concatenate(x) for x in zip(*columns, strict=True))
                nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)  # ascending, so the least place is the smallest node
                label = joined(len(nodes), at[: len(u)], at[len(u) :])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])

        return now.select("u", "v").coalesce(1).mapInArrow(tidy(inside), "node long, component long")
    state = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        # in tables, so that both sides of a join are shuffled for it and Spark can split a node of very many edges
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        # small star: every edge points down, from u to a smaller v
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = written(small, "edges")
        drop_written(spark, before, but_last=True)
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if got[:2] == state and got[0] == got[2]:
            break
        state = got[:2]
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


__all__ = ["BROADCAST_ROWS", "components", "drop", "drop_written", "groups", "joined", "map_arrow", "new_path", "numbered", "shared_folder", "slices", "small_or_shuffled", "spread", "sums_before", "tidy", "written", "written_so_far"]

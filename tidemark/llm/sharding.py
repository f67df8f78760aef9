"""Shards of nearly equal bytes by Karmarkar-Karp differencing; documents with equal texts stay together.

Differencing keeps partial partitions, each a tuple of sums, and combines again
and again the two of largest spread, oppositely ordered: the largest sum of one
with the smallest of the other.  Since partial partitions combine like single
items, tasks first difference the groups that they hold, block by block; the
blocks' tuples are differenced in the same way, FAN at a time, and so on up a
tree until one is left.  Down the tree, each block's parts get their shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import groups, map_arrow, numbered, small_or_shuffled, tidy, written

#: Groups that a task differences together, and blocks' tuples.
BLOCK, FAN = 50_000, 2_048


def difference(sums: np.ndarray) -> np.ndarray:
    """For each partial partition (a row of sums, one per part) the shard of each of its parts."""
    n, k = sums.shape
    labels = np.empty((n, k), np.int64)
    if not n:
        return labels
    order = np.argsort(-sums, axis=1, kind="stable")
    nodes = list(np.take_along_axis(sums, order, 1))
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(x[0] - x[-1]), i) for i, x in enumerate(nodes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        both = nodes[a] + nodes[b][::-1]
        turn = np.argsort(-both, kind="stable")
        nodes[a] = nodes[b] = None  # type: ignore[call-overload]
        both = both[turn]
        nodes.append(both - both[-1])
        made.append((a, b, turn))
        heapq.heapreplace(heap, (-int(both[0] - both[-1]), len(nodes) - 1))
    held = {len(nodes) - 1: np.arange(k)}
    for i in range(len(made) - 1, -1, -1):
        shard, (a, b, turn) = held.pop(n + i), made[i]
        to = np.empty(k, np.int64)
        to[turn] = shard
        held[a], held[b] = to, to[::-1]
    for i in range(n):
        labels[i, order[i]] = held[i]
    return labels


def difference_items(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item."""
    sums = np.zeros((len(sizes), shards), np.int64)
    sums[:, 0] = sizes
    return difference(sums)[:, 0]


def total(sums: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The sums of the shards that partial partitions make when their parts go to these labels."""
    out = np.zeros(sums.shape[1], np.int64)
    np.add.at(out, labels.ravel(), sums.ravel())
    return out


def _combined(nodes: DataFrame, fan: int) -> DataFrame:
    """(node, parent, labels, sums) of partial partitions (node, sums), differenced about `fan` at a time.

    labels are where a node's parts go in its parent; a parent has a row of its
    own, with its sums and without labels.
    """
    family = F.pmod(F.xxhash64("node"), F.lit(max(1, -(-nodes.count() // fan))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 1):
            node = g.column("node").to_numpy()
            sums = np.array(g.column("sums").to_pylist(), np.int64)
            labels = difference(sums)
            rows = [(int(x), int(node[0]), a, None) for x, a in zip(node, labels.tolist(), strict=True)]
            rows.append((int(node[0]), None, None, total(sums, labels).tolist()))
            columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["node", "parent", "labels", "sums"])

    # families are told apart by their number, whatever the partitions are
    dealt = nodes.select(family.alias("family"), "node", "sums").repartition("family").sortWithinPartitions("family", "node")
    return written(dealt.mapInArrow(tidy(run), "node long, parent long, labels array<int>, sums array<long>"), "shard-level")


def _shards_of(nodes: DataFrame, shards: int, fan: int) -> DataFrame:
    """(node, names): the shard of each part of each node, by differencing in a tree."""
    levels = []
    while True:
        level = _combined(nodes, fan)
        levels.append(level.where("parent is not null").select("node", "parent", "labels"))
        nodes = level.where("parent is null").select("node", "sums")
        left = nodes.count()
        if left <= 1:
            break
    names = nodes.select("node", F.sequence(F.lit(0), F.lit(shards - 1)).alias("names"))
    for level in reversed(levels):
        above = names.select(F.col("node").alias("parent"), "names")
        down = level.join(small_or_shuffled(above, left), "parent")
        names = written(down.select("node", F.expr("transform(labels, x -> element_at(names, x + 1))").alias("names")), "shard-names")
        left = names.count()
    return names


def shard(docs: DataFrame, shards: int = 16, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs (doc_id, text; others are ignored).

    Law `bytes`: sizes (UTF-8 bytes plus 1) are near equal.  A null text is an
    empty one.  Rows with equal doc_id are rows of their own.  A group larger than
    a shard's share gets a shard in which nothing else need be.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = written(rows, "shard-rows")
    texts = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_block, held = TaskContext.get().partitionId(), 0, []

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            got = difference_items(table.column("bytes").to_numpy(), shards)
            name = np.full(len(got), (part << 32) + n_block, np.int64)
            return pa.RecordBatch.from_arrays([table.column("digest").chunk(0), table.column("bytes").chunk(0), pa.array(name), pa.array(got.astype(np.int32))], ["digest", "bytes", "block", "label"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= block:
                yield close()
                held, n_block = [], n_block + 1
        if sum(x.num_rows for x in held):
            yield close()

    labelled = written(map_arrow(texts, label, "digest binary, bytes long, block long, label int"), "shard-groups")
    sums = labelled.groupBy("block", "label").agg(F.sum("bytes").alias("bytes"))
    parts = F.map_from_entries(F.collect_list(F.struct("label", "bytes")))  # one entry for each shard at most
    nodes = sums.groupBy(F.col("block").alias("node")).agg(parts.alias("m"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    nodes = written(nodes.select("node", F.transform(every, lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("sums")), "shard-blocks")
    names = _shards_of(nodes, shards, fan).withColumnRenamed("node", "block")
    of_group = labelled.join(small_or_shuffled(names, names.count()), "block").select("digest", F.expr("element_at(names, label + 1)").alias("shard"))
    of_group = written(of_group, "shard-of-group")
    # rows without a doc_id are dealt to the buckets of the numbering by chance, fixed in a table
    salt = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.rand(7))).alias("salt")
    placed = written(rows.join(of_group, "digest").select("doc_id", "size", "text_crc32", "shard", salt), "shard-placed")
    out = numbered(placed, ["shard"], ["doc_id", "size", "text_crc32"], F.col("salt"), placed.count(), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


__all__ = ["difference", "difference_items", "shard", "total"]

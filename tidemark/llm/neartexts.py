"""Near copies of texts: pairs whose sets of word shingles have a Jaccard similarity of at least 0.8.

Candidates come from two sides: SimHash fingerprints within two bits, by covering
masks and half-radius balls, and bands of min-wise hashes, of which a pair at 0.8
shares one with probability 0.9998 (48 bands of 8).  What candidates connect is gathered with its shingle sets and
compared exactly, so no link is below the threshold.  Sets that are equal are one
node; a group of very many is compared block by block in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import components, map_arrow, small_or_shuffled, tidy, written

WORDS, RADIUS, LEAST = 5, 2, 0.8
BANDS, ROWS = 48, 8
#: Sets, and shingles, that one block holds on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Buckets that may be broadcast to find their members: about 16 bytes each.
BROADCAST_BUCKETS = 300_000
_rng = np.random.default_rng(8)
_TIMES = _rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set's min-wise hashes; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 512):
        some = (hashes[i : i + 512] >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, (some[:, None] * _TIMES + _PLUS).min(0), out=low)
    keys = (low.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64)
    return (keys ^ keys >> np.uint64(31)).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, fp, bands) of every row: a digest of its text and of its set, its SimHash and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, keys = [], [], []
            for t in b.column(2).to_pylist():
                all_ = simhash.shingles(t, WORDS)
                own = np.unique(all_)
                node.append(xxhash.xxh64_intdigest(own.tobytes()))
                fp.append(simhash.majority(all_))
                keys.append(band_keys(own))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *longs, lists], ["doc_id", "digest", "node", "fp", "bands"])

    return map_arrow(_keyed(docs).select("doc_id", "digest", "text"), run, "doc_id long, digest long, node long, fp long, bands array<long>")


def digest(column: str) -> Column:
    """What tells the texts of one doc_id apart; that of a null text is not that of an empty one."""
    return F.when(F.col(column).isNotNull(), F.xxhash64(column))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("digest"), "text")


def _candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): links between nodes (node, fp, bands) that may be near copies."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"), "near-buckets")
    large = shared.where("n > 2").select("key", "a")
    members = keyed.join(F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large, "key")
    out = shared.where("n = 2").select("a", "b").union(members.where("node <> a").select("a", F.col("node").alias("b")))
    of_fp = written(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "near-fingerprints")
    many = of_fp.where("n > 1").select("fp", "least")
    same = nodes.select("fp", "node").join(small_or_shuffled(many, many.count()), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    bits = written(simhash.links(of_fp.select("fp"), RADIUS), "near-bits")
    for side in ("a", "b"):
        bits = bits.join(of_fp.select(F.col("fp").alias(side), F.col("least").alias(f"node_{side}")), side)
    return out.union(same).union(bits.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))).distinct()


def forest(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the sets connected by similarities of at least LEAST."""
    size = np.array([len(s) for s in sets], np.int64)
    todo, found = size > 0, []
    if not todo.any():
        return found
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    flags = np.zeros(ids.max() + 1, bool)
    for i in range(len(sets)):
        if not todo[i]:
            continue
        todo[i] = False
        ring = [i]
        while ring:  # breadth first: each set is compared once with those not yet reached
            j = ring.pop()
            rest = np.flatnonzero(todo & (size >= LEAST * size[j]) & (LEAST * size <= size[j]))
            if not len(rest):
                continue
            own = ids[starts[j] : starts[j] + size[j]]
            flags[own] = True
            ends = np.cumsum(size[rest])
            at = np.arange(ends[-1]) + np.repeat(starts[rest] - ends + size[rest], size[rest])
            both = np.add.reduceat(flags[ids[at]], ends - size[rest], dtype=np.int64)
            flags[own] = False
            # in whole numbers, so that 0.8 itself is near
            near = rest[10 * both >= round(10 * LEAST) * (size[rest] + size[j] - both)]
            todo[near] = False
            ring += near.tolist()
            found += [(int(nodes[i]), int(nodes[k])) for k in near]
    return found


def _links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links between nodes (node, doc_id, digest, fp, bands) that join exactly the near copies among the candidates."""
    joined = written(components(_candidates(nodes), "a", "b"), "near-candidates")
    n = joined.count()
    wanted = written(nodes.select("node", "doc_id", "digest").join(small_or_shuffled(joined, n), "node"), "near-wanted")
    wanted = small_or_shuffled(wanted.select("component", "node", F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest")), n)
    texts = _keyed(docs).join(wanted, F.col("digest").eqNullSafe(F.col("own_digest")) & F.col("doc_id").eqNullSafe(F.col("own_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(simhash.shingles(t, WORDS)) for t in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["component", "node", "size", "shingles"])

    sets = written(map_arrow(texts.select("component", "node", "text"), run, "component long, node long, size long, shingles binary"), "near-sets")
    counts = sets.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("m"))
    counts = written(counts.select("component", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("m") / BLOCK_SHINGLES, F.lit(1.0))).cast("int").alias("blocks")), "near-blocks")
    own = sets.join(small_or_shuffled(counts, n), "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # blocks of a component are compared two by two; one of its own if there are no others
    dealt = own.select("component", "node", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lists = dealt.groupBy("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("node", "shingles")).alias("all"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in b.column(0):
                some = x.values
                found += forest(some.field("node").to_numpy(), [np.frombuffer(s, "<u8") for s in some.field("shingles").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return lists.select("all").mapInArrow(tidy(inside), "a long, b long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, kept_id, kept_digest) of every row of docs (doc_id, text; other columns are ignored).

    digest is that of the text.  kept_id and kept_digest are those of the row
    that stands for the group: the smallest doc_id, a null one last, then the
    smallest digest.  Texts without words are one group.
    """
    rows = written(_rows(docs), "near-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    nodes = written(rows.groupBy("node").agg(least, F.min("fp").alias("fp"), F.first("bands").alias("bands")).select("node", "least.doc_id", "least.digest", "fp", "bands"), "near-nodes")
    joined = components(_links(docs, nodes), "a", "b")
    # in tables, so that both sides of a join are shuffled for it and Spark can split a group of very many rows
    of_node = nodes.select("node", "doc_id", "digest").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    of_node = written(of_node.select("node", "root", "doc_id", "digest"), "near-roots")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    kept = written(of_node.groupBy("root").agg(least).select("root", F.col("least.doc_id").alias("kept_id"), F.col("least.digest").alias("kept_digest")), "near-kept")
    named = written(of_node.select("node", "root").join(kept, "root").select("node", "kept_id", "kept_digest"), "near-named")
    return rows.select("node", "doc_id", "digest").join(named, "node").select("doc_id", "digest", "kept_id", "kept_digest")


__all__ = ["band_keys", "digest", "forest", "groups"]

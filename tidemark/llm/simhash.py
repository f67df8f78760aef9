"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets one of the 2^(r+1) - 1 nonzero binary vectors of r + 1
bits; for each such vector v a mask keeps the positions whose vector has an odd
inner product with v.  Of any r positions, some v is orthogonal to all their
vectors, so two fingerprints that differ in at most r bits agree under some mask
(Pagh 2016): candidates are complete, and an exact check of the distance follows.

Only distinct fingerprints meet.  A bucket of two is a pair; larger buckets are
compared inside one task as a block while they are small.  Beyond that, blocks of
a bucket are compared two by two in different tasks or, for radius 2, by
half-radius balls: fingerprints at distance 2 have a common neighbour at distance
1, and two of one neighbour's ball are at distance 2 at most, so each
neighbour's group is joined by a star of links.  Tasks return links that span
what is connected; no group is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, map_arrow, tidy, written

BITS, RADIUS, WORDS, SEED = 64, 2, 3, 42
#: Distinct fingerprints of a bucket that one task compares as a block.
BLOCK = 1024
#: Buckets of more than three, counted, that may be broadcast to find their members: about 20 bytes each.
BROADCAST_BUCKETS = 300_000


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks for 64 bits, as signed 64-bit integers."""
    n = (1 << radius + 1) - 1
    return [_signed(sum(1 << i for i in range(BITS) if bin((i % n + 1) & v).count("1") & 1)) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; none for a text without words."""
    found = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.array([digest(view[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingle hashes; 0 if there are none."""
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = hashes[i : i + (1 << 16)]
        count += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text; other columns are ignored); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (smaller root, member) that join the fingerprints of one bucket within the radius."""
    fps = np.sort(fps)
    u = fps.view(np.uint64)
    todo, links = np.ones(len(fps), bool), []
    for i in range(len(fps)):
        if not todo[i]:
            continue
        todo[i] = False
        ring = [i]
        while ring:  # breadth first: each fingerprint is compared once with those not yet reached
            j = ring.pop()
            rest = np.flatnonzero(todo)
            near = rest[np.bitwise_count(u[rest] ^ u[j]) <= radius]
            todo[near] = False
            ring += near.tolist()
            links += [(int(fps[i]), int(fps[k])) for k in near]
    return links


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join exactly the fingerprints connected by steps of at most radius bits.

    distinct: a table (fp) of distinct fingerprints.  For radius 2 the work grows
    with the fingerprints; for others, crowded buckets are compared block by
    block, which grows with the square of a bucket.
    """
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])
    keyed = distinct.select("fp", F.explode(tables).alias("k")).select("k.t", "k.key", "fp")
    sums = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("x"))
    buckets = written(sums.where("n > 1"), "simhash-buckets")
    # of three, the third is what the exclusive or leaves
    few = buckets.where("n <= 3").select("n", "a", "b", F.expr("x ^ a ^ b").alias("c"))
    near = lambda p, q: few.where(f"bit_count({p} ^ {q}) <= {radius}").select(F.col(p).alias("a"), F.col(q).alias("b"))
    pairs = near("a", "b")
    few = few.where("n = 3")
    pairs = pairs.union(near("a", "c")).union(near("c", "b"))
    large = buckets.where("n > 3").select("t", "key", "n")
    members = keyed.join(F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large, ["t", "key"])
    if radius == 2:  # crowds of any size by half-radius balls
        crowd = members.where(F.col("n") > block).select("fp").distinct()
        members = members.where(F.col("n") <= block)
    # a bucket is one block, or as many as its size takes, compared two by two
    count = F.ceil(F.col("n") / block).cast("int")
    own = members.select("t", "key", "fp", count.alias("blocks"), F.pmod(F.xxhash64("fp", "t"), count).cast("int").alias("own"))
    dealt = own.select("t", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.groupBy("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    lists = dealt.agg(F.collect_list("fp").alias("fps"))  # those of two blocks at most

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for fps in b.column(0) for x in _forest(fps.values.to_numpy(), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    small = lists.select("fps").mapInArrow(tidy(inside), "a long, b long")
    out = pairs.union(small)
    return (out.union(balls(crowd, radius)) if radius == 2 else out).distinct()


def balls(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a star of links in every half-radius ball that holds several of the distinct fingerprints."""
    if radius != 2:
        raise ValueError("half-radius balls are for radius 2")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    near = fps.select("fp", F.explode(flips).alias("flip")).select(F.expr("fp ^ flip").alias("centre"), "fp")
    low = near.groupBy("centre").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where("size(fps) > 1")  # 65 at most
    return low.select("a", F.explode("fps").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp) of every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts and texts of white space have fingerprint zero and are
    linked like any other.  component_id is the smallest doc_id that links
    reach.  Rows with a null doc_id count as documents but name no component.
    """
    fps = written(fingerprints(docs, words), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    joined = components(links(distinct.select("fp"), radius), "a", "b")
    of_fp = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    # in tables, so that both sides of a join are shuffled for it and Spark can split a component of very many texts
    of_fp = written(of_fp, "simhash-roots")
    roots = written(of_fp.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = written(of_fp.join(roots, "root").select("fp", "component_id"), "simhash-named")
    # hex of a signed long is that of its 64 bits
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


__all__ = ["balls", "fingerprint", "fingerprints", "links", "majority", "masks", "near_duplicates", "shingles"]

"""Embedding near-duplicates by collision-counting projections.

Equal vectors are one class, compared once and counted with their number.  Unit
vectors are projected on LINES random lines; the projections, in steps of a
window's half-width over 32, are a vector's sketch.  Each line is sorted, and a
window around every query's value, found in the sorted order, yields a set of
vectors that it meets there, as bits.  Adding the sets of all lines in bit-sliced
counters gives every pair's collision count at 64 pairs a word; pairs with at
least the count that a pair at the threshold reaches with probability
COUNT_RECALL are the candidates, and their cosines in double precision decide.

A window on one line holds nearly half of all vectors, so over a whole table the
windows would meet a share of all pairs that does not fall as it grows.  Vectors
are therefore dealt to cells of about CELL classes by the signs of some further
projections, in as many tables as give a pair at the threshold a common cell with
probability TABLE_RECALL; a table of at most about CELL classes is one cell.

Sketches alone are shuffled to the cells.  Rows that have a candidate there are
sent once more, with their vectors, and verified.  A pair belongs to the first
table whose cell it shares, so it counts once.  A crowded cell is cut into blocks
and its block pairs go to different tasks; tasks return a link count and one link
to the least member of its piece per vector, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components, groups, joined, map_arrow, spread, tidy, written

TABLE_RECALL, COUNT_RECALL = 0.995, 0.9995
#: Classes in a cell, projections counted, half-width of a window in units of the threshold's distance, and in steps of a sketch.
CELL, LINES, WIDTH, STEPS = 1024, 32, 2.0, 32
#: Classes of a crowded cell that are compared as one block.
BLOCK = 2048


def plan(n: int, threshold: float) -> dict[str, float]:
    """The numbers of tables and bits, the step of a sketch and the least count for n classes."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(0, round(math.log2(max(1, n) / CELL))))
    tables = max(1, math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - same**bits))) if bits else 1
    p = math.erf(WIDTH / math.sqrt(2))  # a pair at the threshold differs along a line by a normal of its distance
    tail, least = 0.0, LINES + 1
    while tail < COUNT_RECALL:
        least -= 1
        tail += math.comb(LINES, least) * p**least * (1 - p) ** (LINES - least)
    return {"bits": bits, "tables": tables, "step": WIDTH * math.sqrt(2 - 2 * threshold) / STEPS, "least": least}


def lines(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _units(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepare(vectors: DataFrame) -> DataFrame:
    """(vec_id, digest, vec): digest names equal vectors and is null for those that link with nothing."""
    kind = vectors.schema["embedding"].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    cast = "array<float>" if dtype == "<f4" else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, digests = [], []
            flat = b.column(1)
            for i in range(len(flat)):
                x = flat[i].values
                raw = None
                if x is not None and len(x) and not x.null_count:
                    v = x.to_numpy(zero_copy_only=False).astype(dtype) + 0.0  # -0.0 and 0.0 are equal
                    if np.isfinite(v).all() and 0 < np.linalg.norm(v.astype(np.float64)) < np.inf:
                        raw = v.tobytes()
                raws.append(raw)
                digests.append(raw and hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "digest", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(cast).alias("embedding"))
    return map_arrow(rows, run, "vec_id long, digest binary, vec binary").withColumn("digest", F.when(F.col("vec_id").isNotNull(), F.col("digest")))


def sketch(unit: np.ndarray, step: float, seed: int) -> np.ndarray:
    """The projections of unit vectors on all lines, in steps."""
    return np.clip(np.round(unit @ lines(unit.shape[1], LINES, seed + 1) / step), -32767, 32767).astype(np.int16)


def collisions(a: np.ndarray, b: np.ndarray, half: int, least: int) -> np.ndarray:
    """Whether each row of b lies in the windows around each row of a on at least so many lines (columns)."""
    words = -(-len(b) // 64)
    planes = np.zeros((a.shape[1].bit_length(), len(a), words), np.uint64)  # plane k has the bits of weight 2^k of all counts
    for j in range(a.shape[1]):
        order = np.argsort(b[:, j], kind="stable")
        line = b[order, j].astype(np.int32)
        before = np.zeros((len(b) + 1, words), np.uint64)  # row i: the set of the first i in the order
        before[np.arange(1, len(b) + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
        np.bitwise_or.accumulate(before, 0, out=before)
        own = a[:, j].astype(np.int32)
        met = before[np.searchsorted(line, own + half, "right")]
        met ^= before[np.searchsorted(line, own - half, "left")]
        for plane in planes[: (j + 1).bit_length()]:
            carry = plane & met
            plane ^= met
            met = carry
    above, equal = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for k in range(len(planes) - 1, -1, -1):
        if least >> k & 1:
            equal &= planes[k]
        else:
            above |= equal & planes[k]
            equal &= ~planes[k]
    above |= equal
    return np.unpackbits(above.view(np.uint8), axis=1, bitorder="little", count=len(b)).view(bool)


def _candidates(t: int, same: bool, a: dict, b: dict, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Candidates between rows of a and of b that share no cell of a table before t, a matrix for some rows of a at a time."""
    for i in range(0, len(a["line"]), BLOCK):
        s = slice(i, i + BLOCK)
        some = collisions(a["line"][s], b["line"], STEPS, least)
        if same:
            some &= np.arange(len(b["line"]))[None, :] > np.arange(i, i + len(some))[:, None]
        if t and some.any():
            x, y = np.nonzero(some)
            late = (a["keys"][x + i, :t] == b["keys"][y, :t]).any(1)
            some[x[late], y[late]] = False
        yield i, some


def _verified(t: int, same: bool, a: dict, b: dict, least: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the candidates whose cosine reaches the threshold."""
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, some in _candidates(t, same, a, b, least):
        rows, cols = np.flatnonzero(some.any(1)), np.flatnonzero(some.any(0))
        if not len(rows):
            continue
        cosine = a["unit"][rows + i] @ b["unit"][cols].T
        x, y = np.nonzero(some[np.ix_(rows, cols)] & (cosine >= threshold))
        out_a.append(rows[x] + i)
        out_b.append(cols[y])
    return np.concatenate(out_a), np.concatenate(out_b)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding; other columns are ignored).

    Vectors that are null, empty or zero, hold a null or a value that is not
    finite, or have no vec_id link with nothing; neither do vectors of different
    lengths.  A repeated vector is linked with its copies.
    """
    rows = written(prepare(vectors), "vectors")
    kind = vectors.schema["embedding"].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec"))
    classes = written(classes, "vectors-classes")
    p = plan(classes.count(), threshold)
    bits, tables, step, least = p["bits"], p["tables"], p["step"], p["least"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = b.column(1).to_pylist()
            keys = np.zeros((len(raws), tables), np.int32)
            drawn = np.zeros((len(raws), LINES), np.int16)
            for size in {len(r) for r in raws}:
                which = [i for i, r in enumerate(raws) if len(r) == size]
                unit = _units([raws[i] for i in which], dtype)
                drawn[which] = sketch(unit, step, seed)
                if bits:
                    sign = (unit @ lines(unit.shape[1], tables * bits, seed) > 0).reshape(len(which), tables, bits)
                    keys[which] = (sign << np.arange(bits)).sum(2)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(raws) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            dim = pa.array([len(r) for r in raws], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), dim, pa.array([x.tobytes() for x in drawn], pa.binary()), flat], ["rep", "dim", "sketch", "keys"])

    table = written(map_arrow(classes.select("rep", "vec"), keyed, "rep long, dim int, sketch binary, keys array<int>"), "vectors-sketches")
    cell = ["t", "key", "dim"]
    # of the keys, those of the tables before go along
    dealt = table.select(F.posexplode("keys").alias("t", "key"), "dim", "rep", "sketch", "keys").withColumn("keys", F.expr("slice(keys, 1, t)"))
    crowded = dealt.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    crowded = written(crowded.select(*cell, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vectors-crowded")
    own = F.pmod(F.xxhash64("rep", "t"), F.coalesce("blocks", F.lit(1))).cast("int")
    blocks = dealt.join(crowded, cell, "left").withColumn("own", own)
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    blocks = blocks.select(*cell, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "sketch", "keys")
    key = [*cell, "i", "j"]

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition(spread(vectors), *key).sortWithinPartitions(*key, "own", "rep")

    def sides(g: pa.Table, extra: Callable[[np.ndarray], dict] = lambda m: {}) -> tuple[int, bool, list[dict]]:
        t, i, j = (g.column(c)[0].as_py() for c in ("t", "i", "j"))
        line = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.int16).reshape(-1, LINES)
        keys = pa.concat_arrays([c.flatten() for c in g.column("keys").chunks]).to_numpy().reshape(len(line), -1)
        one = g.column("own").to_numpy() == i
        return t, i == j, [{"line": line[m], "keys": keys[m], "at": np.flatnonzero(m)} | extra(m) for m in ((one, one) if i == j else (one, ~one))]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, len(key)):
            if g.num_rows < 2:
                continue
            t, same, parts = sides(g)
            hit = np.zeros(g.num_rows, bool)
            for i, some in _candidates(t, same, *parts, least):
                hit[parts[0]["at"][i : i + len(some)][some.any(1)]] = True
                hit[parts[1]["at"][some.any(0)]] = True
            if hit.any():
                yield from g.filter(pa.array(hit)).select([*key, "own", "rep"]).to_batches()

    schema = "t int, key int, dim int, i int, j int, own int, rep long"
    survivors = written(in_blocks(blocks).mapInArrow(tidy(meet), schema), "vectors-candidates")
    full = classes.select("rep", "w", "vec").join(table.select("rep", "sketch", "keys"), "rep")
    sent = survivors.join(full, "rep").select(*key, "own", "rep", "w", "vec", "sketch", F.expr("slice(keys, 1, t)").alias("keys"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, len(key)):
            rep, w = g.column("rep").to_numpy(), g.column("w").to_numpy()
            unit = _units(g.column("vec").to_pylist(), dtype)
            t, same, parts = sides(g, lambda m, unit=unit: {"unit": unit[m]})
            x, y = _verified(t, same, *parts, least, threshold)
            x, y = parts[0]["at"][x], parts[1]["at"][y]
            if not len(x):
                continue
            n = np.bincount(x, w[y], len(rep)) + np.bincount(y, w[x], len(rep))
            least_rep = np.full(len(rep), np.iinfo(np.int64).max)
            label = joined(len(rep), x, y)
            np.minimum.at(least_rep, label, rep)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(n[some].astype(np.int64)), pa.array(least_rep[label[some]])], ["rep", "n", "root"])

    found = written(in_blocks(sent).mapInArrow(tidy(compare), "rep long, n long, root long"), "vectors-links")
    component = components(found.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep")
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.select("digest", "rep", "w").join(linked, "rep", "left").join(component, "rep", "left")
    named = written(named.select("digest", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vectors-named")
    out = rows.select("vec_id", "digest").join(named, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


__all__ = ["collisions", "lines", "near_duplicates", "plan", "prepare", "sketch"]

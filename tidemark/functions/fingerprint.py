"""Content fingerprints: a count and a digest that do not depend on order or layout.

An entry's hash is FNV-1a over its length-prefixed key and value, spread by the
SplitMix64 finalizer; a set's digest is the sum modulo 2^64.  The hash runs in
numpy over whole Arrow batches, byte place by byte place; sums are decimals, so
nothing overflows, and combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of FNV-1a 64, of the SplitMix64 finalizer, and of the one that the recorder's values use.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MIX_VALUE = 0xFF51AFD7ED558CCD


def _fold(state: np.ndarray, parts: list[bytes], sized: bool = True) -> np.ndarray:
    """FNV-1a of one byte string per row, after its length if sized, continuing from state.

    Longest first, so each step is one array operation; a step for each byte of
    the longest, which the log's limit on values bounds.
    """
    size = np.array([len(p) for p in parts], np.int64)
    prime = np.uint64(FNV_PRIME)
    for k in range(8 if sized else 0):
        state = (state ^ ((size >> 8 * k) & 255).astype(np.uint64)) * prime
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    first = (np.cumsum(size) - size)[order]
    left = np.sort(size)
    at = state[order]
    for i in range(int(size.max(initial=0))):
        n = len(size) - int(np.searchsorted(left, i, "right"))
        at[:n] = (at[:n] ^ flat[first[:n] + i]) * prime
    out = np.empty_like(at)
    out[order] = at
    return out


def hashes(keys: list[bytes], vals: list[bytes]) -> np.ndarray:
    """The hashes of entries as unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        h = np.full(len(keys), FNV_OFFSET, np.uint64)
        h = _fold(_fold(h, keys), vals)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_A)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_B)
        return h ^ (h >> np.uint64(31))


def _entry_hash(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for key, val in batches:
        yield pd.Series(hashes([bytes(k or b"") for k in key], [bytes(v or b"") for v in val]).view(np.int64))


def values_of(keys: list[bytes]) -> list[bytes]:
    """The eight bytes that the recorder stores under each key: a hash of the key, so that a checker needs no copy of the data."""
    with np.errstate(over="ignore"):
        h = _fold(np.full(len(keys), FNV_OFFSET, np.uint64), keys, sized=False)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX_VALUE)
        raw = (h ^ (h >> np.uint64(33))).astype("<u8").tobytes()
    return [raw[i : i + 8] for i in range(0, len(raw), 8)]


def _value_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for keys in batches:
        yield pd.Series(values_of([bytes(k or b"") for k in keys]), dtype=object)


def value_of(key: Column) -> Column:
    """The value that belongs to a recorder's key."""
    return F.pandas_udf(_value_of, T.BinaryType())(key.cast("binary"))


def entry_hash(key: Column, val: Column) -> Column:
    """The hash of an entry's key and value as an unsigned decimal; text counts as its UTF-8 bytes."""
    signed = F.pandas_udf(_entry_hash, T.LongType())(key.cast("binary"), val.cast("binary")).cast("decimal(20,0)")
    return F.when(signed < 0, signed + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(signed).cast("decimal(20,0)")


def _sum(column: str) -> Column:
    modulus = F.lit(str(1 << 64)).cast("decimal(38,0)")
    return F.pmod(F.coalesce(F.sum(column).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")), modulus).cast("decimal(20,0)")


def total(view: DataFrame) -> DataFrame:
    """(count, digest) of a view (key, val)."""
    return view.select(entry_hash(F.col("key"), F.col("val")).alias("h")).agg(F.count("h").alias("count"), _sum("h").alias("digest"))


def bucket_of(key: Column, splits: list) -> Column:
    """How many of the ascending splits are at or below a key."""
    if any(a >= b for a, b in zip(splits, splits[1:], strict=False)):
        raise ValueError("splits must ascend")
    return F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s <= key)) if splits else F.lit(0)


def buckets(view: DataFrame, splits: list) -> DataFrame:
    """(bucket, count, digest) for every bucket [split before, split); empty buckets too."""
    rows = view.select(bucket_of(F.col("key"), splits).alias("bucket"), entry_hash(F.col("key"), F.col("val")).alias("h"))
    sums = rows.groupBy("bucket").agg(F.count("h").alias("count"), _sum("h").alias("digest"))
    every = view.sparkSession.range(len(splits) + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(sums, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0).cast("long")).alias("count"), F.coalesce("digest", F.lit(0).cast("decimal(20,0)")).alias("digest"))


def merge(parts: DataFrame) -> DataFrame:
    """(count, digest) of the union of disjoint sets given as rows (count, digest)."""
    return parts.agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("count"), _sum("digest").alias("digest"))


def to_bytes(count: int, digest: int) -> bytes:
    """Sixteen bytes: count and digest, big-endian."""
    return count.to_bytes(8, "big") + digest.to_bytes(8, "big")


def from_bytes(raw: bytes) -> tuple[int, int]:
    if len(raw) != 16:
        raise ValueError("a fingerprint has 16 bytes")
    return int.from_bytes(raw[:8], "big"), int.from_bytes(raw[8:], "big")

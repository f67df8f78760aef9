"""Context-triggered piecewise hashing: fingerprints of texts that stay alike where the texts do.

A hash of the last seven bytes decides after every byte whether a chunk ends
there; at block exponent e it does so once in 2^e places on average, and the
places of e + 1 are among those of e.  A chunk becomes one letter of a signature,
12 bits of its checksum in two characters.  The exponent is the smallest, 2 at
least, that gives at most 64 letters; the fingerprint holds the signatures of e
and e + 1, ``e:signature:signature``.  Two fingerprints are compared at an
exponent that both hold, by the edit distance (insertions and deletions) of the
signatures; without one their likeness is 0.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, spread

WINDOW, LETTERS, LEAST = 7, 64, 2
_STEP = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTER = [a + b for a in _ALPHABET for b in _ALPHABET]


def _rolling(raw: bytes, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Places after which the rolling hash has `low` leading zero bits at least, and the hashes there."""
    places, values = [], []
    for at in range(0, len(raw), _STEP):
        part = raw[max(0, at - WINDOW) : at + _STEP]
        lead = min(at, WINDOW)
        buffer = bytes(8 - lead) + part
        n = len(part) - lead
        windows = np.ndarray((n,), "<u8", buffer, 1, (1,))
        mixed = (windows >> np.uint64(8)) * _MIX
        mixed = ((mixed ^ (mixed >> np.uint64(32))) * _MIX) >> np.uint64(32)
        found = np.flatnonzero(mixed < (1 << (32 - low)))
        places.append(found + at + 1)
        values.append(mixed[found])
    return np.concatenate(places), np.concatenate(values)


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text; that of an empty one is ``2::``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return f"{LEAST}::"
    low = max(LEAST, (len(raw) // LETTERS).bit_length() - 2)
    while True:
        places, values = _rolling(raw, low)
        if low == LEAST or len(places) >= LETTERS:
            break
        low = max(LEAST, low - 2)
    exponent = low
    while exponent < 32 and (values < (1 << (32 - exponent))).sum() >= LETTERS:
        exponent += 1
    return f"{exponent}:{_signature(raw, places[values < (1 << (32 - exponent))])}:{_signature(raw, places[values < (1 << (31 - exponent))] if exponent < 32 else places[:0])}"


def _signature(raw: bytes, places: np.ndarray) -> str:
    ends = places.tolist()
    if not ends or ends[-1] != len(raw):
        ends.append(len(raw))
    view, at, out = memoryview(raw), 0, []
    for end in ends:
        out.append(_LETTER[zlib.crc32(view[at:end]) & 0xFFF])
        at = end
    return "".join(out)


def _common(a: str, b: str) -> int:
    """The length, in letters, of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i in range(0, len(a), 2):
        where[a[i : i + 2]] = where.get(a[i : i + 2], 0) | 1 << (i >> 1)
    n = len(a) >> 1
    full = row = (1 << n) - 1
    for i in range(0, len(b), 2):
        hit = where.get(b[i : i + 2])
        if hit:
            some = row & hit
            row = (row + some | row - some) & full
    return n - row.bit_count()


def _alike(a: str, b: str) -> float:
    return 4 * _common(a, b) / (len(a) + len(b)) if a and b else float(a == b)


def likeness(one: str, other: str) -> float:
    """1 less the edit distance over the letters of both signatures, at the best common exponent; 0 without one."""
    if one == other:
        return 1.0
    e, a, b = one.split(":")
    f, c, d = other.split(":")
    step = int(f) - int(e)
    if step == 0:
        return max(_alike(a, c), _alike(b, d))
    return _alike(b, c) if step == 1 else _alike(a, d) if step == -1 else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half of code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


LEAST_ID = -(1 << 63)
#: Fingerprints that a task remembers, for texts of at most so many characters: copies come together.
MEMORY, MEMORY_CHARS = 512, 8192


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below key; two levels, so that the work per row is that of the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b < key))
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    if not bounds:
        return F.lit(0)
    first = F.greatest(below(long([p[0] for p in parts])) - 1, F.lit(0))
    return (first * step + below(F.element_at(F.array(*[long(p) for p in parts]), first + 1))).cast("int")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) as sorted partitions (bucket, guard, key, doc_id, text), each ended by the row that follows it.

    Each row goes to the bucket of its doc_id range; the first row of a bucket is
    also sent, as guard, to the bucket before, and that of the first bucket to the
    last.  Texts are shuffled once.  The driver sees bounds and a first key for
    each bucket, of which there are `parts`, whatever the rows are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(LEAST_ID)))
    probabilities = [i / parts for i in range(1, parts)]
    found = rows.select(F.col("key").cast("double").alias("key")).approxQuantile("key", probabilities, 0.1 / parts) if parts > 1 else []
    rows = rows.withColumn("bucket", _bucket(F.col("key"), sorted({int(x) for x in found})))
    firsts = sorted((r.bucket, r.key) for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).collect())  # one row per partition
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    spark = docs.sparkSession
    guards = spark.createDataFrame(sorted(before.items()), "key long, guard_of int")
    joined = rows.join(F.broadcast(guards), "key", "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guard"))
    guard = F.struct(F.col("guard_of").alias("bucket"), F.lit(True).alias("guard"))
    to = F.explode(F.when(F.col("guard_of").isNull(), F.array(own)).otherwise(F.array(own, guard)))
    dealt = joined.select(to.alias("to"), "key", "doc_id", "text").select("to.bucket", "to.guard", "key", "doc_id", "text")
    return dealt.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "guard", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text; other columns are ignored) and of its edited text.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The edited text's second half comes from the next row
    by doc_id, null first and equal ids by text; after the last comes the first.
    A null text is an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for the next one
        out: list[tuple] = []

        def close(following: str, following_print: str) -> None:
            doc_id, text, own = held
            changed = edited(text, following)
            changed_print = own if changed == text else fingerprint(changed)
            sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(text), sha, own, changed_print, likeness(own, changed_print), likeness(own, following_print)))

        short = functools.lru_cache(maxsize=MEMORY)(fingerprint)
        known = lambda text: short(text) if len(text) <= MEMORY_CHARS else fingerprint(text)
        for b in batches:
            for guard, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("guard", "doc_id", "text")), strict=True):
                if guard and held is None:  # later rows of the same id
                    continue
                own = known(text)
                if held is not None:
                    close(text, own)
                held = None if guard else (doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)
                out = []

    parts = spread(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(in_order(docs, parts).select("guard", "doc_id", "text"), run, schema)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

__all__ = ["edited", "fingerprint", "fingerprints", "in_order", "likeness"]

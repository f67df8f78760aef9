"""Mixing sources to target weights, with DataFrame functions only.

Word counts per source give targets: sources share a total by weight, none above
a multiple of its own size, the excess shared again by weight.  A source's
repetition rate is its target over its size.  A document is emitted floor(rate)
times, and once more with a probability of the fraction, decided by a hash of its
doc_id: a Bernoulli copy.  Its seed is one of DRAWS, evaluated in one aggregation,
of which each source uses that whose words come nearest to its target; so a
source's copies are the best of DRAWS such draws and not the first one.

Sources are ranked and their caps added up in ranges of the order, so that no
task sees all of them, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_or_shuffled, sums_before, written

WORD = r"[^\x20\x09-\x0D]+"
#: Draws per hash, and hashes.
EACH, HASHES = 4, 2
DRAWS = EACH * HASHES


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size), a table with one row per source.

    Sources by code point, null last, get the weights in turn.  With caps c and
    weights w, the targets least(c, level * w) share the total when the level is
    that of the first source, in order of c / w, which it leaves under its cap.
    """
    n = by_source.count()
    ranked = sums_before(by_source, [F.col("source").asc_nulls_last()], {"i": F.lit(1)}, n, "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    filled = sums_before(capped, [F.col("ratio"), F.col("i")], {"caps": F.col("cap"), "ws": F.col("w")}, n, "mix-levels")
    sizes, ws = capped.agg(F.sum("source_size"), F.sum("w")).first()
    if sizes is None:
        return by_source.select("source", "source_size", F.lit(0.0).alias("target"))
    levels = filled.withColumn("level", (F.lit(float(share)) * F.lit(sizes) - F.col("caps")) / (F.lit(ws) - F.col("ws")))
    level = levels.where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "i"))).first()[0]
    target = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("w"))
    return capped.select("source", "source_size", target.alias("target"))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Uniform numbers in [0, 1) of a document, 32 bits each."""
    out = []
    for h in range(HASHES):
        digest = F.md5(F.concat(F.lit(f"{seed}/{h}/"), F.coalesce(doc_id.cast("string"), F.lit(""))))
        out += [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) for k in range(EACH)]
    return out


def _copies(u: Column) -> Column:
    return F.col("whole") + (u < F.col("part")).cast("long")


def plan(docs: DataFrame, share: float, weights: tuple[int, ...], most: float, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """The sizes of docs, in a table (doc_id, source, size), the sources' plan, in one, and the number of sources."""
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")), "mix-sizes")
    by_source = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = targets(by_source, share, weights, most).withColumn("rate", rate)
    aims = aims.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))
    aims = written(aims, "mix-targets")
    n = aims.count()
    rows = sized.join(small_or_shuffled(aims, n), sized["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    sums = rows.groupBy("source").agg(*[F.sum(F.col("size") * _copies(u)).alias(f"s{k}") for k, u in enumerate(draws(F.col("doc_id"), seed))])
    both = aims.join(small_or_shuffled(sums.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s")), "left")
    errors = F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("e"), F.lit(k).alias("k")) for k in range(DRAWS)])
    chosen = both.select("source", "source_size", "target", "whole", "part", F.array_min(errors)["k"].alias("draw"))
    return sized, written(chosen, "mix-plan"), n


def _with_copies(rows: DataFrame, aims: DataFrame, n: int, seed: int) -> DataFrame:
    aims = small_or_shuffled(aims.withColumnRenamed("source", "_source"), n)
    joined = rows.join(aims, F.col("source").cast("string").eqNullSafe(F.col("_source")))
    u = F.element_at(F.array(*draws(F.col("doc_id"), seed)), (F.col("draw") + 1).cast("int"))
    return joined.withColumn("copies", _copies(u)).drop("_source", "whole", "part", "draw")


def shares(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0, seed: int = 6) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) of every row of docs (doc_id, source, text).

    A null text has size 0; null sources are one source, the last; rows with equal
    doc_id, or with none, share their fate; a very long text is counted whole.
    Sources without words have target 0.  An empty table gives one.  Reruns agree:
    copies follow from doc_id, seed and the sources' sizes alone.  A copy beyond
    the whole ones is a Bernoulli draw whose seed is chosen among DRAWS for its
    source, that the source come nearest to its target.
    """
    sized, aims, n = plan(docs, share, weights, most, seed)
    out = _with_copies(sized, aims, n, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0, seed: int = 6) -> DataFrame:
    """docs, with all their columns, each row as often as the mix takes it.

    Texts are read again and not shuffled while there are few sources.
    """
    _, aims, n = plan(docs, share, weights, most, seed)
    keys = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"))
    out = _with_copies(keys, aims, n, seed)
    return out.select("row", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select("row.*")


ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
 by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
 ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM by_source),
 capped AS (SELECT *, CASE i % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w, source_size * 2e0 AS cap FROM ranked),
 levels AS (SELECT *, (1.5e0 * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / w, i) - cap)) / (sum(w) OVER () - (sum(w) OVER (ORDER BY cap / w, i) - w)) AS level FROM capped),
 found AS (SELECT *, (SELECT level FROM levels WHERE level <= cap / w ORDER BY cap / w, i LIMIT 1) AS chosen FROM levels),
 aims AS (SELECT source, source_size, least(cap, coalesce(chosen * w, cap)) AS target FROM found),
 rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aims),
 drawn AS (SELECT s.doc_id, s.source, s.size, r.source_size, r.target, k.k, CAST(floor(r.rate) AS BIGINT) + CASE WHEN
   CAST(('0x' || substr(md5('6/' || (k.k // 4) || '/' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1 + 8 * CAST(k.k % 4 AS INTEGER), 8)) AS BIGINT) / 4294967296e0
   < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source CROSS JOIN range(8) AS k(k)),
 sums AS (SELECT source, k, abs(sum(size * copies) - any_value(target)) AS e FROM drawn GROUP BY source, k),
 best AS (SELECT source, k FROM sums QUALIFY row_number() OVER (PARTITION BY source ORDER BY e, k) = 1)
SELECT d.doc_id, d.size, d.source_size, d.target, d.size * d.copies AS taken, d.copies, d.source
FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.k = b.k
"""

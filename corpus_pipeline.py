"""The corpus pipeline: language ID, near-duplicates, mixing, packing; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, neartexts, packing
from tidemark.llm.shared import drop_written, small_or_shuffled, written, written_so_far
from tidemark.llm.tokens import vocabulary

#: How far a score must lie from chance towards certainty; 0.2 asks for 0.4 of four languages, 0.6 of two.
LEAST_SURE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the byte network finds a language; a null lang becomes the one found.

    Texts that are null, empty or without letters go, and those whose score is
    near chance.  Very long texts are read whole; rows that repeat stay, all other
    columns too.  Without any labelled text no language can be told, and only
    texts without letters go.  An empty table stays one.
    """
    net = langid.fit(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.least_score(net, LEAST_SURE))
    found = F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang")
    return langid.judged(docs, net).where(kept).select(*[found if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles at Jaccard 0.8 or more: that with the smallest doc_id.

    SimHash within two of 64 bits and min-wise bands give candidates, and exact
    similarities decide.  Exactly one row of each group stays, whether its
    doc_id is null, or that of rows in other groups, or not; of rows of one doc_id
    and text, that whose columns come first as JSON.  Texts without words, null
    and empty ones too, are one group.  An empty table stays one.
    """
    groups = written(neartexts.groups(docs), "pipeline-groups")
    other = ~(F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("digest").eqNullSafe(F.col("kept_digest")))
    key = F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")
    drop = written(groups.where(other).select(*key).distinct(), "pipeline-dropped")
    twice = written(groups.where(~other).groupBy("doc_id", "digest").count().where("count > 1").select(*key), "pipeline-repeated")
    rows = docs.withColumn("_text", neartexts.digest("text"))
    same = F.col("_text").eqNullSafe(F.col("_digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    kept = rows.join(small_or_shuffled(drop, drop.count()), same, "left_anti")
    n = twice.count()
    if not n:
        return kept.select(docs.columns)
    twice = small_or_shuffled(twice, n)
    row = F.struct(*docs.columns)
    one = kept.join(twice, same, "left_semi").groupBy(F.col("doc_id").alias("_id"), "_text").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.join(twice, same, "left_anti").select(docs.columns).union(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that sources reach their target weights.

    A null text has no words; null sources are one source, the last; rows with
    equal doc_id share their fate; rows come out whole.  An empty table stays one.
    """
    return mixing.mix(docs, share=1.5, weights=(3, 1, 2), most=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of 4096.

    A null text is an empty one, a piece of its end token alone; longer documents
    are cut into pieces; rows that repeat are documents of their own; of the
    columns, doc_id alone goes along.  An empty table has no pieces.
    """
    return packing.pack(docs, vocabulary(), end_id=1, capacity=4096)


STAGES = [("language", language), ("simhash", deduplicate), ("mixing", mix), ("packing", pack)]
#: SQL cannot express a network, SimHash or packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has left besides its result is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = written_so_far()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(spark, since, but_last=True)
    return docs

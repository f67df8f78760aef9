"""Differences between two views with unique keys, and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fingerprint
from ..schema import DELETE, PUT


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(kind, key, left_val, right_val) of the keys that differ: OnlyLeft, OnlyRight or Differs.

    Presence is a flag of its own, so an empty value differs from an absent one.
    """
    a = left.select("key", F.col("val").alias("left_val"), F.lit(True).alias("l"))
    b = right.select("key", F.col("val").alias("right_val"), F.lit(True).alias("r"))
    both = a.join(b, "key", "full_outer")
    kind = F.when(F.col("r").isNull(), "OnlyLeft").when(F.col("l").isNull(), "OnlyRight").when(~F.col("left_val").eqNullSafe(F.col("right_val")), "Differs")
    return both.withColumn("kind", kind).where("kind is not null").select("kind", "key", "left_val", "right_val")


def repairs(delta: DataFrame) -> DataFrame:
    """(op, key, val): the mutations that make the right side equal the left."""
    gone = F.col("kind") == "OnlyRight"
    return delta.select(F.when(gone, DELETE).otherwise(PUT).alias("op"), "key", F.when(~gone, F.col("left_val")).alias("val"))


def repaired(right: DataFrame, delta: DataFrame) -> DataFrame:
    """(key, val) of the right view after its repairs."""
    fixes = repairs(delta).withColumnRenamed("val", "new")
    both = right.select("key", "val", F.lit(True).alias("r")).join(fixes, "key", "full_outer")
    kept = both.where(F.col("op").isNull() | (F.col("op") == PUT))
    return kept.select("key", F.when(F.col("op").isNull(), F.col("val")).otherwise(F.col("new")).alias("val"))


def unequal_buckets(left: DataFrame, right: DataFrame, splits: list) -> DataFrame:
    """The buckets whose fingerprints differ: where anti-entropy need look."""
    a, b = fingerprint.buckets(left, splits), fingerprint.buckets(right, splits)
    met = a.join(b.withColumnsRenamed({"count": "c", "digest": "d"}), "bucket")
    return met.where("count <> c or digest <> d").select("bucket")


def diff_in_buckets(left: DataFrame, right: DataFrame, splits: list) -> DataFrame:
    """diff, but only the keys of unequal buckets are compared."""
    some = F.broadcast(unequal_buckets(left, right, splits))  # one row per bucket at most
    at = fingerprint.bucket_of(F.col("key"), splits)
    narrow = lambda v: v.withColumn("bucket", at).join(some, "bucket", "left_semi").drop("bucket")
    return diff(narrow(left), narrow(right))

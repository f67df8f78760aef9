"""Atomic groups of a log: which of them are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (batch_id, pos, closes, ...) of whole groups, and the others.

    A group counts only if its closing record is there, as the last, and its
    positions rise by one from 0; with a column seq, sequence numbers must rise
    with them.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.max(F.when(F.col("closes"), F.col("pos"))).alias("c")]
    where = "a = 0 and n = d and b = n - 1 and c = b"
    if "seq" in rows.columns:
        sums += [F.min(F.col("seq") - F.col("pos")).alias("e"), F.max(F.col("seq") - F.col("pos")).alias("f")]
        where += " and e = f"
    whole = rows.groupBy("batch_id").agg(*sums).where(where).select("batch_id")
    return rows.join(whole, "batch_id", "left_semi"), rows.join(whole, "batch_id", "left_anti")

"""The mutation log: its columns, its operations, and the checks on what enters it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operation codes.
PUT, DELETE, RANGE_DELETE, PUT_TTL = 1, 2, 3, 4
#: The largest sequence number, which means "latest".
LATEST = (1 << 63) - 1
KEY_MAX = VAL_MAX = 65535

LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("val", T.BinaryType(), True),
        T.StructField("expire_at", T.LongType(), False),
        T.StructField("batch_id", T.LongType(), True),
        T.StructField("node_id", T.LongType(), False),
        T.StructField("seal_wall", T.LongType(), False),
        T.StructField("segment_id", T.LongType(), True),
    ]
)


class InvalidMutation(ValueError):
    """A mutation that may not enter the log."""


@dataclass
class Batch:
    """Mutations that become visible together; the i-th gets the base sequence number plus i."""

    most: int = 1 << 16
    key_max: int = KEY_MAX
    val_max: int = VAL_MAX
    ops: list[tuple[int, bytes, bytes | None, int]] = field(default_factory=list)

    def _add(self, op: int, key: bytes, val: bytes | None, expire_at: int = 0) -> Batch:
        if not key:
            raise InvalidMutation("empty key")
        if len(key) > self.key_max:
            raise InvalidMutation(f"key of {len(key)} bytes; at most {self.key_max}")
        if val is not None and len(val) > (self.key_max if op == RANGE_DELETE else self.val_max):
            raise InvalidMutation(f"value of {len(val)} bytes")
        if not 0 <= expire_at <= LATEST:
            raise InvalidMutation("expiry out of range")
        if len(self.ops) >= self.most:
            raise InvalidMutation("batch is full")
        self.ops.append((op, bytes(key), val if val is None else bytes(val), expire_at))
        return self

    def put(self, key: bytes, val: bytes) -> Batch:
        return self._add(PUT, key, val)

    def put_ttl(self, key: bytes, val: bytes, expire_at: int) -> Batch:
        """A put that expires at a tick; at tick 0 never, as a plain put."""
        return self._add(PUT_TTL if expire_at else PUT, key, val, expire_at)

    def delete(self, key: bytes) -> Batch:
        return self._add(DELETE, key, None)

    def delete_range(self, start: bytes, end: bytes) -> Batch:
        """Deletes [start, end); an empty or inverted range is no mutation and takes no sequence number."""
        return self._add(RANGE_DELETE, start, end) if start < end else self

    def __len__(self) -> int:
        return len(self.ops)

    def rows(self, spark: SparkSession, base: int, batch_id: int | None = None, node_id: int = 0) -> DataFrame:
        """The log rows of this batch when its first sequence number is base."""
        if base < 1 or base + len(self.ops) - 1 > LATEST:
            raise InvalidMutation("sequence number out of range")
        return spark.createDataFrame([(base + i, op, key, val, expire, batch_id, node_id, 0, None) for i, (op, key, val, expire) in enumerate(self.ops)], LOG)


def sequenced(batches: DataFrame, base: int) -> DataFrame:
    """Log rows of a table of batches (batch_id, ops), ops an array of structs (op, key, val, expire_at).

    Batches follow each other by batch_id and operations by their place; a later
    operation of a batch has a higher sequence number.  A batch's offset is the
    size of the batches before it: a running sum within a block of 65,536 ids, and
    one over blocks, a row each.
    """
    sizes = batches.selectExpr("batch_id", "cast(size(ops) as bigint) as n", "batch_id div 65536 as block")
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n")).selectExpr("block", "sum(n) over (order by block) - n as base")
    within = sizes.selectExpr("batch_id", "block", "sum(n) over (partition by block order by batch_id) - n as before")
    first = within.join(blocks, "block").selectExpr("batch_id", "base + before as before")
    flat = batches.select("batch_id", F.posexplode("ops").alias("pos", "o"))
    return flat.join(first, "batch_id").select((F.lit(base) + F.col("before") + F.col("pos")).alias("seq"), "o.op", "o.key", "o.val", "o.expire_at", "batch_id")


def faults(key_max: int = KEY_MAX, val_max: int = VAL_MAX) -> Column:
    """The reason why a row may not enter the log, or null."""
    size = F.octet_length
    return (
        F.when(F.col("seq").isNull() | (F.col("seq") < 1), "sequence number out of range")
        .when(F.col("key").isNull() | (size("key") == 0), "empty key")
        .when(size("key") > key_max, "key too large")
        .when(~F.col("op").isin(PUT, DELETE, RANGE_DELETE, PUT_TTL) | F.col("op").isNull(), "unknown operation")
        .when(F.col("op").isin(PUT, PUT_TTL) & F.col("val").isNull(), "put without a value")
        .when(F.col("op").isin(PUT, PUT_TTL) & (size("val") > val_max), "value too large")
        .when((F.col("op") == RANGE_DELETE) & (F.col("val").isNull() | (F.col("key") >= F.col("val"))), "empty range")
        .when(F.col("expire_at") < 0, "expiry out of range")
    )


def checked(rows: DataFrame, key_max: int = KEY_MAX, val_max: int = VAL_MAX) -> tuple[DataFrame, DataFrame]:
    """The rows that may enter the log, and the others with a fault."""
    marked = rows.withColumn("fault", faults(key_max, val_max))
    return marked.where("fault is null").drop("fault"), marked.where("fault is not null")

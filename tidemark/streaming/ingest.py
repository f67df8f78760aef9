"""Streaming ingest: each micro-batch is one atomic commit to a store, once even if it is run again.

The epoch of a source and its highest ticket are part of the commit that makes the
rows visible, and stay in the manifest whatever is flushed or compacted, so a
repeated micro-batch is known at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.bins import with_rank
from ..plans.groups import complete
from ..plans.scratch import drop_written, written, written_so_far
from ..schema import LOG, faults
from ..sources.manifest import Conflict
from ..sources.store import Store

#: The operation of a dead ticket: its writer gave up, and nothing is to be written.
DEAD = 0


def append_once(store: Store, rows: DataFrame, epoch: int, source: str = "stream", node_id: int = 0, rejects: str | None = None) -> int:
    """Commits a micro-batch (ticket, op, key, val, expire_at) in ticket order; returns the highest durable seq.

    An epoch that the manifest has is durable already, and nothing is written.
    Of rows that share a ticket, the first by (op, key, val, expire_at) counts.  A
    dead ticket (op 0) takes no sequence number; it is durable with its epoch.
    Tickets are numbered in ranges, so a micro-batch of any size is no task's own.
    """
    v = store.version()
    if v.epochs.get(source, -1) >= epoch:
        return v.next_seq - 1
    name = f"{source}-{epoch:012d}"
    store.files.delete(f"log/{name}")  # of an attempt that was not committed
    since, dead = written_so_far(), F.col("op").eqNullSafe(F.lit(DEAD))
    try:
        one = rows.groupBy("ticket").agg(F.min(F.struct("op", "key", "val", "expire_at")).alias("o")).select("ticket", "o.*")
        one = written(one.withColumn("seq", F.lit(1).cast("long")).withColumn("fault", F.when(~dead, faults())), "epoch")
        lives = F.col("fault").isNull() & ~dead
        top, n, n_bad = one.agg(F.max("ticket"), F.count(F.when(lives, 1)), F.count("fault")).first()
        if rejects and n_bad:
            one.where("fault is not null").drop("seq").write.mode("append").parquet(rejects)
        ranked = with_rank(one.where(lives).drop("seq", "fault"), "at", column="ticket")
        numbered = ranked.select((F.lit(v.next_seq - 1) + F.col("at")).cast("long").alias("seq"), "op", "key", "val", "expire_at")
        whole = {"batch_id": F.lit(v.next_seq).cast("long"), "node_id": F.lit(node_id).cast("long"), "seal_wall": F.lit(0).cast("long"), "segment_id": F.lit(None).cast("long")}
        tickets = {source: int(top)} if isinstance(top, int) else {}
        store.append(numbered.withColumns(whole).select([f.name for f in LOG]), n, v, name, {source: epoch}, tickets)
    finally:
        drop_written(store.spark, since)
    return store.version().next_seq - 1


class Poisoned(RuntimeError):
    """The drainer has met an error that it cannot wait out; its host fails the writers that wait."""


class Drainer:
    """Takes micro-batches into a store, one at a time, and stops where it must.

    capacity: unsealed rows beyond which a micro-batch is not taken: the drainer
    stalls, nothing is lost or durable, and the host flushes and sweeps again.  Any
    other failure but a lost race for the manifest poisons it: the error is raised,
    and every later sweep raises Poisoned.
    """

    def __init__(self, store: Store, source: str = "stream", capacity: int = 1 << 24, node_id: int = 0, rejects: str | None = None):
        self.store, self.source, self.capacity, self.node_id, self.rejects = store, source, capacity, node_id, rejects
        self.error: Exception | None = None

    @property
    def poisoned(self) -> bool:
        return self.error is not None

    def sweep(self, rows: DataFrame, epoch: int) -> int | None:
        """The highest durable seq, or None if the drainer stalls."""
        if self.error is not None:
            raise Poisoned(str(self.error)) from self.error
        try:
            v = self.store.version()
            if v.unsealed_rows and v.epochs.get(self.source, -1) < epoch and v.unsealed_rows + rows.count() > self.capacity:
                return None
            for last in (False, False, True):
                try:
                    return append_once(self.store, rows, epoch, self.source, self.node_id, self.rejects)
                except Conflict:
                    if last:
                        raise
        except Exception as e:
            self.error = e
            raise
        return None

    def flush(self) -> None:
        """Seals what is unsealed, which ends a stall."""
        self.store.flush(self.node_id)


def start(store: Store, stream: DataFrame, checkpoint: str, source: str = "stream", node_id: int = 0, rejects: str | None = None, capacity: int = 1 << 24, compact_every: int = 0) -> DataStreamWriter:
    """A writer that ingests a stream (ticket, op, key, val, expire_at) into a store; call start() on it.

    A stall flushes and goes on.  compact_every: after so many epochs the store is
    flushed and one compaction step is run, between micro-batches.  Bound a
    micro-batch by the source's own options, such as maxFilesPerTrigger.
    """
    drainer = Drainer(store, source, capacity, node_id, rejects)

    def sweep(rows: DataFrame, epoch: int) -> None:
        if drainer.sweep(rows, epoch) is None:
            drainer.flush()
            drainer.sweep(rows, epoch)
        if compact_every and epoch % compact_every == compact_every - 1:
            store.flush(node_id)
            store.compact_step()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sweep)


def durable_seq(store: Store) -> int:
    """The highest sequence number that a reader will find after any failure."""
    return store.version().next_seq - 1


def durable_ticket(store: Store, source: str = "stream") -> int | None:
    """The highest ticket of a source's durable epochs, dead tickets included; None before the first."""
    return store.version().tickets.get(source)


def is_durable(ticket: int, watermark: int, bits: int = 31) -> bool:
    """Whether a ticket, counted modulo 2^bits, is at or before the durable one."""
    return (watermark - ticket) % (1 << bits) < 1 << (bits - 1)


__all__ = ["DEAD", "Drainer", "Poisoned", "append_once", "complete", "durable_seq", "durable_ticket", "is_durable", "start"]

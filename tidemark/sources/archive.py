"""Segments out of the store and back: archive, ingest, origin stamps, and the check that no deleted key comes back."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import OBJECT_NAME
from ..plans.resolve import resolve
from ..schema import DELETE, LATEST, LOG, RANGE_DELETE
from .manifest import Conflict, Files
from .store import Store


class WouldResurrect(RuntimeError):
    """Without the segment, a key that it deletes would be visible again."""


def resurrected(log: DataFrame, segment_id: int, watermarks: list[int]) -> DataFrame:
    """(watermark, key) of keys that the segment's deletions hide and that would be visible without it, exactly.

    Views older than the oldest deletion are skipped.  Only keys that the segment
    deletes are resolved, with and without it, at tick 0.
    """
    own = log.where(F.col("segment_id") == segment_id)
    tombs = own.where(F.col("op").isin(DELETE, RANGE_DELETE))
    low, first, last = tombs.agg(F.min("seq"), F.min("key"), F.max(F.when(F.col("op") == RANGE_DELETE, F.col("val")).otherwise(F.col("key")))).first()
    out = None
    for w in watermarks:
        if low is None or w < low:
            continue
        near = log.where(F.when(F.col("op") == RANGE_DELETE, (F.col("key") <= F.lit(last)) & (F.col("val") >= F.lit(first))).otherwise(F.col("key").between(F.lit(first), F.lit(last))))
        now = resolve(near, w)
        then = resolve(near, w, without_segment=segment_id)
        found = then.join(now.select("key"), "key", "left_anti").select(F.lit(w).cast("long").alias("watermark"), "key")
        out = found if out is None else out.union(found)
    return log.select(F.lit(0).cast("long").alias("watermark"), "key").limit(0) if out is None else out


def refuses(store: Store, segment_id: int, mode: str = "conservative") -> bool:
    """Whether archiving the segment is refused.

    ``exact`` compares views with and without it.  ``conservative`` also refuses
    if another segment, or the unsealed log, merely overlaps one of its ranges,
    the end of the range included.
    """
    v = store.version()
    s = v.segment(segment_id)
    if s is None:
        return False
    marks = [LATEST, *v.snapshots.values()]
    log = store.log(v)
    if mode == "conservative" and s.rdel_count:
        spans = store.segment(s).where(F.col("op") == RANGE_DELETE).select(F.hex("key").alias("a"), F.hex("val").alias("b"))
        others = [(o.first_key.upper(), o.last_key.upper()) for o in v.segments if o.segment_id != segment_id]
        edge = store.unsealed(v).agg(F.hex(F.min("key")), F.hex(F.max("key"))).first()
        others += [tuple(edge)] if edge[0] is not None else []
        if others:
            near = F.broadcast(store.spark.createDataFrame(others, "first string, last string"))  # the manifest's rows
            if spans.join(near, (F.col("a") <= F.col("last")) & (F.col("first") <= F.col("b"))).limit(1).count():
                return True
    return resurrected(log, segment_id, marks).limit(1).count() > 0


def object_name(segment_id: int) -> str:
    return OBJECT_NAME % segment_id


@dataclass(frozen=True)
class Plan:
    """What an archive of a segment would take: its object's name and descriptor, its rows, and whether it is refused."""

    segment_id: int
    name: str
    descriptor: dict
    entries: int
    refused: bool


def plan(store: Store, segment_id: int, mode: str = "conservative") -> Plan | None:
    """The plan of a segment's archive; None if it is gone.  Nothing is changed."""
    s = store.version().segment(segment_id)
    return None if s is None else Plan(segment_id, object_name(segment_id), s.descriptor(), s.entry_count, refuses(store, segment_id, mode))


def archive(store: Store, segment_id: int, to: Files, mode: str = "conservative") -> bool:
    """Copies a segment and its descriptor out and takes it off the manifest; False if it is gone already."""
    v = store.version()
    s = v.segment(segment_id)
    p = plan(store, segment_id, mode)
    if s is None or p is None:
        return False
    if p.refused:
        raise WouldResurrect(f"segment {segment_id}")
    if not to.names(p.name):
        store.files.copy(s.path, to, f"{p.name}/data")
    body = json.dumps(p.descriptor, sort_keys=True)
    to.create(f"{p.name}/descriptor.json", json.dumps({"crc32": zlib.crc32(body.encode()), "descriptor": body}).encode())
    store.swap(v, (s,), (), v.next_segment)
    return True


def descriptor(where: Files, segment_id: int) -> dict:
    outer = json.loads(where.read(f"{object_name(segment_id)}/descriptor.json"))
    if zlib.crc32(outer["descriptor"].encode()) != outer["crc32"]:
        raise ValueError(f"descriptor of segment {segment_id} is damaged")
    return json.loads(outer["descriptor"])


def ingest(store: Store, where: Files, segment_id: int) -> bool:
    """Attaches an archived segment at level 0 under its own id; False if it is attached, a conflict if another is.

    Its counts and bounds are read and held against the descriptor.
    """
    d = descriptor(where, segment_id)
    v = store.version()
    present = v.segment(segment_id)
    if present is not None:
        if present.descriptor() == d:
            return False
        raise Conflict(f"segment {segment_id} has other contents")
    path = f"segments/{segment_id:010d}-ingested"
    if not store.files.names(path):
        where.copy(f"{object_name(segment_id)}/data", store.files, path)
    found = store.describe(path, 0, d["node_id"], d["seal_wall"])
    if len(found) != 1 or found[0].descriptor() != d:
        raise ValueError(f"segment {segment_id} does not fit its descriptor")
    s = found[0]
    top = max(v.next_seq, s.max_seq + 1)
    store.commit(replace(v, segments=(*v.segments, s), next_segment=max(v.next_segment, segment_id + 1), next_seq=top))
    return True


def stamp(store: Store, segment_id: int, node_id: int, seal_wall: int) -> bool:
    """Names a segment's origin: fills a missing wall once, or claims a segment without a stamp; the same stamp again is no change."""
    v = store.version()
    s = v.segment(segment_id)
    if s is None:
        raise KeyError(segment_id)
    if (s.node_id, s.seal_wall) == (node_id, seal_wall):
        return False
    if s.seal_wall or (s.node_id and s.node_id != node_id):
        raise Conflict(f"segment {segment_id} is stamped ({s.node_id}, {s.seal_wall})")
    stamped = replace(s, node_id=node_id, seal_wall=seal_wall)
    store.commit(replace(v, segments=tuple(stamped if x is s else x for x in v.segments)))
    return True


def sweep(store: Store, to: Files, horizon: bytes) -> list[int]:
    """Archives the segments whose keys all lie below a horizon; those refused stay."""
    done = []
    for s in store.version().segments:
        if s.last_key < horizon.hex():
            try:
                if archive(store, s.segment_id, to):
                    done.append(s.segment_id)
            except WouldResurrect:
                continue
    return done


def archived(store: Store, where: Files) -> DataFrame | None:
    """All rows of all archived segments, in one scan, with their origin; None if there are none."""
    found = [descriptor(where, int(name)) for name in where.names("tables")]
    if not found:
        return None
    paths = [f"{where.root}/{object_name(d['segment_id'])}/data/{k}" for d in found for k in where.names(f"{object_name(d['segment_id'])}/data") if k.startswith("kind=")]
    origin = store.spark.createDataFrame([(d["segment_id"], d["node_id"], d["seal_wall"]) for d in found], "segment_id long, node_id long, seal_wall long")
    rows = store.spark.read.schema(LOG).parquet(*paths).drop("node_id", "seal_wall")
    return rows.join(F.broadcast(origin), "segment_id").select([f.name for f in LOG])  # a row per segment


def ship(store: Store, through: Files, to: Store, segment_id: int) -> bool:
    """Replicates a segment: its archive object into another store."""
    s = store.version().segment(segment_id)
    if s is None:
        raise KeyError(segment_id)
    name = object_name(segment_id)
    if not through.names(name):
        store.files.copy(s.path, through, f"{name}/data")
        body = json.dumps(s.descriptor(), sort_keys=True)
        through.create(f"{name}/descriptor.json", json.dumps({"crc32": zlib.crc32(body.encode()), "descriptor": body}).encode())
    return ingest(to, through, segment_id)

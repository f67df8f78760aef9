from __future__ import annotations

import random

import pytest

from tidemark import model
from tidemark.schema import DELETE, PUT, RANGE_DELETE, Batch
from tidemark.sources import archive, manifest
from tidemark.sources.manifest import Conflict, Files
from tidemark.sources.store import Store
from tidemark.streaming import ingest


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def as_dict(df):
    return {bytes(r.key): (bytes(r.val), r.seq) for r in df.collect()}


def test_life_of_a_store(store):
    r = random.Random(7)
    rows, snaps = [], {}
    for step in range(6):
        b, seq = Batch(), store.version().next_seq
        for _ in range(12):
            key, op = b"k%d" % r.randrange(8), r.choice([PUT, PUT, PUT, DELETE, RANGE_DELETE])
            if op == PUT:
                b.put(key, bytes([r.randrange(256)]))
            elif op == DELETE:
                b.delete(key)
            else:
                b.delete_range(key, b"k%d" % r.randrange(8))
        assert store.write(b) == seq
        rows += [model.Row(seq + i, op, k, v, e) for i, (op, k, v, e) in enumerate(b.ops)]
        if step == 1:
            snaps["s"] = store.snapshot("s")[1]
        if step in (0, 2, 4):
            store.flush()
    assert as_dict(store.view()) == model.view(rows)
    assert store.write(Batch()) == store.version().next_seq
    before = as_dict(store.view(snaps["s"]))
    assert before == model.view(rows, snaps["s"])
    store.compact_all()
    v = store.version()
    assert store.check() == [] and len(v.segments) == 1 and not v.unsealed
    assert as_dict(store.view()) == model.view(rows) and as_dict(store.view(snaps["s"])) == before
    assert store.get(b"nothing") is None and store.vacuum() > 0 and as_dict(store.view()) == model.view(rows)
    again = Store(store.spark, store.root)
    assert again.version() == v and as_dict(again.view()) == model.view(rows)


def test_levels_fill_and_move(store):
    for i in range(4):
        store.write(Batch().put(b"k%d" % i, b"v"))
        store.flush()
    assert store.pending() and store.compact_step() and not store.pending() and not store.compact_step()
    assert [s.level for s in store.version().segments] == [1] and len(as_dict(store.view())) == 4
    assert [s.segment_id for s in store.pruned(store.version(), b"x")] == []


def test_commits_are_atomic(store):
    store.write(Batch().put(b"a", b"1"))
    stale = store.version()
    store.write(Batch().put(b"b", b"2"))
    with pytest.raises(Conflict):
        store.commit(stale)
    assert store.files.create(f"{manifest.MANIFEST}/9999999999.json", b"torn")  # a damaged version is passed over
    assert store.version().next_seq == 3 and store.get(b"b") == b"2"


def test_snapshots_are_limited(store):
    small = Store(store.spark, store.root, snapshots=1)
    name, _ = small.snapshot()
    with pytest.raises(Conflict):
        small.snapshot()
    small.release(name)
    small.snapshot()


def test_archive_and_ingest(spark, store, tmp_path):
    out = Files(spark, f"file://{tmp_path}/archive")
    store.write(Batch().put(b"a", b"1").put(b"b", b"1"))
    first = store.flush()
    store.write(Batch().delete(b"a").put(b"c", b"2"))
    second = store.flush(node_id=3, seal_wall=9)
    view = as_dict(store.view())
    with pytest.raises(archive.WouldResurrect):
        archive.archive(store, second.segment_id, out)
    assert archive.archive(store, first.segment_id, out) and not archive.archive(store, first.segment_id, out)
    assert set(as_dict(store.view())) == {b"c"}
    assert archive.ingest(store, out, first.segment_id) and not archive.ingest(store, out, first.segment_id)
    assert as_dict(store.view()) == view and archive.archived(store, out).count() == 2
    assert archive.stamp(store, first.segment_id, 0, 5) and not archive.stamp(store, first.segment_id, 0, 5)
    with pytest.raises(Conflict):
        archive.stamp(store, first.segment_id, 0, 6)
    with pytest.raises(Conflict):
        archive.ingest(store, out, first.segment_id)


def test_ranges_refuse_conservatively(spark, store):
    store.write(Batch().delete_range(b"a", b"m"))
    ranges = store.flush()
    store.write(Batch().put(b"m", b"1"))
    store.flush()
    assert archive.refuses(store, ranges.segment_id) and not archive.refuses(store, ranges.segment_id, "exact")


def test_streaming_is_idempotent(spark, store, tmp_path):
    src = f"{tmp_path}/in"
    schema = "ticket long, op int, key binary, val binary, expire_at long"
    spark.createDataFrame([(2, PUT, b"a", b"2", 0), (1, PUT, b"a", b"1", 0), (3, PUT, b"", b"x", 0)], schema).coalesce(1).write.parquet(f"{src}/1")
    query = ingest.start(store, spark.readStream.schema(schema).parquet(f"{src}/*"), f"{tmp_path}/cp", rejects=f"{tmp_path}/rejects").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    assert store.get(b"a") == b"2" and ingest.durable_seq(store) == 2 and spark.read.parquet(f"{tmp_path}/rejects").count() == 1
    rows = spark.createDataFrame([(5, PUT, b"b", b"1", 0)], schema)
    assert ingest.append_once(store, rows, 40) == 3 and ingest.append_once(store, rows, 40) == 3
    store.flush()
    assert ingest.append_once(store, rows, 40) == 3
    assert ingest.is_durable(5, 5) and not ingest.is_durable(6, 5) and ingest.is_durable((1 << 31) - 1, 3)


def test_command_line(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    root = f"file://{tmp_path}/cli"
    for args in (["put", "a", "1"], ["put", "b", "2"], ["del", "a"], ["compact"], ["scan"], ["stats"]):
        assert main([root, *args]) == 0
    assert main([root, "get", "a"]) == 1 and main([root, "get", "b"]) == 0
    out = capsys.readouterr().out.split("\n")
    assert out[:3] == ["1", "2", "3"] and out[3] == "b\t2" and out[5] == "2"

from __future__ import annotations

import random
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.schema import DELETE, PUT, RANGE_DELETE, Batch
from tidemark.sources import archive
from tidemark.sources.manifest import Conflict, Files, Segment, Version
from tidemark.sources.store import Line, Store
from tidemark.streaming import ingest


def as_dict(df):
    return {bytes(r.key): (bytes(r.val), r.seq) for r in df.collect()}


def key(i):
    return b"k%04d" % i


@pytest.fixture()
def small(spark, tmp_path):
    """A store whose segments hold about forty rows."""
    return Store(spark, f"file://{tmp_path}/store", segment_rows=40)


def random_batch(r, keys, n):
    b = Batch()
    for _ in range(n):
        op = r.choice([PUT] * 6 + [DELETE, RANGE_DELETE])
        k = r.randrange(keys)
        if op == PUT:
            b.put(key(k), bytes([r.randrange(256)]))
        elif op == DELETE:
            b.delete(key(k))
        else:
            b.delete_range(key(k), key(min(keys, k + r.randrange(1, 30))))
    return b


def rows_of(b, seq):
    return [model.Row(seq + i, op, k, v, e) for i, (op, k, v, e) in enumerate(b.ops)]


@pytest.mark.parametrize("seed", range(2))
def test_steps_leave_every_view_as_it_is(small, seed):
    r = random.Random(seed)
    rows, snaps = [], []
    for i in range(9):
        b = random_batch(r, 120, 60)
        rows += rows_of(b, small.write(b))
        if i in (2, 5):
            snaps.append(small.snapshot()[1])
        small.flush()
        if i % 2:
            small.compact_step()
        assert small.check() == []
    views = {s: model.view(rows, s) for s in snaps}
    while small.compact_step():
        assert small.check() == []
        assert as_dict(small.view()) == model.view(rows)
    small.compact_all()
    assert small.check() == [] and len(small.version().segments) > 1
    assert as_dict(small.view()) == model.view(rows) and all(as_dict(small.view(s)) == v for s, v in views.items())
    for lo, hi in ((key(5), key(30)), (key(40), key(41)), (key(100), None)):
        assert as_dict(small.view(start=lo, end=hi)) == {k: v for k, v in model.view(rows).items() if lo <= k and (hi is None or k < hi)}


def test_outputs_are_split_between_keys_and_range_deletes_with_them(small):
    b = Batch(most=10_000)
    for i in range(200):
        b.put(key(i), b"a").put(key(i), b"b")
    small.write(b)
    small.snapshot()
    small.write(Batch().delete_range(key(10), key(190)))
    small.flush()
    small.compact_all()
    v = small.version()
    run = sorted(v.segments, key=lambda s: s.first_key)
    assert len(run) >= 5 and small.check() == [] and max(s.entry_count for s in run) < 200
    points = [{bytes(r.key) for r in small.segment(s).where("op <> 3").select("key").collect()} for s in run]
    assert all(max(a) < min(b) for a, b in zip(points, points[1:], strict=False))
    spans = sorted((bytes(r.key), bytes(r.val)) for r in small.log().where("op = 3").collect())
    assert spans[0][0] == key(10) and spans[-1][1] == key(190) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(as_dict(small.view())) == 20


def test_a_step_rewrites_only_what_overlaps(spark, tmp_path):
    small = Store(spark, f"file://{tmp_path}/store", segment_rows=40, levels=2)
    b = Batch(most=10_000)
    for i in range(400):
        b.put(key(i), b"old")
    small.write(b)
    small.flush()
    small.compact_all()
    before = small.version()
    assert len(before.segments) >= 8
    for _ in range(4):
        small.write(Batch().put(key(101), b"new").put(key(110), b"new"))
        small.flush()
    assert small.compact_step()
    after = small.version()
    kept = [s for s in before.segments if s in after.segments]
    gone = [s for s in before.segments if s not in after.segments]
    # the segments that the new keys meet, and a small one beside them at either end
    assert 1 <= len(gone) <= 4 and len(kept) == len(before.segments) - len(gone)
    assert not any(s.overlaps(key(101).hex(), key(110).hex()) for s in kept)
    made = [s for s in after.segments if s not in before.segments]
    assert sum(s.entry_count for s in made) == sum(s.entry_count for s in gone) and not after.level(0)
    assert as_dict(small.view())[key(101)][0] == b"new" and len(as_dict(small.view())) == 400


def segment(i, level, first, last, rows=40, node=0):
    return Segment(i, level, f"segments/{i}", key(first).hex(), key(last).hex(), 1, 9, rows, 0, node)


def test_the_choice_of_jobs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", segment_rows=40, most_segments=6, levels=3)
    full = [segment(i, 1, 10 * i, 10 * i + 5) for i in range(4)]
    # overlaps nothing and is not small: it moves
    job = store.job(Version(segments=tuple(full)), 1, [full[0]])
    assert job.move and not job.targets
    # a small one is merged, and small ones beside the run join
    little = segment(9, 1, 100, 105, rows=10)
    below = [segment(20, 2, 80, 85, rows=10), segment(21, 2, 90, 95), segment(22, 2, 110, 115, rows=10), segment(23, 2, 120, 125, rows=10)]
    job = store.job(Version(segments=(little, *below)), 1, [little])
    assert not job.move and [s.segment_id for s in job.targets] == [22]
    wide = segment(8, 1, 92, 104, rows=10)
    assert [s.segment_id for s in store.job(Version(segments=(wide, *below)), 1, [wide]).targets] == [21, 20, 22]
    # a foreign segment in the way vetoes; another source is taken
    foreign = segment(30, 2, 0, 15, node=7)
    jobs = list(store.jobs(Version(segments=(*full, foreign))))
    assert [j.sources[0].segment_id for j in jobs] == [2, 3]
    # the deepest full level first, then level 0 by nodes
    zero = [segment(40 + i, 0, 60, 80, node=i % 2) for i in range(5)]
    v = Version(segments=(*full, *zero))
    assert [(j.level, len(j.sources)) for j in Store(spark, store.root, segment_rows=40, levels=4).jobs(v)] == [(1, 1)] * 4 + [(0, 3), (0, 2)]
    # under pressure, levels that are not full go down as well
    few = Version(segments=(*full[:2], *zero[:2], *below))
    assert not list(Store(spark, store.root, segment_rows=40, levels=3).jobs(few))
    assert [j.level for j in store.jobs(few)][:1] == [1]


def test_narrowed_segments(small):
    small.write(Batch().put(key(1), b"a").put(key(5), b"b").delete_range(key(2), key(9)).put(key(6), b"c"))
    s = small.flush()
    assert small.narrow(s.segment_id, key(5)) and not small.narrow(s.segment_id, key(3))
    assert set(as_dict(small.view())) == {key(6)}
    rows = {(r.op, bytes(r.key), bytes(r.val)) for r in small.log().collect()}
    assert rows == {(PUT, key(5), b"b"), (RANGE_DELETE, key(5), key(9)), (PUT, key(6), b"c")}
    with pytest.raises(ValueError):
        small.narrow(s.segment_id, b"z")
    with pytest.raises(KeyError):
        small.narrow(99, b"z")


def test_groups_and_replay(spark, small):
    assert small.write_group([Batch().put(b"a", b"1").put(b"b", b"1"), Batch(), Batch().put(b"a", b"2")]) == [1, 3, 3]
    assert len(small.version().unsealed) == 1 and small.version().unsealed_rows == 3
    assert {(r.seq, r.batch_id) for r in small.unsealed().collect()} == {(1, 1), (2, 1), (3, 3)}
    schema = "seq long, op int, key binary, val binary, expire_at long, batch_id long, pos int, closes boolean, node_id long"
    whole = [(4, PUT, b"c", b"3", 0, 4, 0, False, 0), (5, PUT, b"d", b"3", 0, 4, 1, True, 0)]
    torn = [(6, PUT, b"e", b"3", 0, 6, 0, False, 0), (8, PUT, b"f", b"3", 0, 7, 0, False, 0), (10, PUT, b"f", b"3", 0, 7, 1, True, 0)]
    old = [(3, PUT, b"a", b"9", 0, 3, 0, True, 0)]
    log = spark.createDataFrame([*old, *whole, *torn], schema)
    assert small.replay(log) == 2 and small.replay(log) == 0
    assert as_dict(small.view()) == {b"a": (b"2", 3), b"b": (b"1", 2), b"c": (b"3", 4), b"d": (b"3", 5)} and small.version().next_seq == 6
    got = {bytes(r.key): r.found for r in small.lookup(small.flush().segment_id, spark.createDataFrame([(b"a",), (b"x",)], "key binary")).collect()}
    assert got == {b"a": "value", b"x": "missing"}


def test_epochs_outlive_flushes_and_compaction(spark, small):
    schema = "ticket long, op int, key binary, val binary, expire_at long"
    rows = spark.createDataFrame([(1, PUT, b"a", b"1", 0), (2, PUT, b"b", b"1", 0)], schema)
    assert ingest.append_once(small, rows, 0) == 2
    small.flush()
    assert ingest.append_once(small, rows, 0) == 2
    small.compact_all()
    assert ingest.append_once(small, rows, 0) == 2 and small.version().next_seq == 3


def test_drainer(spark, small, monkeypatch):
    schema = "ticket long, op int, key binary, val binary, expire_at long"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    d = ingest.Drainer(small, capacity=3)
    assert d.sweep(make((1, PUT, b"a", b"1", 0), (2, ingest.DEAD, b"", None, 0), (3, PUT, b"b", b"1", 0), (3, PUT, b"b", b"2", 0)), 0) == 2
    assert ingest.durable_ticket(small) == 3 and small.get(b"b") == b"1"
    more = make((4, PUT, b"c", b"1", 0), (5, PUT, b"d", b"1", 0))
    assert d.sweep(more, 1) is None and small.version().next_seq == 3 and ingest.durable_ticket(small) == 3  # stalled, nothing lost
    d.flush()
    assert d.sweep(more, 1) == 4 and ingest.durable_ticket(small) == 5
    assert d.sweep(make((6, ingest.DEAD, b"", None, 0)), 2) == 4 and ingest.durable_ticket(small) == 6
    monkeypatch.setattr(small, "append", lambda *a, **k: (_ for _ in ()).throw(OSError("no space")))
    d.flush()
    with pytest.raises(OSError):
        d.sweep(make((7, PUT, b"e", b"1", 0)), 3)
    monkeypatch.undo()
    assert d.poisoned
    with pytest.raises(ingest.Poisoned):
        d.sweep(make((7, PUT, b"e", b"1", 0)), 3)
    assert ingest.Drainer(small).sweep(make((7, PUT, b"e", b"1", 0)), 3) == 5  # a new one goes on where the log ends


def test_streams_stall_flush_and_compact(spark, small, tmp_path):
    schema = "ticket long, op int, key binary, val binary, expire_at long"
    for i in range(5):
        spark.createDataFrame([(10 * i + j, PUT, b"%d" % j, b"%d" % i, 0) for j in range(10)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = ingest.start(small, stream, f"{tmp_path}/cp", capacity=15, compact_every=2).trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None
    assert small.version().epochs["stream"] == 4 and ingest.durable_seq(small) == 50 and len(as_dict(small.view())) == 10


def test_one_of_two_writers_wins(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/m")
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(files.create("manifest/0000000001.json", b"%d" % i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True]
    assert files.names("manifest") == ["0000000001.json"]


def test_compaction_keeps_what_others_write_meanwhile(small):
    small.write(Batch().put(b"a", b"1"))
    small.flush()
    v = small.version()
    small.write(Batch().put(b"b", b"2"))
    small.rewrite(v, list(v.segments), 1)
    assert as_dict(small.view()) == {b"a": (b"1", 1), b"b": (b"2", 2)}
    with pytest.raises(Conflict):
        small.rewrite(v, list(v.segments), 1)


def test_plans_of_archives(spark, small, tmp_path):
    small.write(Batch().put(b"a", b"1"))
    s = small.flush()
    p = archive.plan(small, s.segment_id)
    assert (p.name, p.entries, p.refused) == ("tables/0000000001", 1, False) and archive.plan(small, 77) is None
    assert small.version().segment(s.segment_id) == s


def test_summary(small):
    tick = lambda t: t.to_bytes(8, "big")
    small.write(Batch().put(tick(7) + b"r\0", b"v" * 8).put(tick(90) + b"e\0", b"v").put(b"\xffboot", (3).to_bytes(8, "little")))
    small.flush()
    small.write(Batch().put(b"x", b"y"))
    r = small.summary().first()
    assert (r.replayed, r.max_seq, r.boots, r.oldest, r.newest, r.segments, r.entries, r.levels[:2]) == (1, 4, 3, 7, 90, 1, 3, [1, 0])
    assert small.memtable().select(F.col("key").cast("string")).first()[0] == "x"


def test_acknowledged_writes_outlive_crashes(spark, tmp_path, monkeypatch):
    """Writes, flushes and compactions break off at any file operation; what was acknowledged is there, and no part of what was not."""
    r = random.Random(6)
    root = f"file://{tmp_path}/store"
    rows, create = [], Files.create
    for step in range(14):
        store = Store(spark, root, segment_rows=40)  # opened anew after each crash
        b, seq = random_batch(r, 40, 6), store.version().next_seq
        fails = r.random() < 0.5

        def broken(self, name, data, before=r.random() < 0.5):
            if not before:
                create(self, f"{name}.torn", data)
            raise OSError("power is gone")

        if fails:
            monkeypatch.setattr(Files, "create", broken)
        try:
            if step % 3 == 2:
                store.flush()
                store.compact_all()
            else:
                store.write(b)
                rows += rows_of(b, seq)
            assert not fails or not len(b)
        except OSError:
            assert fails
        finally:
            monkeypatch.setattr(Files, "create", create)
        again = Store(spark, root)
        assert again.check() == [] and as_dict(again.view()) == model.view(rows)


def test_cold_segments_are_swept_out_and_read_from_the_archive(spark, small, tmp_path):
    out = Files(spark, f"file://{tmp_path}/archive")
    for first in (0, 10, 90):
        b = Batch()
        for i in range(first, first + 5):
            b.put(key(i), b"v")
        small.write(b)
        small.flush()
    small.write(Batch().delete(key(90)))  # hides a key of the third segment, which stays: so must this one
    hiding = small.flush()
    assert archive.sweep(small, out, key(91)) == [1, 2]
    assert {s.segment_id for s in small.version().segments} == {3, hiding.segment_id}
    assert {bytes(r.key) for r in archive.archived(small, out).collect()} == {key(i) for i in [*range(5), *range(10, 15)]}
    other = Store(spark, f"file://{tmp_path}/other")
    assert archive.ship(small, out, other, 3) and not archive.ship(small, out, other, 3)
    assert set(as_dict(other.view())) == {key(i) for i in range(90, 95)} and key(90) not in as_dict(small.view())


def test_vacuum_leaves_the_last_versions(small):
    for i in range(6):
        small.write(Batch().put(key(i), b"v"))
    small.flush()
    view = as_dict(small.view())
    assert small.vacuum(versions=2) >= 6 and len(small.files.names("manifest")) == 2 and as_dict(small.view()) == view


def test_segments_are_sized_by_what_survives(small):
    for _ in range(4):
        b = Batch(most=10_000)
        for i in range(400):
            b.put(key(i % 50), b"v")
        small.write(b)
        small.flush()
    steps = 0
    while small.compact_step():
        steps += 1
    v = small.version()
    assert steps == 1 and len(v.segments) == 1 and v.segments[0].entry_count == 50 and small.check() == []
    assert as_dict(small.view()) == {key(i): (b"v", 1201 + max(range(i, 400, 50))) for i in range(50)}


def test_all_moves_before_a_rewrite_are_one_commit(small):
    v = small.commit(Version(segments=tuple(segment(i, 1, 10 * i, 10 * i + 5) for i in range(100)), next_seq=10, next_segment=100))
    assert small.compact_step() and not small.compact_step()
    after = small.version()
    assert after.number == v.number + 1 and [len(after.level(n)) for n in range(7)] == [0, 3, 3, 3, 3, 3, 85]
    assert {replace(s, level=1) for s in after.segments} == set(v.segments)
    # one that meets another of its level stays behind it, and so does what is in the way of another node
    touching = [segment(i, 1, 10 * i, 10 * i + 10) for i in range(8)]
    assert {s.segment_id for s in small.moving(Version(segments=tuple(touching)), 1)} == {0, 2, 4, 6}
    foreign = segment(30, 2, 0, 35, node=7)
    assert {s.segment_id for s in small.moving(Version(segments=(*v.segments[:8], foreign)), 1)} == {4, 5, 6, 7}
    # under pressure, levels are emptied
    tight = Store(small.spark, small.root, segment_rows=40, levels=4, most_segments=6)
    assert {s.level for s in tight.moved(Version(segments=v.segments[:6])).segments} == {3}


def test_lines_of_segments():
    r = random.Random(8)
    for _ in range(200):
        some = []
        for i in range(r.randrange(12)):
            a = r.randrange(40)
            some.append(segment(i, 1, a, a + r.randrange(6)))
        line, a = Line(some), r.randrange(40)
        low, high = key(a).hex(), key(a + r.randrange(6)).hex()
        assert line.meeting(low, high) == sorted((s for s in some if s.overlaps(low, high)), key=lambda s: s.first_key)
        left, right = [s.first_key for s in some if s.last_key < low], [s.first_key for s in some if s.first_key > high]
        assert [s.first_key for s in line.beside(low, high)] == [*([max(left)] if left else []), *([min(right)] if right else [])]

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import fingerprint, keys
from tidemark.operators import diff as diffs
from tidemark.operators import retention, scan, tombstones
from tidemark.plans.resolve import read, resolve, resolve_merged
from tidemark.schema import DELETE, LATEST, PUT, PUT_TTL, RANGE_DELETE, Batch, InvalidMutation, checked

SCHEMA = "seq long, op int, key binary, val binary, expire_at long, node_id long, seal_wall long"
KEYS = [b"\x00", b"a", b"a\x00", b"ab", b"b", b"\x7f", b"\x80", b"\xff", b"\xff\xff"]


def history(seed: int, n: int = 60, nodes: int = 1) -> list[model.Row]:
    """Random mutations over few keys, so that versions, ranges and expiries meet."""
    r = random.Random(seed)
    out = []
    for seq in range(1, n + 1):
        op = r.choice([PUT] * 5 + [DELETE, DELETE, RANGE_DELETE, PUT_TTL, PUT_TTL])
        key = r.choice(KEYS)
        val = None if op == DELETE else r.choice(KEYS) if op == RANGE_DELETE else r.randbytes(r.randint(0, 3))
        node = r.randrange(nodes) + 7 if nodes > 1 else 0
        out.append(model.Row(seq, op, key, val, seq + r.randint(1, 30) if op == PUT_TTL else 0, node, r.randint(1, 5) * 10 + node if nodes > 1 else 0))
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def as_dict(df):
    return {bytes(r.key): (bytes(r.val), r.seq) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_views(spark, seed):
    rows = history(seed)
    log = frame(spark, rows).cache()
    for w, now in ((LATEST, 0), (30, 0), (LATEST, 60), (40, 35)):
        assert as_dict(resolve(log, w, now)) == model.view(rows, w, now)
    whole = model.view(rows)
    assert as_dict(resolve(log, start=b"a\x00", end=b"\x80")) == {k: v for k, v in whole.items() if b"a\x00" <= k < b"\x80"}
    assert as_dict(resolve(log, tombstones="sweep")) == whole


def test_each_rule_alone(spark):
    put = lambda seq, key, val=b"v", expire=0: model.Row(seq, PUT_TTL if expire else PUT, key, val, expire)
    rows = [put(1, b"k"), put(2, b"k", b"", 10), put(3, b"d"), model.Row(4, DELETE, b"d", None), put(5, b"r"), put(6, b"s"), model.Row(7, RANGE_DELETE, b"r", b"s"), put(0, b"zero"), put(8, b"e", b""), model.Row(9, RANGE_DELETE, b"s", b"a")]
    log = frame(spark, rows)
    assert as_dict(resolve(log)) == {b"k": (b"", 2), b"s": (b"v", 6), b"e": (b"", 8)}
    assert b"k" in as_dict(resolve(log, now=9)) and b"k" not in as_dict(resolve(log, now=10))  # expired at its tick, and no older version
    assert as_dict(resolve(log, 3))[b"d"] == (b"v", 3)
    tie = frame(spark, [put(5, b"t"), model.Row(5, RANGE_DELETE, b"t", b"u")])
    assert as_dict(resolve(tie)) == {b"t": (b"v", 5)}


@pytest.mark.parametrize("seed", range(2))
def test_merge_of_nodes(spark, seed):
    rows = history(seed + 50, 50, 3)
    got = {bytes(r.key): (bytes(r.val), r.node_id, r.seal_wall, r.seq) for r in resolve_merged(frame(spark, rows)).collect()}
    assert got == model.merged(rows)


def test_a_cycle_of_the_pairwise_rule_has_one_answer(spark):
    rows = [model.Row(9, PUT, b"k", b"1", 0, 7, 50), model.Row(8, PUT, b"k", b"2", 0, 7, 900), model.Row(1, PUT, b"k", b"3", 0, 9, 100)]
    assert bytes(resolve_merged(frame(spark, rows)).first().val) == b"3"


def test_reads_in_order(spark):
    view = spark.createDataFrame([(k, k, i) for i, k in enumerate(KEYS)], "key binary, val binary, seq long").repartition(3)
    names = lambda d: [bytes(r.key) for r in d.collect()]
    assert names(scan.ordered(view)) == sorted(KEYS) and names(scan.ordered(view, True)) == sorted(KEYS, reverse=True)
    assert sorted(names(scan.scan(view, b"a", b"b"))) == [b"a", b"a\x00", b"ab"] and names(scan.scan(view, b"b", b"a")) == []
    assert sorted(names(scan.reverse_scan(view, b"ab", b"a"))) == [b"a\x00", b"ab"] and len(names(scan.reverse_scan(view, b""))) == len(KEYS)
    assert sorted(names(scan.prefix_scan(view, b"a"))) == [b"a", b"a\x00", b"ab"] and sorted(names(scan.prefix_scan(view, b"\xff"))) == [b"\xff", b"\xff\xff"]
    assert names(scan.page(view, 2, b"a")) == [b"a\x00", b"ab"] and names(scan.page(view, 2, b"b", True)) == [b"ab", b"a\x00"]
    assert names(scan.first(view)) == [b"\x00"] and names(scan.last(view)) == [b"\xff\xff"] and names(scan.seek(view, b"ac")) == [b"b"]
    for bad in (lambda: scan.scan(view, b"a", b""), lambda: scan.get(view, b"")):
        with pytest.raises(InvalidMutation):
            bad()
    found = {bytes(r.key): r.found for r in scan.look_up(spark.createDataFrame([(b"a",), (b"zz",)], "key binary"), view).collect()}
    assert found == {b"a": True, b"zz": False}


def test_key_arithmetic(spark):
    assert keys.prefix_end(b"a\xff\xff") == b"b" and keys.prefix_end(b"\xff") is None and keys.prefix_end("a") == "b"
    assert keys.successor(b"a", 2) == b"a\0" and keys.successor(b"a\xff", 2) == b"b"
    row = spark.range(1).select(keys.recorder_key(F.lit(258).cast("long"), F.lit("r"), F.lit(3)).alias("k")).select("k", keys.tick_of(F.col("k")), keys.key_kind(F.col("k")), keys.key_number(F.col("k"))).first()
    assert bytes(row[0]) == b"\0\0\0\0\0\0\x01\x02r\x03" and tuple(row[1:]) == (258, "r", 3)
    assert spark.range(1).select(keys.temperature(F.unhex(F.lit("51b9006109b86782")))).first()[0] == pytest.approx(25.89)


@pytest.mark.parametrize("seed", range(2))
def test_compaction_changes_no_view(spark, seed):
    rows = history(seed + 20)
    snaps, purge = [15, 40], 25
    log = frame(spark, rows).select("seq", "op", "key", "val", "expire_at").cache()
    small = retention.compact(log, snaps, purge).cache()
    assert small.count() < log.count()
    for w in (LATEST, *snaps):
        for now in (purge, 70):
            assert as_dict(resolve(small, w, now)) == model.view(rows, w, now)
    kept = retention.keep_set(read(log)[0], snaps)
    by = {}
    for r in kept.collect():
        by.setdefault(bytes(r.key), set()).add(r.seq)
    assert by == {k: model.kept([r.seq for r in v if r.op != RANGE_DELETE], snaps) for k, v in model.by_key([r for r in rows if r.op != RANGE_DELETE]).items()}


def test_tombstones_wait_for_what_lies_outside(spark):
    rows = [model.Row(5, PUT, b"k", b"v"), model.Row(9, DELETE, b"k", None), model.Row(10, RANGE_DELETE, b"x", b"z")]
    log = frame(spark, rows).select("seq", "op", "key", "val", "expire_at")
    outside = lambda *r: spark.createDataFrame([r], "node_id long, seal_wall long, min_seq long")
    left = lambda **k: sorted(r.seq for r in retention.compact(log, [], **k).collect())
    assert left() == [] and left(bottommost=False) == [9, 10]
    assert left(outside=outside(0, 0, 4)) == [9, 10] and left(outside=outside(0, 0, 10)) == [10] and left(outside=outside(3, 5, 1), node_id=0, wall=9) == [9, 10]
    assert left(outside=outside(3, 50, 1), node_id=0, wall=9) == []
    assert sorted(r.seq for r in retention.compact(log, [9]).collect()) == [9, 10]


def test_range_shapes(spark):
    ranges = spark.createDataFrame([("a", "c", 1), ("c", "d", 1), ("f", "g", 1), ("a", "b", 2), ("f", "g", 9)], "start string, end string, seq long")
    rows = lambda d: sorted(map(tuple, d.select("start", "end", "seq").collect()))
    assert rows(tombstones.coalesce(ranges)) == [("a", "b", 2), ("a", "d", 1), ("f", "g", 1), ("f", "g", 9)]
    assert rows(tombstones.clip(ranges, "b", "f")) == [("b", "c", 1), ("c", "d", 1)]
    assert rows(tombstones.unshadowed(ranges, [])) == [("a", "b", 2), ("a", "c", 1), ("c", "d", 1), ("f", "g", 9)]
    assert ("f", "g", 1) in rows(tombstones.unshadowed(ranges, [5])) and ("f", "g", 1) not in rows(tombstones.unshadowed(ranges, [9]))


def test_fingerprints(spark):
    assert model.fingerprint([(b"ab", b"c")]) == (1, 5201498502206346341) and model.fingerprint([(b"a", b"bc")]) == (1, 5052235181742217723)
    rows = [(k, bytes([i]) * i) for i, k in enumerate(KEYS)]
    view = spark.createDataFrame(rows, "key binary, val binary")
    one = view.repartition(4)
    assert tuple(map(int, fingerprint.total(view).first())) == tuple(map(int, fingerprint.total(one).first())) == model.fingerprint(rows)
    parts = fingerprint.buckets(view, [b"a", b"c", b"\x80"])
    got = {r.bucket: (r["count"], int(r.digest)) for r in parts.collect()}
    cut = lambda a, b: model.fingerprint([r for r in rows if a <= r[0] and (b is None or r[0] < b)])
    assert got == {0: cut(b"", b"a"), 1: cut(b"a", b"c"), 2: cut(b"c", b"\x80"), 3: cut(b"\x80", None)}
    assert tuple(map(int, fingerprint.merge(parts).first())) == model.fingerprint(rows)
    assert tuple(map(int, fingerprint.total(view.limit(0)).first())) == (0, 0)
    assert fingerprint.from_bytes(fingerprint.to_bytes(3, (1 << 64) - 1)) == (3, (1 << 64) - 1)
    with pytest.raises(ValueError):
        fingerprint.buckets(view, [b"b", b"a"])


def test_diff_and_repair(spark):
    left = spark.createDataFrame([(b"a", b"1"), (b"b", b""), (b"c", b"3"), (b"e", b"")], "key binary, val binary")
    right = spark.createDataFrame([(b"a", b"1"), (b"b", b"2"), (b"d", b"4")], "key binary, val binary")
    delta = diffs.diff(left, right)
    assert sorted((r.kind, bytes(r.key)) for r in delta.collect()) == [("Differs", b"b"), ("OnlyLeft", b"c"), ("OnlyLeft", b"e"), ("OnlyRight", b"d")]
    assert diffs.diff(left, diffs.repaired(right, delta)).count() == 0
    assert sorted(map(tuple, diffs.diff_in_buckets(left, right, [b"b", b"c"]).collect())) == sorted(map(tuple, delta.collect()))
    assert diffs.diff(left, left).count() == 0


def test_batches(spark):
    b = Batch(most=4).put(b"a", b"").delete(b"a").put_ttl(b"b", b"x", 0).delete_range(b"b", b"a")
    assert len(b) == 3 and [r.op for r in b.rows(spark, 5).orderBy("seq").collect()] == [PUT, DELETE, PUT]
    for bad in (lambda: Batch().put(b"", b"x"), lambda: Batch(key_max=1).put(b"ab", b""), lambda: Batch(val_max=1).put(b"a", b"ab"), lambda: Batch(most=0).put(b"a", b""), lambda: b.rows(spark, 0)):
        with pytest.raises(InvalidMutation):
            bad()
    rows = spark.createDataFrame([(1, PUT, b"k", None, 0), (2, RANGE_DELETE, b"b", b"a", 0), (3, 9, b"k", b"", 0), (4, PUT, b"", b"", 0), (5, PUT, b"k", b"", 0), (0, PUT, b"k", b"", 0), (None, PUT, b"k", b"", 0)], "seq long, op int, key binary, val binary, expire_at long")
    good, bad_rows = checked(rows)
    assert [r.seq for r in good.collect()] == [5] and bad_rows.count() == 6

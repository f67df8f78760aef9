from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import bins, recorder, retention, scan, tombstones
from tidemark.plans.resolve import resolve

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('log')}/log"
    queries.log_of(spark, SF)[0].write.parquet(path)
    return spark.read.parquet(path)


def test_views_scan_the_log_once(log):
    for df in (resolve(log), resolve(log, 500, 500), scan.reverse_scan(resolve(log), "000020/view"), resolve(log, only=log.select("key").distinct().limit(5))):
        text = plan(df)
        assert text.count("FileScan parquet") <= 2 and "CartesianProduct" not in text
    assert plan(resolve(log)).count("FileScan parquet") == 1


def test_multi_get_narrows_the_log(spark, log):
    text = plan(scan.multi_get(spark.createDataFrame([("000012/view",)], "key string"), log))
    assert text.index("LeftSemi") > text.index("SortAggregate" if "SortAggregate" in text else "HashAggregate")  # below it in the tree


def test_loss_check_joins_by_equality(spark):
    rows = queries.records_of(spark, SF)
    windows = spark.createDataFrame([(40, 43), (42, 2000), (-5, 1), (7, 3), (10_000, 10**9)], "first_tick long, last_tick long")
    got = recorder.losses(recorder.spine(spark, 0, 3000), rows, rows.limit(0), windows)
    text = plan(got)
    assert "CartesianProduct" not in text and "LeftSemi" not in text
    purged = {r.tick for r in got.where("state = 'purged'").collect()}
    whole = {r.tick for r in got.where("state = 'whole'").collect()}
    assert purged == {t for t in range(3001) if t <= 1 or 40 <= t <= 2000} - whole and got.count() == 3001


def _cover(key, ranges):
    return max((s for a, b, s, *_ in ranges if a <= key and (b is None or key < b)), default=None)


def test_pieces_are_disjoint_and_hold_the_newest():
    r = random.Random(5)
    for _ in range(200):
        ranges = []
        for s in range(r.randint(0, 12)):
            a = bytes([r.randrange(20)])
            ranges.append((a, None if r.random() < 0.1 else bytes([a[0] + r.randint(1, 9)]), s))
        edge = [*(x[0] for x in ranges), *(x[1] for x in ranges)]
        found = [(edge[a], edge[b], ranges[i][2]) for a, b, i in tombstones.pieces([x[0] for x in ranges], [x[1] for x in ranges], [x[2] for x in ranges])]
        assert all(x[1] is not None and x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
        for k in range(35):
            here = [s for a, b, s in found if a <= bytes([k]) and (b is None or bytes([k]) < b)]
            assert (here[0] if here else None) == _cover(bytes([k]), ranges) and len(here) <= 1


@pytest.mark.parametrize("how", ["few", "sweep"])
@pytest.mark.parametrize("text", [True, False])
def test_covers_against_all_pairs(spark, how, text):
    r = random.Random(3)
    name = (lambda i: f"k{i:04d}") if text else (lambda i: b"k%04d" % i)
    keys = [name(r.randrange(900)) for _ in range(400)]
    ranges = []
    for s in range(150):
        a = r.randrange(900)
        ranges.append((name(a), name(a + r.choice([1, 5, 60, 800])), s, s % 3, s * 10))
    kind = "string" if text else "binary"
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"key {kind}, n int").repartition(5)
    right = spark.createDataFrame(ranges, f"start {kind}, end {kind}, seq long, node int, wall long").repartition(3)
    got = tombstones.with_cover(left, right.drop("node"), how, carry=["wall"]).collect()
    assert sorted((x.n, x.cover, x.wall) for x in got if x.cover is not None) == sorted((i, c, c * 10) for i, k in enumerate(keys) if (c := _cover(k, ranges)) is not None)
    assert len(got) == 400
    by = tombstones.newest_cover(left.select("key").distinct(), right, how, by=["node"], carry=["wall"]).collect()
    plain = lambda k: k if isinstance(k, str) else bytes(k)
    expected = {(k, m, _cover(k, [x for x in ranges if x[3] == m])) for k in keys for m in range(3)}
    assert {(plain(x.key), x.node, x.cover) for x in by} == {x for x in expected if x[2] is not None}


def test_search(spark):
    r = random.Random(1)
    for n in (0, 1, 15, 16, 17, 300, 5000):
        line = sorted(r.randrange(10_000) for _ in range(n))
        probes = [r.randrange(-5, 10_005) for _ in range(60)] + line[:5] + line[-5:]
        array = F.array(*[F.lit(x) for x in line]) if line else F.array().cast("array<int>")
        table = spark.createDataFrame([(p,) for p in probes], "p int")
        got = table.select("p", bins.search(array, n, F.col("p")).alias("a"), bins.search(array, n, F.col("p"), True).alias("b")).collect()
        assert [(x.a, x.b) for x in got] == [(sum(y <= x.p for y in line), sum(y < x.p for y in line)) for x in got]


def test_ranks_and_seeks(spark):
    r = random.Random(2)
    keys = sorted({f"{r.randrange(5000):05d}" for _ in range(700)})
    view = spark.createDataFrame([(k,) for k in keys], "key string").repartition(6)
    assert sorted((x.rank, x.key) for x in bins.with_rank(view).collect()) == list(enumerate(keys, 1))
    assert sorted((x.rank, x.key) for x in bins.with_rank(view, reverse=True).collect()) == list(enumerate(reversed(keys), 1))
    probes = [f"{r.randrange(5200):05d}" for _ in range(300)] + ["", keys[0], keys[-1], "99999"]
    got = scan.seek_many(spark.createDataFrame([(p,) for p in probes], "probe string"), view).collect()
    assert sorted((x.probe, x.key or "") for x in got) == sorted((p, next((k for k in keys if k >= p), "")) for p in probes)
    assert scan.seek_many(spark.createDataFrame([("a",)], "probe string"), view.limit(0)).collect()[0].key is None


def test_a_hot_key_is_ranked_in_ranges(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, 1) for i in range(1, 2000)]
    table = spark.createDataFrame(rows, "key string, seq long, op int").repartition(4)
    got = {(x.key, x.seq): x.version_rank for x in scan.version_ranks(table).collect()}
    for key in {k for k, *_ in rows}:
        for place, seq in enumerate(sorted((s for k, s, _ in rows if k == key), reverse=True), 1):
            assert got[key, seq] == place
    assert len(got) == len(rows)


def test_keep_sets(spark):
    r = random.Random(4)
    rows = [(f"k{r.randrange(9)}", i, None if i % 5 == 0 else str(i)) for i in range(1, 300)]
    for snaps in ([], [50], [3, 120, 120, 299, 1000]):
        got = retention.keep_set(spark.createDataFrame(rows, "key string, seq long, val string"), snaps).collect()
        expected = set()
        for s in [*snaps, 10**9]:
            newest = {}
            for k, seq, v in rows:
                if seq <= s:
                    newest[k] = (k, seq, v)
            expected |= set(newest.values())
        assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_all_queries_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)

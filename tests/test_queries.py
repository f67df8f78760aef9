from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.queries import ORACLE_SQL, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: All run against their SQL in the driver's check; here, one of each kind.
SOME = [
    "latest_view", "snapshot_timed_view", "point_get", "reverse_scan", "page_after", "covering_tombstones_sweep", "compacted_log", "rdel_coalesce", "batch_sequence", "diff_replica",
    "fingerprint_buckets", "lww_view", "archive_refusals", "loss_check", "gaps", "seek_random",
    "as_of_watermarks", "segment_lookup", "outside_minima", "integrity_report", "order_check", "key_values", "database_summary", "fill_seq", "compact_store",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (bool, int, str)) else int(v)


@pytest.mark.parametrize("name", SOME)
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 41
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_nothing_else_imports_the_llm_subpackage():
    root = os.path.dirname(entry.__file__)
    for folder, _, names in os.walk(f"{root}/tidemark"):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(f"{folder}/{n}") as f:
                        assert "llm" not in f.read()


def test_bounds_reach_the_scan(spark, tmp_path):
    from tidemark.plans.resolve import resolve
    from tidemark.queries import log_of

    log_of(spark, SF)[0].write.parquet(f"{tmp_path}/log")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = resolve(spark.read.parquet(f"{tmp_path}/log"), 500, 0, "000010", "000020")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(seq,500)" in plan and "GreaterThanOrEqual(key,000010)" in plan and "LessThan(key,000020)" in plan


def test_covers_of_more_ranges_than_the_driver_takes(spark, tmp_path):
    from tidemark.operators.tombstones import FEW_RANGES

    kind = "case when id % 5 = 0 then 'error' when id % 5 = 1 then 'click' else 'view' end as event_type"
    spark.range(5 * (FEW_RANGES + 500)).selectExpr("id as event_id", "id div 5 as user_id", kind, "cast(id % 97 as double) as value").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.key, r.cover) for r in QUERIES["covering_tombstones"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["covering_tombstones"]).fetchall()) and len(got) > FEW_RANGES

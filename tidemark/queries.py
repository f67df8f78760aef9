"""Registered queries: each operator over a mutation log, replicas, segments and recorder data derived from the driver's tables.

The derivation is in both SQL dialects; see FIXTURES.md.  Keys are text, which
both engines compare by bytes; the library takes binary keys alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fingerprint
from .functions.fingerprint import value_of
from .functions.keys import decimal_key, key_kind, key_number, object_name, recorder_key, temperature, tick_of
from .operators import diff as diffs
from .operators import recorder, retention, scan, tombstones
from .operators.bins import with_rank
from .plans.groups import complete
from .plans.resolve import newest, read, resolve, resolve_merged
from .plans.scratch import new_path
from .schema import LATEST, Batch, checked, sequenced
from .sources import manifest
from .sources.archive import resurrected
from .sources.store import Store
from .streaming.ingest import append_once

_LOG = """select event_id + 1 as seq,
 cast(case when event_type='error' and event_id % 5 = 0 then 3
      when event_type='error' then 2
      when event_id % 3 = 0 then 4 else 1 end as int) as op,
 case when event_type='error' and event_id % 5 = 0 then lpad(cast(user_id as {STR}),6,'0')
      when event_type='error' then concat(lpad(cast(user_id as {STR}),6,'0'),'/',case event_id % 4 when 0 then 'click' when 1 then 'purchase' when 2 then 'signup' else 'view' end)
      else concat(lpad(cast(user_id as {STR}),6,'0'),'/',event_type) end as key,
 case when event_type='error' and event_id % 5 = 0 then concat(lpad(cast(user_id+1 as {STR}),6,'0'),'/purchase')
      when event_type='error' then cast(null as {STR})
      else cast(cast(round(value*100) as bigint) as {STR}) end as val,
 case when event_type<>'error' and event_id % 3 = 0 then event_id + 1 + 400 else cast(0 as bigint) end as expire_at,
 cast(case when user_id % 2 = 0 then 7 else 9 end as bigint) as node_id,
 cast(floor((event_id + 1) / 1000) as bigint) as seal_wall,
 concat(event_type, '/', lpad(cast(user_id % 25 as {STR}),2,'0')) as shared_key,
 event_id
from events"""
LOG_SQL = "log AS (" + _LOG.replace("{STR}", "VARCHAR") + "), n AS (SELECT max(seq) AS n FROM log)"


def log_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The derived log and its length."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = _LOG.replace("{STR}", "string").split("\nfrom events")[0].removeprefix("select ")
    log = spark.sql(f"select {body} from {{e}}", e=events)
    return log, (events.agg(F.max("event_id")).first()[0] or 0) + 1


def view_sql(w: str = "(SELECT n FROM n)", now: str = "0", src: str = "log", p: str = "v", where: str = "true") -> str:
    """CTEs that end in {p}(key, val, seq), the view of a log at (w, now)."""
    return f"""{p}_p AS (SELECT * FROM {src} WHERE op <> 3 AND seq <= {w} AND {where}),
 {p}_r AS (SELECT key AS s, val AS e, max(seq) AS rseq FROM {src} WHERE op = 3 AND seq <= {w} AND key < val GROUP BY 1, 2),
 {p}_w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {p}_p) x WHERE rn = 1),
 {p}_c AS (SELECT w.key AS ck, max(r.rseq) AS cseq FROM {p}_w w JOIN {p}_r r ON r.s <= w.key AND w.key < r.e GROUP BY w.key),
 {p} AS (SELECT w.key, w.val, w.seq FROM {p}_w w LEFT JOIN {p}_c c ON c.ck = w.key
  WHERE w.op <> 2 AND (c.cseq IS NULL OR c.cseq <= w.seq) AND ({now} = 0 OR w.expire_at = 0 OR w.expire_at > {now}))"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query of (log, n), with its SQL after the log's CTEs, or with WITH of its own."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*log_of(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {LOG_SQL}, {sql}"
        return f

    return register


def table_query(sql: str | None = None):
    """Registers a query of (spark, sf_dir)."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


N, HALF = "(SELECT n FROM n)", "(SELECT n // 2 FROM n)"
SNAPS = "(SELECT n // 4 AS s FROM n UNION ALL SELECT n // 2 FROM n UNION ALL SELECT 3 * n // 4 FROM n)"
ranked = "row_number() over (order by key{}) as rank"  # of the SQL


def snapshots(n: int) -> list[int]:
    return [n // 4, n // 2, 3 * n // 4]


# reads


@query(view_sql() + " SELECT * FROM v")
def latest_view(log, n):
    return resolve(log)


@query(view_sql(now=N) + " SELECT * FROM v")
def timed_view(log, n):
    return resolve(log, now=n)


@query(view_sql(HALF) + " SELECT * FROM v")
def snapshot_view(log, n):
    return resolve(log, n // 2)


@query(view_sql(HALF, HALF) + " SELECT * FROM v")
def snapshot_timed_view(log, n):
    return resolve(log, n // 2, n // 2)


@query(
    ", ".join([view_sql(p="a"), view_sql(HALF, p="b"), view_sql(now=N, p="c"), view_sql(HALF, HALF, p="d")])
    + " "
    + " UNION ALL ".join(f"SELECT '{p}' AS read, key, val, seq FROM {p} WHERE key = '000012/view'" for p in "abcd")
)
def point_get(log, n):
    reads = {"a": {}, "b": {"max_seq": n // 2}, "c": {"now": n}, "d": {"max_seq": n // 2, "now": n // 2}}
    out = None
    for name, at in reads.items():
        row = scan.get(log, "000012/view", **at).select(F.lit(name).alias("read"), "key", "val", "seq")
        out = row if out is None else out.union(row)
    return out


_WANTED = "wanted AS (SELECT DISTINCT concat(lpad(cast(user_id AS VARCHAR),6,'0'),'/',event_type) AS key FROM events)"


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat(lpad(cast(user_id as string),6,'0'),'/',event_type) as key").distinct()


@table_query(f"WITH {LOG_SQL}, {view_sql()}, {_WANTED} SELECT w.key, v.val, v.seq, v.key IS NOT NULL AS found FROM wanted w LEFT JOIN v ON v.key = w.key")
def multi_get(spark, sf_dir):
    return scan.multi_get(_wanted(spark, sf_dir), log_of(spark, sf_dir)[0])


@table_query(f"WITH {LOG_SQL}, {view_sql()}, {_WANTED} SELECT concat(w.key, '?') AS key, v.val, v.seq, v.key IS NOT NULL AS found FROM wanted w LEFT JOIN v ON v.key = concat(w.key, '?')")
def read_missing(spark, sf_dir):
    return scan.multi_get(_wanted(spark, sf_dir).selectExpr("concat(key, '?') as key"), log_of(spark, sf_dir)[0])


_BETWEEN = "key >= '000010' AND key < '000020'"


@query(view_sql() + f" SELECT * FROM v WHERE {_BETWEEN}")
def range_scan(log, n):
    return scan.scan(resolve(log, start="000010", end="000020"), "000010", "000020")


@query(view_sql(HALF) + f" SELECT * FROM v WHERE {_BETWEEN}")
def snapshot_scan(log, n):
    return resolve(log, n // 2, start="000010", end="000020")


@query(view_sql(HALF, HALF) + f" SELECT * FROM v WHERE {_BETWEEN}")
def timed_scan(log, n):
    return resolve(log, n // 2, n // 2, "000010", "000020")


@query(view_sql() + " SELECT * FROM v WHERE starts_with(key, '000012/')")
def prefix_scan(log, n):
    return scan.prefix_scan(resolve(log, start="000012/", end="0000120"), "000012/")


@query(view_sql() + " SELECT key, val, seq, " + ranked.format("") + " FROM v")
def full_scan(log, n):
    return with_rank(resolve(log))


@query(view_sql() + " SELECT key, val, seq, " + ranked.format(" desc") + " FROM v WHERE key <= '000020/view' AND key > '000010/view'")
def reverse_scan(log, n):
    return with_rank(scan.reverse_scan(resolve(log), "000020/view", "000010/view"), reverse=True)


@query(view_sql(HALF, HALF) + " SELECT key, val, seq, " + ranked.format(" desc") + " FROM v WHERE key <= '000020/view' AND key > '000010/view'")
def timed_reverse_scan(log, n):
    return with_rank(scan.reverse_scan(resolve(log, n // 2, n // 2), "000020/view", "000010/view"), reverse=True)


@query(view_sql() + f" SELECT 'up' AS direction, key, val, {ranked.format('')} FROM v WHERE {_BETWEEN} UNION ALL SELECT 'down', key, val, {ranked.format(' desc')} FROM v WHERE {_BETWEEN}")
def store_range(log, n):
    view = scan.scan(resolve(log, start="000010", end="000020"), "000010", "000020")
    up, down = with_rank(view), with_rank(view, reverse=True)
    return up.selectExpr("'up' as direction", "key", "val", "rank").union(down.selectExpr("'down'", "key", "val", "rank"))


@query(view_sql(HALF) + " (SELECT key, val, seq FROM v ORDER BY key LIMIT 10) UNION ALL (SELECT key, val, seq FROM v ORDER BY key DESC LIMIT 10)")
def page_scan(log, n):
    view = resolve(log, n // 2)
    return scan.page(view, 10).union(scan.page(view, 10, reverse=True))


@query(view_sql() + " (SELECT key, val, seq FROM v WHERE key > '000015/click' ORDER BY key LIMIT 10) UNION ALL (SELECT key, val, seq FROM v WHERE key < '000015/click' ORDER BY key DESC LIMIT 10)")
def page_after(log, n):
    view = resolve(log)
    return scan.page(view, 10, "000015/click").union(scan.page(view, 10, "000015/click", reverse=True))


@query(view_sql() + " SELECT * FROM v ORDER BY key LIMIT 1")
def first_key(log, n):
    return scan.first(resolve(log))


@query(view_sql() + " SELECT * FROM v ORDER BY key DESC LIMIT 1")
def last_key(log, n):
    return scan.last(resolve(log))


@query(view_sql() + " SELECT * FROM v WHERE key >= '000011/d' ORDER BY key LIMIT 1")
def seek_ge(log, n):
    return scan.seek(resolve(log, start="000011/d"), "000011/d")


@query("x AS (SELECT 1) SELECT key, seq, op, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version_rank FROM log WHERE op <> 3")
def version_ranks(log, n):
    return scan.version_ranks(log)


@query("x AS (SELECT 1) SELECT key, seq, op, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS place FROM log WHERE seq > 7 * ((SELECT n FROM n) // 8) AND op <> 3")
def memtable_scan(log, n):
    return scan.memtable(log.where(F.col("seq") > 7 * (n // 8)))


@query(f"s AS {SNAPS} SELECT s.s AS watermark, key, arg_max(op, seq) AS op, max(seq) AS seq FROM log JOIN s ON seq <= s.s WHERE op <> 3 GROUP BY 1, 2")
def as_of_watermarks(log, n):
    return scan.as_of(log, snapshots(n))


@query("p AS (SELECT DISTINCT key FROM log WHERE op <> 3) SELECT p.key, max(r.seq) AS cover FROM p JOIN log r ON r.op = 3 AND r.key <= p.key AND p.key < r.val GROUP BY p.key")
def covering_tombstones(log, n):
    points, ranges = read(log)
    return tombstones.newest_cover(points.select("key").distinct(), ranges)


@query("p AS (SELECT DISTINCT key FROM log WHERE op <> 3) SELECT p.key, max(r.seq) AS cover FROM p JOIN log r ON r.op = 3 AND r.key <= p.key AND p.key < r.val GROUP BY p.key")
def covering_tombstones_sweep(log, n):
    points, ranges = read(log)
    return tombstones.newest_cover(points.select("key").distinct(), ranges, "sweep")


@query("x AS (SELECT 1) SELECT key, max(seq) AS seq, count(*) AS versions FROM log WHERE op <> 3 GROUP BY key")
def merge_sources(log, n):
    cut = 7 * (n // 8)
    both = log.where(F.col("seq") > cut).unionByName(log.where(F.col("seq") <= cut)).where("op <> 3")
    return both.groupBy("key").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("versions"))


@query("x AS (SELECT 1) SELECT key, arg_max(op, seq) AS op, arg_max(expire_at, seq) AS expire_at, max(seq) AS seq FROM log WHERE op <> 3 GROUP BY key")
def winners(log, n):
    return newest(read(log)[0]).select("key", "op", "expire_at", "seq")


# writing, as the view that results


@query("x AS (SELECT 1) SELECT CAST(op AS INTEGER) AS op, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, count(val) AS with_value, max(expire_at) AS last_expiry FROM log WHERE NOT (op = 3 AND key >= val) GROUP BY op")
def mutations(log, n):
    good, _ = checked(log.where("seq > 0"))
    return good.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("val").alias("with_value"), F.max("expire_at").alias("last_expiry"))


@query("x AS (SELECT 1) SELECT seq, 'key too large' AS fault FROM log WHERE length(key) > 13 AND NOT (op = 3 AND key >= val) UNION ALL SELECT seq, 'empty range' FROM log WHERE op = 3 AND key >= val")
def rejected_mutations(log, n):
    return checked(log, key_max=13)[1].select("seq", "fault")


@query("x AS (SELECT 1) SELECT seq, lpad(CAST(seq AS VARCHAR), 16, '0') AS decimal_key, seq AS tick, 'r' AS kind, CAST(seq % 4 AS INTEGER) AS number, concat('tables/', lpad(CAST(seq AS VARCHAR), 10, '0')) AS object_name FROM log")
def key_codecs(log, n):
    key = recorder_key(F.col("seq"), F.lit("r"), F.expr("seq % 4"))
    return log.select("seq", decimal_key(F.col("seq")).alias("decimal_key"), tick_of(key).alias("tick"), key_kind(key).alias("kind"), key_number(key).alias("number"), object_name(F.col("seq")).alias("object_name"))


# retention

_KEPT = "SELECT * FROM (SELECT *, lag(seq) OVER (PARTITION BY {by} ORDER BY seq DESC) AS newer FROM {src}) x WHERE newer IS NULL OR EXISTS (SELECT 1 FROM " + SNAPS + " s WHERE x.seq <= s.s AND s.s < x.newer)"


@query(f"p AS (SELECT key, seq, op FROM log WHERE op <> 3), k AS ({_KEPT.format(by='key', src='p')}) SELECT key, seq, op FROM k")
def keep_set(log, n):
    return retention.keep_set(log.where("op <> 3").select("key", "seq", "op"), snapshots(n))


_PURGED = f"CASE WHEN expire_at <> 0 AND expire_at <= {HALF} THEN 2 ELSE op END AS op, CASE WHEN expire_at <> 0 AND expire_at <= {HALF} THEN NULL ELSE val END AS val, CASE WHEN expire_at <> 0 AND expire_at <= {HALF} THEN 0 ELSE expire_at END AS expire_at"


@query(f"x AS (SELECT 1) SELECT key, seq, {_PURGED} FROM log WHERE op <> 3")
def ttl_purge(log, n):
    return retention.purge(log.where("op <> 3"), n // 2).select("key", "seq", "op", "val", "expire_at")


_FLOOR = "(SELECT n // 4 FROM n)"
_COMPACTED = f"""p AS (SELECT key, seq, {_PURGED} FROM log WHERE op <> 3),
 r AS (SELECT key AS s, val AS e, seq FROM log WHERE op = 3 AND key < val),
 k AS ({_KEPT.format(by="key", src="p")}),
 h AS (SELECT k.key, k.seq FROM k JOIN r ON r.s <= k.key AND k.key < r.e AND r.seq <= {_FLOOR} GROUP BY 1, 2 HAVING max(r.seq) > k.seq),
 k2 AS (SELECT k.* FROM k LEFT JOIN h ON h.key = k.key AND h.seq = k.seq WHERE h.key IS NULL),
 k3 AS (SELECT * FROM (SELECT *, max(seq) OVER (PARTITION BY key) AS top FROM k2) x WHERE NOT (op = 2 AND seq = top AND seq < {_FLOOR})),
 rk AS ({_KEPT.format(by="s, e", src="r2")}),
 c AS (SELECT seq, op, key, val, expire_at FROM k3 UNION ALL SELECT seq, 3, s, e, 0 FROM rk)""".replace(" rk AS", f" r2 AS (SELECT * FROM r WHERE NOT seq < {_FLOOR}), rk AS")


def _compacted(log: DataFrame, n: int) -> DataFrame:
    return retention.compact(log.select("seq", "op", "key", "val", "expire_at"), snapshots(n), n // 2)


@query(f"{_COMPACTED} SELECT seq, op, key, val, expire_at FROM c")
def compacted_log(log, n):
    return _compacted(log, n)


@query(view_sql(now=N) + " SELECT * FROM v")
def compacted_view(log, n):
    return resolve(_compacted(log, n), now=n)


@query(view_sql(HALF, HALF) + " SELECT * FROM v")
def compacted_snapshot_view(log, n):
    return resolve(_compacted(log, n), n // 2, n // 2)


_GROUPED = "g AS (SELECT key AS s, val AS e, (seq // 400) AS seq FROM log WHERE op = 3 AND key < val)"


@query(
    f"""{_GROUPED}, m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY seq ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS new FROM g),
 i AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
 SELECT min(s) AS start, max(e) AS "end", seq FROM i GROUP BY seq, island"""
)
def rdel_coalesce(log, n):
    return tombstones.coalesce(log.where("op = 3").selectExpr("key as start", "val as end", "seq div 400 as seq"))


@query("""r AS (SELECT greatest(key, '000005') AS s, least(val, '000050') AS e, seq FROM log WHERE op = 3) SELECT s AS start, e AS "end", seq FROM r WHERE s < e""")
def rdel_clip(log, n):
    return tombstones.clip(read(log)[1].select("start", "end", "seq"), "000005", "000050")


@query(f"""r AS (SELECT key AS s, val AS e, seq FROM log WHERE op = 3 AND key < val), k AS ({_KEPT.format(by="s, e", src="r")}) SELECT s AS start, e AS "end", seq FROM k""")
def rdel_shadow(log, n):
    return tombstones.unshadowed(read(log)[1].select("start", "end", "seq"), snapshots(n))


# writing


@query("x AS (SELECT 1) SELECT seq + 100 AS seq, op, key, val, expire_at, (seq - 1) // 5 AS batch_id FROM log WHERE NOT (op = 3 AND key >= val)")
def batch_sequence(log, n):
    rows = log.where("not (op = 3 and key >= val)").withColumn("batch_id", F.expr("(seq - 1) div 5"))
    ops = F.transform(F.array_sort(F.collect_list(F.struct("seq", "op", "key", "val", "expire_at"))), lambda x: F.struct(x["op"].alias("op"), x["key"].alias("key"), x["val"].alias("val"), x["expire_at"].alias("expire_at")))
    return sequenced(rows.groupBy("batch_id").agg(ops.alias("ops")), 101)


@query("g AS (SELECT *, (seq - 1) // 5 AS batch_id, (seq - 1) % 5 AS pos FROM log WHERE seq % 35 <> 0 AND seq % 77 <> 3) SELECT seq, key, batch_id FROM g WHERE batch_id IN (SELECT batch_id FROM g GROUP BY 1 HAVING count(*) = 5)")
def batch_complete(log, n):
    rows = log.where("seq % 35 <> 0 and seq % 77 <> 3").selectExpr("seq", "key", "(seq - 1) div 5 as batch_id", "(seq - 1) % 5 as pos", "(seq - 1) % 5 = 4 as closes")
    return complete(rows)[0].select("seq", "key", "batch_id")


# replicas

_RIGHT = "l2 AS (SELECT * FROM log WHERE seq % 97 <> 0)"


def _replicas(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    return resolve(log).select("key", "val"), resolve(log.where("seq % 97 <> 0")).select("key", "val")


_BOTH = f"{view_sql(p='a')}, {_RIGHT}, {view_sql(src='l2', p='b')}"


@query(
    _BOTH
    + """ SELECT CASE WHEN b.key IS NULL THEN 'OnlyLeft' WHEN a.key IS NULL THEN 'OnlyRight' ELSE 'Differs' END AS kind, coalesce(a.key, b.key) AS key, a.val AS left_val, b.val AS right_val
 FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.val IS DISTINCT FROM b.val"""
)
def diff_replica(log, n):
    return diffs.diff(*_replicas(log))


@query(view_sql() + " SELECT key, val FROM v")
def repair_replica(log, n):
    left, right = _replicas(log)
    return diffs.repaired(right, diffs.diff(left, right))


_SPLITS = ["000100", "000200", "000300", "000400", "000900"]


@query(
    _BOTH
    + """ SELECT CASE WHEN b.key IS NULL THEN 'OnlyLeft' WHEN a.key IS NULL THEN 'OnlyRight' ELSE 'Differs' END AS kind, coalesce(a.key, b.key) AS key, a.val AS left_val, b.val AS right_val
 FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.val IS DISTINCT FROM b.val"""
)
def anti_entropy(log, n):
    return diffs.diff_in_buckets(*_replicas(log), _SPLITS)


@query(_BOTH + " (SELECT key, val, 'left' AS side FROM (SELECT key, val FROM a EXCEPT ALL SELECT key, val FROM b) x) UNION ALL (SELECT key, val, 'right' FROM (SELECT key, val FROM b EXCEPT ALL SELECT key, val FROM a) y)")
def symmetric_difference(log, n):
    left, right = _replicas(log)
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


# FNV-1a over length-prefixed key and value, in unsigned 128-bit arithmetic; texts are ASCII here
_M64 = "18446744073709551616::UHUGEINT"
_FNV = f"list_reduce(list_concat([14695981039346656037::UHUGEINT], list_concat(list_concat([len(key)::UHUGEINT, 0, 0, 0, 0, 0, 0, 0], list_transform(string_split(key, ''), lambda c: ascii(c)::UHUGEINT)), list_concat([len(val)::UHUGEINT, 0, 0, 0, 0, 0, 0, 0], list_transform(string_split(val, ''), lambda c: ascii(c)::UHUGEINT)))), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_M64})"
_HASHED = f"""h0 AS (SELECT key, {_FNV} AS h FROM v),
 h1 AS (SELECT key, (xor(h, h // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {_M64} AS h FROM h0),
 h2 AS (SELECT key, (xor(h, h // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {_M64} AS h FROM h1),
 h3 AS (SELECT key, xor(h, h // 2147483648::UHUGEINT) AS h FROM h2)"""
_DIGEST = "lpad(printf('%x', CAST(sum(CAST(h AS HUGEINT)) % 18446744073709551616 AS UBIGINT)), 16, '0')"


def _hex(view: DataFrame) -> DataFrame:
    """The digest as 16 hexadecimal digits."""
    whole = F.col("digest").cast("decimal(38,0)")
    signed = F.when(whole >= F.lit(str(1 << 63)).cast("decimal(38,0)"), whole - F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(whole).cast("long")
    return view.withColumn("digest", F.lower(F.lpad(F.hex(signed), 16, "0")))


@query(f"{view_sql()}, {_HASHED} SELECT count(*) AS count, lower({_DIGEST}) AS digest FROM h3")
def fingerprint_total(log, n):
    return _hex(fingerprint.total(resolve(log)))


_BUCKET = " + ".join(f"CASE WHEN key >= '{s}' THEN 1 ELSE 0 END" for s in _SPLITS)


@query(
    f"""{view_sql()}, {_HASHED}, b AS (SELECT {_BUCKET} AS bucket, h FROM h3), s AS (SELECT bucket, count(*) AS count, lower({_DIGEST}) AS digest FROM b GROUP BY 1)
 SELECT CAST(r.range AS INTEGER) AS bucket, coalesce(s.count, 0) AS count, coalesce(s.digest, '0000000000000000') AS digest FROM range(6) r LEFT JOIN s ON s.bucket = r.range"""
)
def fingerprint_buckets(log, n):
    return _hex(fingerprint.buckets(resolve(log), _SPLITS))


@query(f"{view_sql()}, {_HASHED} SELECT count(*) AS count, lower({_DIGEST}) AS digest FROM h3")
def fingerprint_merge(log, n):
    return _hex(fingerprint.merge(fingerprint.buckets(resolve(log), _SPLITS)))


@query(_BOTH + f", x AS (SELECT {_BUCKET} AS bucket, key, val FROM a), y AS (SELECT {_BUCKET} AS bucket, key, val FROM b), d AS ((SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL (SELECT * FROM y EXCEPT SELECT * FROM x)) SELECT DISTINCT CAST(bucket AS INTEGER) AS bucket FROM d")
def unequal_buckets(log, n):
    return diffs.unequal_buckets(*_replicas(log), _SPLITS)


_SHARED = "s AS (SELECT seq, op, CASE WHEN op = 3 THEN substr(shared_key, 1, length(shared_key) - 2) || '05' ELSE shared_key END AS key, CASE WHEN op = 3 THEN substr(shared_key, 1, length(shared_key) - 2) || '09' ELSE val END AS val, expire_at, node_id, seal_wall FROM log)"


@query(
    f"""{_SHARED}, k AS (SELECT DISTINCT key FROM s WHERE op <> 3),
 c AS (SELECT key, node_id, seal_wall, seq, 1 AS pt, op, val FROM s WHERE op <> 3 UNION ALL SELECT k.key, r.node_id, r.seal_wall, r.seq, 0, 2, NULL FROM k JOIN s r ON r.op = 3 AND r.key <= k.key AND k.key < r.val),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, node_id ORDER BY seq DESC, pt DESC) AS rn FROM c) x WHERE rn = 1),
 b AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY key ORDER BY seal_wall DESC, node_id DESC) AS rn FROM a) x WHERE rn = 1)
 SELECT key, val, node_id, seal_wall, seq FROM b WHERE op <> 2"""
)
def lww_view(log, n):
    spans = F.expr("substring(shared_key, 1, length(shared_key) - 2)")
    rows = log.withColumns({"key": F.when(F.col("op") == 3, F.concat(spans, F.lit("05"))).otherwise(F.col("shared_key")), "val": F.when(F.col("op") == 3, F.concat(spans, F.lit("09"))).otherwise(F.col("val"))})
    return resolve_merged(rows.select("seq", "op", "key", "val", "expire_at", "node_id", "seal_wall"))


# segments

_SEGMENTS = "m AS (SELECT (seq - 1) // ((SELECT n FROM n) // 8) AS segment_id, min(key) AS first_key, max(CASE WHEN op = 3 THEN val ELSE key END) AS last_key, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS entry_count, count(CASE WHEN op = 3 THEN 1 END) AS rdel_count FROM log WHERE seq <= 7 * ((SELECT n FROM n) // 8) GROUP BY 1)"


def _segmented(log: DataFrame, n: int) -> DataFrame:
    at = F.expr(f"(seq - 1) div {max(1, n // 8)}")
    return log.withColumn("segment_id", F.when(F.col("seq") <= 7 * (n // 8), at))


def _manifest(log: DataFrame, n: int) -> DataFrame:
    return manifest.segment_stats(_segmented(log, n).where("segment_id is not null"))


@query(f"{_SEGMENTS} SELECT * FROM m")
def segment_stats(log, n):
    return _manifest(log, n)


@query(f"{_SEGMENTS} SELECT a.segment_id, b.segment_id AS other FROM m a JOIN m b ON a.segment_id < b.segment_id AND a.first_key <= b.last_key AND b.first_key <= a.last_key")
def segment_overlaps(log, n):
    return manifest.overlapping(_manifest(log, n))


@query(f"{_SEGMENTS} SELECT segment_id FROM m WHERE first_key < '000020' AND last_key >= '000010' AND min_seq <= {HALF}")
def segment_prune(log, n):
    return _manifest(log, n).where(manifest.reaches("000010", "000020", n // 2)).select("segment_id")


@query(f"{_SEGMENTS} SELECT segment_id % 2 AS level, count(*) AS segments, CAST(sum(entry_count) AS BIGINT) AS entries, CAST(sum(rdel_count) AS BIGINT) AS rdels, min(min_seq) AS min_seq, max(max_seq) AS max_seq FROM m GROUP BY 1")
def level_stats(log, n):
    return manifest.level_stats(_manifest(log, n).withColumn("level", F.expr("segment_id % 2")))


@query(f"{_SEGMENTS} SELECT (SELECT min(min_seq) FROM m WHERE segment_id <> 3 AND segment_id % 2 = 1) AS same_min_seq, (SELECT min(segment_id * 10 + 7) FROM m WHERE segment_id % 2 = 0) AS foreign_min")
def outside_minima(log, n):
    outside = _manifest(log, n).where("segment_id <> 3").selectExpr("segment_id % 2 as node_id", "segment_id * 10 + 7 as seal_wall", "min_seq")
    return retention.outside_minima(outside, node_id=1).select(F.col("same").alias("same_min_seq"), F.col("foreign.seal_wall").alias("foreign_min"))


@query(
    """k AS (SELECT DISTINCT key FROM log WHERE op <> 3), s AS (SELECT * FROM log WHERE op <> 3 AND (seq - 1) // ((SELECT n FROM n) // 8) = 2),
 w AS (SELECT key, arg_max(op, seq) AS op, arg_max(val, seq) AS val, max(seq) AS seq FROM s GROUP BY key)
 SELECT k.key, CASE WHEN w.key IS NULL THEN 'missing' WHEN w.op = 2 THEN 'tombstone' ELSE 'value' END AS found, CAST(w.op AS INTEGER) AS op, w.seq, CASE WHEN w.op <> 2 THEN w.val END AS val FROM k LEFT JOIN w ON w.key = k.key"""
)
def segment_lookup(log, n):
    return scan.lookup(_segmented(log, n).where("segment_id = 2"), read(log)[0].select("key").distinct())


_MARK = f"(3 * ({N} // 8))"


@query(f"x AS (SELECT 1), l3 AS (SELECT * FROM log WHERE (seq - 1) // ({N} // 8) <> 2), {view_sql(_MARK, p='a')}, {view_sql(_MARK, src='l3', p='b')} SELECT {_MARK} AS watermark, b.key FROM b LEFT JOIN a ON a.key = b.key WHERE a.key IS NULL")
def archive_refusals(log, n):
    return resurrected(_segmented(log, n), 2, [3 * (n // 8)])


@query(view_sql() + " SELECT count(*) AS entries, CAST(sum(length(key) + length(val)) AS BIGINT) AS bytes FROM v")
def scan_checksum(log, n):
    return scan.checksum(resolve(log))


#: The table of CRC-32 by its rule, eight steps for each byte.
_CRC = """t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) AS t)"""


@query(f"{view_sql()}, {_CRC} SELECT key, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(val, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t.t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295::BIGINT) AS crc FROM v, t")
def crc32_values(log, n):
    return resolve(log).select("key", F.crc32(F.col("val").cast("binary")).alias("crc"))


@query(f"{view_sql(HALF, p='a')}, {_COMPACTED}, {view_sql(HALF, src='c', p='b')} SELECT (SELECT count(*) FROM a) AS before, (SELECT count(*) FROM b) AS after, (SELECT count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = a.key AND b.val = a.val)) AS lost")
def snapshot_after_purge(log, n):
    before = resolve(log, n // 2).select("key", "val")
    after = resolve(_compacted(log, n), n // 2).select("key", "val")
    lost = before.join(after, ["key", "val"], "left_anti")
    one = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return one(before, "before").crossJoin(one(after, "after")).crossJoin(one(lost, "lost"))  # one row each


@query(", ".join([view_sql(p="a"), view_sql(now=N, p="b")]) + " SELECT a.key, b.key IS NOT NULL AS fresh FROM a LEFT JOIN b ON a.key = b.key")
def ttl_probes(log, n):
    fresh = resolve(log, now=n).select("key", F.lit(True).alias("fresh"))
    return resolve(log).select("key").join(fresh, "key", "left").select("key", F.coalesce("fresh", F.lit(False)).alias("fresh"))


# recorder

_RECORDS = """SELECT event_id {DIV} 5 AS tick, CASE WHEN event_id % 5 < 4 THEN 'r' WHEN event_type = 'purchase' THEN 'e' ELSE 't' END AS kind,
 CAST(CASE WHEN event_id % 5 < 4 THEN event_id % 5 ELSE 0 END AS INT) AS id, value AS val,
 CASE WHEN event_id % 5 = 4 AND event_type <> 'purchase' THEN event_id {DIV} 5 + 64 ELSE CAST(0 AS BIGINT) END AS expire_at, event_id % 97 <> 0 AS intact, event_id
FROM events WHERE NOT (event_id % 5 < 4 AND (event_type = 'error' OR (event_id {DIV} 5) % 100 BETWEEN 40 AND 43))"""
_R = f"WITH r AS ({_RECORDS.replace('{DIV}', '//')})"
_BITS = "c AS (SELECT tick, bit_or(CASE kind WHEN 'r' THEN 1 << id WHEN 'e' THEN 16 ELSE 0 END) AS bits FROM r GROUP BY tick)"
_CLASS = "CASE WHEN bits & 15 = 15 THEN 'whole' WHEN bits & 15 = 0 THEN 'none' WHEN (bits & 15) & ((bits & 15) + 1) = 0 OR ((bits & 15) | ((bits & 15) - 1)) = 15 THEN 'split' ELSE 'torn' END"


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_RECORDS.replace("{DIV}", "div").replace("FROM events", "FROM {e}"), e=events)


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as stored: key, the value's bytes, wrong for one event in 97, and where each lies, 1,000 events a segment."""
    rows = records_of(spark, sf_dir).withColumn("key", recorder_key(F.col("tick"), F.col("kind"), F.col("id")))
    wrong = F.expr("event_id % 97 = 0")
    own = value_of(F.when(wrong, F.concat("key", "key")).otherwise(F.col("key")))
    return rows.withColumns({"stored": own, "segment_id": F.expr("event_id div 1000"), "pos": F.col("event_id")}).drop("intact")


def _now(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] // 5


@table_query(f"{_R}, {_BITS} SELECT tick, bits FROM c")
def coverage_bits(spark, sf_dir):
    return recorder.coverage(records_of(spark, sf_dir))


@table_query(f"{_R}, {_BITS} SELECT tick, {_CLASS} AS class FROM c")
def frame_class(spark, sf_dir):
    return recorder.coverage(records_of(spark, sf_dir)).select("tick", recorder.frame_class(F.col("bits")).alias("class"))


_NOW = "(SELECT max(event_id) // 5 FROM events)"


@table_query(
    f"{_R} SELECT tick, "
    + ", ".join(f"max(CASE WHEN kind = 'r' AND id = {i} THEN val END) AS sensor{i}" for i in range(4))
    + f", bool_or(kind = 'e') AS event, bool_or(kind = 't') AS trace, bool_or(kind = 't' AND (expire_at = 0 OR expire_at > {_NOW})) AS trace_live FROM r GROUP BY tick"
)
def frame_pivot(spark, sf_dir):
    return recorder.frames(records_of(spark, sf_dir), _now(spark, sf_dir))


@table_query(f"{_R}, t AS (SELECT DISTINCT tick FROM r WHERE kind = 'r'), g AS (SELECT tick, lag(tick) OVER (ORDER BY tick) AS before FROM t) SELECT before + 1 AS first_tick, tick - 1 AS last_tick FROM g WHERE tick > before + 1")
def gaps(spark, sf_dir):
    return recorder.gaps(records_of(spark, sf_dir).where("kind = 'r'"))


@table_query(f"{_R} SELECT id, count(val) AS n, min(val) AS least, max(val) AS largest, round(avg(val), 6) AS mean FROM r WHERE kind = 'r' GROUP BY id")
def sensor_stats(spark, sf_dir):
    return recorder.sensor_stats(records_of(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@table_query(f"{_R} SELECT CAST(sum(CASE WHEN expire_at = 0 OR expire_at > {_NOW} THEN 1 ELSE 0 END) AS BIGINT) AS live, count(*) AS total FROM r WHERE kind = 't' AND tick > (SELECT max(tick) FROM r) - 200")
def live_traces(spark, sf_dir):
    return recorder.trace_counts(records_of(spark, sf_dir), _now(spark, sf_dir))


_ORDERED = """o AS (SELECT count(*) AS out_of_order FROM (SELECT tick, kind, id, lag(tick) OVER w AS t, lag(kind) OVER w AS k, lag(id) OVER w AS i FROM r WINDOW w AS (PARTITION BY event_id // 1000 ORDER BY event_id)) x
 WHERE t IS NOT NULL AND (tick < t OR tick = t AND (kind < k OR kind = k AND id <= i)))"""


@table_query(
    f"""{_R}, {_BITS.replace("FROM r GROUP", "FROM r WHERE kind = 'r' GROUP")}, k AS (SELECT {_CLASS} AS c, bit_count(bits & 15) AS n FROM c), {_ORDERED}
 SELECT count(*) AS entries, CAST(sum(CASE WHEN kind='r' THEN 1 ELSE 0 END) AS BIGINT) AS readings, CAST(sum(CASE WHEN kind='e' THEN 1 ELSE 0 END) AS BIGINT) AS events, CAST(sum(CASE WHEN kind='t' THEN 1 ELSE 0 END) AS BIGINT) AS traces, CAST(sum(CASE WHEN intact THEN 0 ELSE 1 END) AS BIGINT) AS bad_values,
 (SELECT count(*) FROM k WHERE c = 'whole') AS whole, (SELECT count(*) FROM k WHERE c = 'split') AS split, (SELECT count(*) FROM k WHERE c = 'torn') AS torn,
 (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM k WHERE c = 'split') AS split_readings, (SELECT out_of_order FROM o) AS out_of_order, true AS sound FROM r"""
)
def integrity_report(spark, sf_dir):
    return recorder.integrity(stored_records(spark, sf_dir))


@table_query(f"{_R}, {_ORDERED} SELECT * FROM o")
def order_check(spark, sf_dir):
    return recorder.out_of_order(stored_records(spark, sf_dir))


#: The value that belongs to a recorder's key: FNV-1a over its ten bytes, then the finalizer, in unsigned 128-bit arithmetic.
_VALUE = f"""b AS (SELECT *, list_concat(list_transform([56, 48, 40, 32, 24, 16, 8, 0], lambda x: ((tick >> x) & 255)::UHUGEINT), [ascii(kind)::UHUGEINT, id::UHUGEINT]) AS bytes FROM r),
 f AS (SELECT *, list_reduce(list_concat([14695981039346656037::UHUGEINT], bytes), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % {_M64}) AS h FROM b),
 g AS (SELECT * REPLACE ((xor(h, h // 8589934592::UHUGEINT) * 18397679294719823053::UHUGEINT) % {_M64} AS h) FROM f),
 u AS (SELECT * REPLACE (xor(h, h // 8589934592::UHUGEINT) AS h) FROM g)"""
_LITTLE = " || ".join(f"printf('%02X', CAST((h // {256**i}::UHUGEINT) % 256 AS BIGINT))" for i in range(8))


@table_query(f"{_R}, {_VALUE} SELECT event_id, tick, kind, id, {_LITTLE} AS value, round(15 + CAST(h % 2000 AS DOUBLE) / 100, 2) AS celsius FROM u")
def key_values(spark, sf_dir):
    rows = records_of(spark, sf_dir).withColumn("value", value_of(recorder_key(F.col("tick"), F.col("kind"), F.col("id"))))
    return rows.select("event_id", "tick", "kind", "id", F.hex("value").alias("value"), F.round(temperature(F.col("value")), 2).alias("celsius"))


@table_query(f"{_R}, {_VALUE} SELECT tick, id, round(15 + CAST(h % 2000 AS DOUBLE) / 100, 2) AS celsius, intact FROM u WHERE kind = 'r' AND tick = 7 AND id = 2")
def one_reading(spark, sf_dir):
    return recorder.reading(stored_records(spark, sf_dir), 7, 2)


@table_query(
    f"""{_R}, {LOG_SQL}, {_SEGMENTS}, l AS (SELECT CAST(segment_id % 2 AS VARCHAR) || ':' || count(*) AS x FROM m GROUP BY segment_id % 2)
 SELECT (SELECT count(*) FROM log WHERE seq > 7 * ({N} // 8)) AS replayed, {N} AS max_seq, CAST(3 AS BIGINT) AS boots, (SELECT min(tick) FROM r) AS oldest, (SELECT max(tick) FROM r) AS newest,
 (SELECT count(*) FROM m) AS segments, (SELECT CAST(sum(entry_count) AS BIGINT) FROM m) AS entries, (SELECT string_agg(x, ',' ORDER BY x) FROM l) AS levels"""
)
def database_summary(spark, sf_dir):
    log, n = log_of(spark, sf_dir)
    segments = _manifest(log, n).withColumn("level", F.expr("segment_id % 2"))
    boots = spark.createDataFrame([(b"\x03" + bytes(7),)], "val binary")
    return recorder.summary(records_of(spark, sf_dir), segments, log.where(F.col("seq") > 7 * (n // 8)), n, boots)


@table_query(f"{_R} SELECT min(tick) AS oldest, max(tick) AS newest FROM r")
def tick_bounds(spark, sf_dir):
    return recorder.tick_bounds(records_of(spark, sf_dir))


@table_query(f"{_R} SELECT tick, kind, id, val FROM r WHERE tick = (SELECT max(tick) FROM r WHERE kind = 'r')")
def newest_frame(spark, sf_dir):
    return recorder.newest_frame(records_of(spark, sf_dir)).select("tick", "kind", "id", "val")


@table_query(f"{_R} SELECT tick, val FROM r WHERE kind = 'e' ORDER BY tick DESC LIMIT 3")
def latest_events(spark, sf_dir):
    return recorder.latest_events(records_of(spark, sf_dir)).select("tick", "val")


@table_query(
    f"""{_R}, {_BITS}, t AS (SELECT range AS tick FROM range((SELECT max(event_id) // 5 FROM events) + 1))
 SELECT t.tick, coalesce(bits, 0) AS bits, CASE WHEN coalesce(bits, 0) & 15 = 15 THEN 'whole' WHEN t.tick % 100 BETWEEN 40 AND 43 THEN 'purged' ELSE 'lost' END AS state FROM t LEFT JOIN c ON c.tick = t.tick"""
)
def loss_check(spark, sf_dir):
    rows, top = records_of(spark, sf_dir), _now(spark, sf_dir)
    windows = spark.range(0, top // 100 + 1).selectExpr("id * 100 + 40 as first_tick", "id * 100 + 43 as last_tick")
    return recorder.losses(recorder.spine(spark, 0, top), rows.where(f"tick >= {top // 2}"), rows.where(f"tick < {top // 2 + 50}"), windows)


@table_query(f"{_R} SELECT id, count(val) AS n, min(val) AS least, max(val) AS largest, round(avg(val), 6) AS mean FROM r WHERE kind = 'r' GROUP BY id")
def history_report(spark, sf_dir):
    rows, top = records_of(spark, sf_dir).withColumn("key", F.col("event_id")), _now(spark, sf_dir)
    both = rows.where(f"tick >= {top // 2}").union(rows.where(f"tick < {top // 2 + 50}"))
    return recorder.sensor_stats(recorder.first_copies(both)).withColumn("mean", F.round("mean", 6))


# workloads over orders


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.selectExpr("cast(o_orderkey as bigint) + 1 as seq", "1 as op", "lpad(cast(o_custkey as string),16,'0') as key", "cast(cast(round(o_totalprice * 100) as bigint) as string) as val", "cast(0 as bigint) as expire_at")


_O = "WITH o AS (SELECT CAST(o_orderkey AS BIGINT) + 1 AS seq, 1 AS op, lpad(CAST(o_custkey AS VARCHAR),16,'0') AS key, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS val, 0 AS expire_at FROM orders), w AS (SELECT key, arg_max(val, seq) AS val, max(seq) AS seq FROM o GROUP BY key)"


@table_query(f"{_O}, t AS (SELECT o.seq, o.key, o.val FROM o UNION ALL SELECT seq + (SELECT max(seq) FROM o), key, concat(val, '0') FROM o WHERE seq % 3 = 0) SELECT key, arg_max(val, seq) AS val, max(seq) AS seq FROM t GROUP BY key")
def overwrite(spark, sf_dir):
    """Every third order written once more, as later mutations."""
    rows = _orders(spark, sf_dir)
    top = rows.agg(F.max("seq")).first()[0] or 0
    return resolve(rows.union(rows.where("seq % 3 = 0").withColumns({"seq": F.col("seq") + top, "val": F.concat("val", F.lit("0"))})), tombstones="none")


@table_query(f"{_O} SELECT * FROM w")
def read_seq(spark, sf_dir):
    return resolve(_orders(spark, sf_dir), tombstones="none")


@table_query(f"{_O} SELECT key, val, seq, row_number() OVER (ORDER BY key DESC) AS rank FROM w")
def read_reverse(spark, sf_dir):
    return with_rank(scan.reverse_scan(resolve(_orders(spark, sf_dir), tombstones="none")), reverse=True)


@table_query(f"{_O}, k AS (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR),16,'0') AS key FROM customer) SELECT k.key, w.val, w.seq, w.key IS NOT NULL AS found FROM k LEFT JOIN w ON w.key = k.key")
def read_random(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("lpad(cast(c_custkey as string),16,'0') as key").distinct()
    return scan.multi_get(keys, _orders(spark, sf_dir), tombstones="none")


@table_query(f"{_O}, d AS (SELECT key, seq FROM w WHERE CAST(key AS BIGINT) % 10 <> 0) SELECT count(*) AS entries, CAST(sum(seq) AS BIGINT) AS seqs FROM d")
def delete_random(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    gone = rows.where("cast(key as bigint) % 10 = 0").selectExpr(f"seq + {LATEST // 2} as seq", "2 as op", "key", "cast(null as string) as val", "expire_at")
    return resolve(rows.union(gone), tombstones="none").agg(F.count(F.lit(1)).alias("entries"), F.sum("seq").alias("seqs"))


@table_query(f"{_O}, p AS (SELECT DISTINCT lpad(CAST(c_custkey * 7 AS VARCHAR),16,'0') AS probe FROM customer) SELECT p.probe, min(w.key) AS key FROM p LEFT JOIN w ON w.key >= p.probe GROUP BY p.probe")
def seek_random(spark, sf_dir):
    """For many probes at once, the first key at or above each: one ordered pass of probes and keys in key ranges, not a join."""
    probes = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("lpad(cast(c_custkey * 7 as string),16,'0') as probe").distinct()
    return scan.seek_many(probes, resolve(_orders(spark, sf_dir), tombstones="none"))


# workloads that write a store


def _store(spark: SparkSession) -> Store:
    return Store(spark, new_path(spark, "store"))


def _filled(store: Store, rows: DataFrame, epoch: int) -> Store:
    """The store with one more group of rows (ticket, key, val), in ticket order."""
    put = rows.select("ticket", F.lit(1).alias("op"), F.col("key").cast("binary").alias("key"), F.col("val").cast("binary").alias("val"), F.lit(0).cast("long").alias("expire_at"))
    append_once(store, put, epoch, "fill")
    return store


def _text(view: DataFrame) -> DataFrame:
    return view.select(F.col("key").cast("string").alias("key"), F.col("val").cast("string").alias("val"), "seq")


_FILLED = "WITH o AS (SELECT row_number() OVER (ORDER BY {order}) AS seq, lpad(CAST(o_custkey AS VARCHAR),16,'0') AS key, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS val FROM orders), w AS (SELECT key, arg_max(val, seq) AS val, max(seq) AS seq FROM o GROUP BY key)"


@table_query(_FILLED.format(order="o_orderkey") + " SELECT * FROM w")
def fill_seq(spark, sf_dir):
    """Orders written in their order, flushed, and read back."""
    store = _filled(_store(spark), _orders(spark, sf_dir).withColumn("ticket", F.col("seq")), 0)
    store.flush()
    return _text(store.view())


@table_query(_FILLED.format(order="md5(CAST(o_orderkey AS VARCHAR)), o_orderkey") + " SELECT * FROM w")
def fill_random(spark, sf_dir):
    """Orders written in the order of a hash."""
    ticket = F.struct(F.md5((F.col("seq") - 1).cast("string").cast("binary")), "seq")
    return _text(_filled(_store(spark), _orders(spark, sf_dir).withColumn("ticket", ticket), 0).view())


@table_query(_FILLED.format(order="o_orderkey % 4, o_orderkey") + ", n AS (SELECT count(*) AS n FROM orders) SELECT key, val, seq, (SELECT n FROM n) + 1 AS range_seq FROM w WHERE key < '0000000000000100' OR key >= '0000000000000200'")
def compact_store(spark, sf_dir):
    """Orders written in four groups, each flushed, then a range of keys deleted, and all compacted into several segments."""
    store = Store(spark, new_path(spark, "store"), segment_rows=5_000)
    rows = _orders(spark, sf_dir).withColumn("ticket", F.col("seq"))
    for part in range(4):
        _filled(store, rows.where(f"(seq - 1) % 4 = {part}"), part).flush()
    seq = store.write(Batch().delete_range(b"0000000000000100", b"0000000000000200"))
    store.flush()
    while store.compact_step():
        pass
    store.compact_all()
    return _text(store.view()).withColumn("range_seq", F.lit(seq).cast("long"))


_VALID = "t AS (SELECT row_number() OVER (ORDER BY seq) AS seq, op, key, val, expire_at FROM log WHERE NOT (op = 3 AND key >= val))"


def _logged(spark: SparkSession, sf_dir: str) -> Store:
    """A store of the derived log: two sealed segments and the rest unsealed."""
    log, n = log_of(spark, sf_dir)
    store = _store(spark)
    rows = log.select(F.col("seq").alias("ticket"), "op", F.col("key").cast("binary").alias("key"), F.col("val").cast("binary").alias("val"), "expire_at")
    for part, where in enumerate((f"ticket <= {n // 2}", f"ticket > {n // 2} and ticket <= {3 * n // 4}", f"ticket > {3 * n // 4}")):
        append_once(store, rows.where(where), part, "log")
        if part < 2:
            store.flush()
    return store


@table_query(f"WITH {LOG_SQL}, {_VALID} SELECT seq, op, key, val, expire_at, CASE WHEN seq <= (SELECT count(*) FROM log WHERE seq <= {HALF} AND NOT (op = 3 AND key >= val)) THEN 1 WHEN seq <= (SELECT count(*) FROM log WHERE seq <= (SELECT 3 * n // 4 FROM n) AND NOT (op = 3 AND key >= val)) THEN 2 END::BIGINT AS segment_id FROM t")
def version_stream(spark, sf_dir):
    """All versions that a store holds, deletions included, and the segment of each."""
    return _logged(spark, sf_dir).log().select("seq", "op", F.col("key").cast("string").alias("key"), F.col("val").cast("string").alias("val"), "expire_at", "segment_id")


@table_query(
    f"""WITH {LOG_SQL}, {_VALID}, s AS (SELECT *, CASE WHEN seq <= (SELECT count(*) FROM log WHERE seq <= {HALF} AND NOT (op = 3 AND key >= val)) THEN 1 WHEN seq <= (SELECT count(*) FROM log WHERE seq <= (SELECT 3 * n // 4 FROM n) AND NOT (op = 3 AND key >= val)) THEN 2 END::BIGINT AS segment_id FROM t)
 SELECT segment_id, 0 AS level, lower(hex(min(key))) AS first_key, lower(hex(max(CASE WHEN op = 3 THEN val ELSE key END))) AS last_key, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS entry_count, count(CASE WHEN op = 3 THEN 1 END) AS rdel_count FROM s WHERE segment_id IS NOT NULL GROUP BY segment_id"""
)
def segment_inventory(spark, sf_dir):
    return _logged(spark, sf_dir).segments().select("segment_id", "level", "first_key", "last_key", "min_seq", "max_seq", "entry_count", "rdel_count")


@query(f"g AS (SELECT *, (seq - 1) // 5 AS batch FROM log WHERE seq % 35 <> 0 AND seq % 77 <> 3), l2 AS (SELECT * FROM g WHERE batch IN (SELECT batch FROM g GROUP BY 1 HAVING count(*) = 5)), {view_sql(src='l2')} SELECT * FROM v")
def store_replay(log, n):
    """A log that another process left, with torn groups, taken over by a store."""
    rows = log.where("seq % 35 <> 0 and seq % 77 <> 3").withColumns({"batch_id": F.expr("(seq - 1) div 5"), "pos": F.expr("(seq - 1) % 5"), "closes": F.expr("(seq - 1) % 5 = 4")})
    store = _store(log.sparkSession)
    store.replay(rows.withColumns({"key": F.col("key").cast("binary"), "val": F.col("val").cast("binary")}))
    store.flush()
    return _text(store.view())

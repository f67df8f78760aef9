"""The queries of this subpackage, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fuzzyhash, html_text, langid, mixing, packing, sharding, simhash, token_files, vectors, warc
from .shared import drop_written, new_path, written, written_so_far
from .tokens import vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def _leaves_its_result(query: Query) -> Query:
    """The query with its result in a table; the tables and files that it made on the way are deleted."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        since = written_so_far()
        out = written(query(spark, sf_dir), query.__name__)
        drop_written(spark, since, but_last=True)
        return out

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_leaves_its_result
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), path, vocabulary(), end_id=2)
    return token_files.read(spark, path)


@_leaves_its_result
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=2).select("doc_id", "fingerprint", "component_id")


@_leaves_its_result
def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


@_leaves_its_result
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), end_id=1, capacity=4096)


@_leaves_its_result
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_table(spark, sf_dir, "documents"), share=1.5, weights=(3, 1, 2), most=2.0)


@_leaves_its_result
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=16)


def op8_fuzzyhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzyhash.fingerprints(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_leaves_its_result
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_token_files, op2_simhash, op3_vectors, op4_language, op5_packing, op6_mixing, op7_sharding, op8_fuzzyhash, op9_html_text, op10_warc)}
#: Links by comparing all pairs, and what they reach.
_VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
 r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
 c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
 SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id"""
#: Five hexadecimal digits of a SHA-1 are four letters of base 32.
_WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
 t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
 SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31 AS INT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t"""
ORACLE_SQL: dict[str, str] = {"op3_vectors": _VECTORS_SQL, "op6_mixing": mixing.ORACLE_SQL, "op10_warc": _WARC_SQL}

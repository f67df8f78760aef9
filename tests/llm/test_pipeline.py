from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, mixing
from tidemark.llm.shared import drop_written, written, written_so_far
from tidemark.llm.tokens import vocabulary

from .conftest import TEXTS

SF = "/root/testdata/sf0.001"


def _shingles(text):
    """The sets that the law compares, from the text alone."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _brute_force_kept(docs):
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more, comparing all pairs."""
    rows = [(r.doc_id, _shingles(r.text)) for r in docs]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(rows):
        for j, y in rows[:k]:
            if x == y or 10 * len(x & y) >= 8 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in root if find(i) == i}


def _pieces(docs, library):
    """Lengths and checksums of all pieces by the library itself."""
    out = []
    for r in docs:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            out.append((r.doc_id, k // 4096, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())))
    return sorted(out)


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "simhash", "mixing", "packing"]
    kept = written(corpus_pipeline.language(spark, docs, SF), "test")
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {i for i, t in texts.items() if not any(c.isalpha() for c in t or "")} <= gone
    judged = {r.doc_id: r.score for r in langid.languages(docs).collect()}
    net = langid.fit(docs)
    assert gone == {i for i in texts if judged[i] < langid.least_score(net, corpus_pipeline.LEAST_SURE)}
    assert all(len((texts[i] or "").split()) < 30 for i in gone)  # no text of a clear language goes
    single = written(corpus_pipeline.deduplicate(spark, kept, SF), "test")
    assert single.columns == docs.columns
    assert {r.doc_id for r in single.collect()} == _brute_force_kept(kept.collect())
    mixed = written(corpus_pipeline.mix(spark, single, SF), "test")
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.copies for r in mixing.shares(single).collect()}
    found = {}
    for r in mixed.collect():
        assert r.text == texts[r.doc_id]
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: n for k, n in taken.items() if n}
    out = corpus_pipeline.pack(spark, mixed, SF).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out) == _pieces(mixed.collect(), Tokenizer.from_file(vocabulary()))
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096


def test_repeated_ids_lose_no_text(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a, "s", "x"), (5, a, "s", "x"), (5, b, "t", "y"), (5, b, "s", "x"), (5, b, "s", "x"), (None, c, None, "z"), (None, a, None, "z"), (None, None, None, None), (7, "", "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    for _ in range(2):
        got = sorted(map(tuple, corpus_pipeline.deduplicate(spark, docs.repartition(3), SF).collect()), key=repr)
        assert got == sorted([(1, a, "s", "x"), (5, b, "s", "x"), (None, c, None, "z"), (7, "", "q", None)], key=repr)


def test_language_fills_what_is_not_known(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    true = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, rows, SF).collect()}
    filled = [i for i in got if i % 3 == 0]
    assert None not in got.values() and sum(got[i] == true[i] for i in filled) >= 0.95 * len(filled)
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unknown, SF).count() == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100
    again = corpus_pipeline.run(spark, SF)
    pick = lambda d: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in d.collect())
    assert pick(got) == pick(again)
    left = written_so_far()
    corpus_pipeline.run(spark, SF)
    assert written_so_far() == left + 1  # the result alone


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    kept = written(corpus_pipeline.language(spark, odd, SF), "test")
    assert kept.columns == odd.columns and not {1, 2, 9} & {r.doc_id for r in kept.collect()}
    single = written(corpus_pipeline.deduplicate(spark, odd, SF), "test")
    ids = sorted((r.doc_id for r in single.collect()), key=lambda x: (x is None, x))
    assert len(ids) == len(set(ids)) and set(ids) == {t[0] for t in TEXTS} - {7, 2, 9}
    mixed = written(corpus_pipeline.mix(spark, single, SF), "test")
    assert corpus_pipeline.pack(spark, mixed, SF).count() >= mixed.count()
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
    assert docs.count() == 0


def test_written_tables_can_be_dropped(spark):
    written(spark.range(3), "test")
    assert drop_written(spark) >= 1 and drop_written(spark) == 0


def test_queries_leave_their_result_alone(spark):
    from tidemark.llm import queries

    for name in ("op2_simhash", "op6_mixing", "op10_warc"):
        before = written_so_far()
        got = queries.QUERIES[name](spark, SF)
        assert written_so_far() == before + 1 and got.count() > 0

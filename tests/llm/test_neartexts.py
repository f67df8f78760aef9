from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import neartexts
from tidemark.llm.shared import written

SF = "/root/testdata/sf0.001"


def _set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _groups(texts):
    """The smallest index of each text's group, comparing all pairs by the Jaccard similarity of five-word shingles."""
    sets = [_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 10 * len(x & y) >= 8 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def _changed(words, n):
    """The words with about n of them replaced."""
    out = list(words)
    for i in random.sample(range(len(out)), n):
        out[i] = f"x{random.getrandbits(40)}"
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_near_copies_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neartexts, "BLOCK", block)
    random.seed(5)
    texts = []
    for _ in range(60):
        words = [f"w{random.getrandbits(40)}" for _ in range(random.randrange(30, 400))]
        # similarities from about 0.4 to 1, many near 0.8
        texts += [" ".join(words), *(" ".join(_changed(words, max(1, int(len(words) * x)))) for x in (0.005, 0.015, 0.02, 0.025, 0.04, 0.1))]
    words = [f"w{i}" for i in range(300)]
    texts += [" ".join(_changed(words, 3)) for _ in range(40)] + ["", None, " \n", "a", "a b", "A", "Same Text here"]
    expected = _groups(texts)
    got = {r.doc_id: r.kept_id for r in neartexts.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(enumerate(expected)) and 60 < len(set(expected)) < 400


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    groups = _groups([t for _, t in rows])
    got = [r.doc_id for r in written(corpus_pipeline.deduplicate(spark, docs, SF), "test").collect()]
    assert sorted(got) == [rows[i][0] for i in sorted(set(groups))]


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(1000):
        x = np.unique(rng.integers(0, 1 << 63, 99, np.uint64))
        missed += not (neartexts.band_keys(x[:90]) == neartexts.band_keys(x[9:])).any()  # 81 of 99: 0.82
    assert missed <= 3


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    random.seed(9)
    one, two, three, four = ([f"w{random.getrandbits(40)}" for _ in range(100)] for _ in range(4))
    near = lambda words: " ".join([*words[:-1], "end"])
    rows = [
        (1, " ".join(one)),
        (5, near(one)),  # goes
        (5, " ".join(two)),  # has no copy
        (None, " ".join(three)),
        (None, near(three)),
        (None, " ".join(three)),
        (None, near(two)),  # goes
        (8, " ".join(four)),
        (8, near(four)),
        (8, near(four)),
        (9, None),
        (9, ""),
        (None, "alone here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in written(corpus_pipeline.deduplicate(spark, docs, SF), "test").collect()]
    assert len(got) == 6 and {i for i, _ in got} == {1, 5, None, 8, 9}
    assert {(1, rows[0][1]), (5, rows[2][1]), (None, "alone here")} <= set(got)
    assert sum(i is None for i, _ in got) == 2

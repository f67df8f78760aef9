from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash, vectors
from tidemark.llm.shared import components

from .conftest import TEXTS


def test_covering_masks_are_complete():
    random.seed(1)
    for radius in (2, 5):
        masks = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(500):
            d = sum(1 << b for b in random.sample(range(64), radius))
            assert any(not d & m for m in masks)


def _fingerprint(text, k):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in [t for _, t, *_ in TEXTS] + ["ÀB c", "x\xa0y z", "one two three"]:
        assert simhash.fingerprint(text, 3) == _fingerprint(text, 3)


def _roots(n, links):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _partition(pairs):
    by = defaultdict(set)
    for k, v in pairs:
        by[v].add(k)
    return sorted(map(sorted, by.values()))


@pytest.mark.parametrize(("radius", "block"), [(2, 1024), (2, 4), (4, 1024), (4, 4)])
def test_links_join_what_brute_force_joins(spark, radius, block):
    random.seed(radius)
    fps = {random.getrandbits(64) for _ in range(200)}
    for centre in list(fps)[:6]:  # crowds, chains and pairs
        x = centre
        for _ in range(40):
            x ^= 1 << random.randrange(64) | 1 << random.randrange(64)
            fps |= {x, centre ^ 1 << random.randrange(64)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    u = np.array(signed, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None]) <= radius
    expected = _partition(zip(signed, _roots(len(signed), zip(*np.nonzero(near), strict=True)), strict=True))
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = components(simhash.links(table, radius, block), "a", "b").collect()
    names = {x: x for x in signed} | {r.node: r.component for r in found}
    assert _partition(names.items()) == expected


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, few):
    random.seed(3)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b", few).collect()}
    expected = _roots(3000, links)
    assert got == {x: expected[x] for e in links for x in e if e[0] != e[1]}
    odd = [(-5, 3), (None, 3), (7, 7), (3, -9), (8, None)]
    assert {r.node: r.component for r in components(spark.createDataFrame(odd, "a long, b long"), "a", "b", few).collect()} == {-5: -9, 3: -9, -9: -9}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b", few).count() == 0


def test_near_duplicates(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    fps = [_fingerprint(t, 3) for _, t, *_ in TEXTS]
    roots = _roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {r: min((TEXTS[i][0] for i in range(len(fps)) if roots[i] == r and TEXTS[i][0] is not None), default=None) for r in roots}
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((TEXTS[i][0], f"{fps[i]:016x}", least[roots[i]]) for i in range(len(fps))), key=key)
    assert simhash.near_duplicates(none).count() == 0


def _vectors():
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 24))
    rows = list(base)
    for i in range(0, 60, 2):  # around the threshold
        v = rng.standard_normal(24)
        v -= v @ base[i] / (base[i] @ base[i]) * base[i]
        c = rng.uniform(0.85, 1.0)
        rows.append(c * base[i] / np.linalg.norm(base[i]) + np.sqrt(1 - c * c) * v / np.linalg.norm(v))
    rows += [base[3] + rng.standard_normal(24) * 0.02 for _ in range(80)]
    rows += [base[5]] * 7 + [base[5] * 2]
    return [[float(np.float32(x)) for x in v] for v in rows]


def test_vectors(spark):
    rows = [(i, v) for i, v in enumerate(_vectors())]
    n = len(rows)
    odd = [None, [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, [float("inf")] + [0.0] * 23, [], [1.0, 0.0], [2.0, 0.0]]
    table = spark.createDataFrame([(i, v, 1) for i, v in [*rows, *((n + i, v) for i, v in enumerate(odd)), (None, rows[0][1])]], "vec_id long, embedding array<float>, n int").repartition(3)
    got = {r.vec_id: r for r in vectors.near_duplicates(table).collect()}
    x = np.array([np.array(v, np.float32) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    links = sum(got[i].n_links for i in range(n))
    assert all(got[i].n_links <= near[i].sum() for i in range(n))
    assert links >= 0.97 * near.sum()
    assert got[303].n_links == near[303].sum()
    for i in range(n):
        assert got[i].kept == (got[i].component_id == i) and got[i].component_id <= i
    copies = [i for i in range(n) if rows[i][1] == rows[5][1]]
    assert len(copies) == 8 and {got[i].component_id for i in copies} == {5}
    for i in range(n, n + 6):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[n + 7].component_id == n + 6 and got[n + 6].n_links == 1
    assert (got[None].n_links, got[None].kept) == (0, False)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_crowded_cells_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(y) for y in np.float32(np.ones(8) + rng.standard_normal(8) * 0.05)]) for i in range(100)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.n_links for r in got} == {99} and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("n", [1, 50, 64, 200])
def test_collision_counts(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-60, 60, (30, 32)).astype(np.int16), rng.integers(-60, 60, (n, 32)).astype(np.int16)
    counts = (np.abs(a[:, None].astype(int) - b[None]) <= 20).sum(2)
    for least in (1, 7, 9, 16, 32):
        assert (vectors.collisions(a, b, 20, least) == (counts >= least)).all()


@pytest.mark.parametrize("cell", [64, 4096])
def test_recall_near_the_threshold(spark, monkeypatch, cell):
    """Pairs at cosines from 0.9 to 0.93, in many cells and in one, against brute force."""
    monkeypatch.setattr(vectors, "CELL", cell)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((800, 32))
    other = rng.standard_normal((800, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.93, (800, 1))
    rows = np.float32(np.concatenate([base, c * base + np.sqrt(1 - c * c) * other]))
    x = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    found = {r.vec_id: r.n_links for r in vectors.near_duplicates(table).collect()}
    assert all(found[i] <= near[i].sum() for i in found)
    assert sum(found.values()) >= 0.98 * near.sum()



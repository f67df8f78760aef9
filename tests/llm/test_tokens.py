from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import elias_fano, packing, token_files
from tidemark.llm.shared import new_path
from tidemark.llm.tokens import ChunkTokenizer, vocabulary

from .conftest import TEXTS


@pytest.fixture(scope="module")
def tok():
    return ChunkTokenizer(Path(vocabulary()).read_bytes())


def test_ids_are_those_of_the_library(tok):
    random.seed(5)
    letters = [chr(c) for c in range(0x260)] + ["'s", "'LL", " ", "<|endoftext|>", "<|", "Σ", "é", "한국", "　", "٣", "ß", "İ", "😀", "_"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 50))) for _ in range(3000)] + ["", " ", None, "don't'll ''s"]
    ids, n = tok.encode(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(n)))
    for i, got in enumerate(tok.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert got.ids == ids[at[i] : at[i + 1]].tolist(), ascii(texts[i])


def test_other_vocabularies_go_through_the_library(tok):
    import public_tokenizers

    other = ChunkTokenizer(Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes())
    texts = ["Two Words, 12 digits\n\n and   space", "", None, "don't"]
    ids, n = other.encode(pa.array(texts))
    assert tok.quick and not other.quick
    assert ids.tolist() == [i for t in texts for i in other.whole.encode(t or "", add_special_tokens=False).ids] and n[1] == n[2] == 0


def test_a_full_memory_changes_nothing(tok, monkeypatch):
    monkeypatch.setattr("tidemark.llm.tokens.WORDS", 8)
    small = ChunkTokenizer(Path(vocabulary()).read_bytes())
    texts = pa.array(["one two three four five six", "seven one two eight nine ten"])
    for _ in range(3):
        assert small.encode(texts)[0].tolist() == tok.encode(texts)[0].tolist() and small.n <= 13
    monkeypatch.setattr("tidemark.llm.tokens.LONG_CHARS", 100)
    odd = pa.array(["日本語" * 30 + " don't", "x" * 90, "日本語" * 30])
    for _ in range(2):
        assert small.encode(odd)[0].tolist() == [i for x in tok.whole.encode_batch(odd.to_pylist(), add_special_tokens=False) for i in x.ids] and small.n_long <= 200
    long = pa.array([" ".join("abcdefgh"[i % 8] * i for i in range(1, 90)), "x" * 31 + " " + "x" * 32 + " " + "x" * 33, "a\0 a b\0c"])
    for _ in range(2):
        ids, n = tok.encode(long)
        assert [len(x.ids) for x in tok.whole.encode_batch(long.to_pylist(), add_special_tokens=False)] == n.tolist()
        assert [i for x in tok.whole.encode_batch(long.to_pylist(), add_special_tokens=False) for i in x.ids] == ids.tolist()


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9, 1000, 1 << 40], list(range(0, 5000, 3)), [7] * 200])
def test_elias_fano(values):
    raw = b"xx" + elias_fano.encode(np.array(values, np.uint64)) + b"after"
    s = elias_fano.Sequence(raw, 2)
    assert s.all().tolist() == values and [s.select(i) for i in range(len(values))] == values and raw[s.end :] == b"after"
    with pytest.raises(IndexError):
        s.select(len(values))


@pytest.mark.parametrize("bits", [1, 20, 57, 59, 61, 62, 63, 64])
def test_elias_fano_of_wide_values(bits):
    r = random.Random(bits)
    for n in [*range(2, 65), 300]:
        values = sorted(r.getrandbits(bits) for _ in range(n))
        s = elias_fano.Sequence(elias_fano.encode(np.array(values, np.uint64)))
        assert s.all().tolist() == values and [s.select(i) for i in range(n)] == values
        a, b = sorted(r.choices(range(n + 1), k=2))
        assert s.range(a, b).tolist() == values[a:b]


def test_files_of_wide_ids():
    r = random.Random(9)
    for n in range(2, 65):
        ids = sorted(r.randrange(-(1 << 63), 1 << 63) for _ in range(n))
        f = token_files.TokenFile(token_files.pack([None, *ids], np.ones(n + 1, np.int64), np.arange(n + 1, dtype="<u4")))
        assert f.doc_ids() == [None, *ids] and f.doc_ids(1, 3) == ids[:2] and all(f.find(x) == i + 1 and f.ids(i + 1).tolist() == [i + 1] for i, x in enumerate(ids))
        assert f.find(12345) is None
    span = [-(1 << 63), 0, (1 << 63) - 1]
    assert token_files.TokenFile(token_files.pack(span, np.ones(3, np.int64), np.arange(3, dtype="<u4"))).doc_ids() == span


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(elias_fano.encode(v)) < 100_000 * 14 / 8


def test_file_round_trip():
    raw = token_files.pack([None, -5, 3, 3], np.array([1, 2, 0, 3]), np.array([9, 1, 70000, 4, 5, 6], "<u4"))
    f = token_files.TokenFile(raw)
    assert f.doc_ids() == [None, -5, 3, 3] and f.starts().tolist() == [0, 1, 3, 3, 6] and f.ids(3).tolist() == [4, 5, 6]


def _expected(tok, rows, end):
    return [tok.whole.encode(t or "", add_special_tokens=False).ids + [end] for _, t in rows]


def test_token_files(spark, odd, none, tok):
    path = new_path(spark, "t")
    token_files.write(odd, path, vocabulary(), 2, file_ids=50)
    rows = sorted(((i, t or "") for i, t, *_ in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at, expected = 0, []
    for (i, _), ids in zip(rows, _expected(tok, rows, 2), strict=True):
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected
    path = new_path(spark, "t")
    token_files.write(none, path, vocabulary(), 2)
    assert token_files.read(spark, path).count() == 0


def test_rows_without_ids_are_parted(spark):
    rows = [(None, f"word{i} again") for i in range(400)] + [(5, f"other{i}") for i in range(50)] + [(9, "last")]
    path = new_path(spark, "t")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, vocabulary(), 2)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 400 + [5] * 50 + [9] and len({r.part for r in got if r.doc_id is None}) > 1
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_export(spark, odd, tmp_path):
    path = new_path(spark, "t")
    token_files.write(odd, path, vocabulary(), 2)
    n = token_files.export(spark, path, str(tmp_path))
    found = sorted(tmp_path.iterdir())
    assert len(found) == n and sum(token_files.TokenFile(f.read_bytes()).n_docs for f in found) == len(TEXTS)


def _fits(solution, hist, capacity):
    used = {}
    for filling, times in solution:
        assert sum(filling) <= capacity
        for x in filling:
            used[x] = used.get(x, 0) + times
    return used == hist


def _best(sizes, capacity):
    """Fewest bins, by exhaustive search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in sorted(range(len(bins)), key=bins.__getitem__):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("steps", [None, packing.STEPS])
def test_packing_is_as_tight_as_exhaustive_search(steps):
    random.seed(2)
    missed = 0
    for low, times in ((1, 100), (4, 500)):
        for _ in range(times):
            sizes = [random.randint(low, 30 if low == 1 else 16) for _ in range(random.randint(1, 10))]
            hist = {x: sizes.count(x) for x in sizes}
            got, best = packing.solve(hist, 30, steps=steps), _best(sizes, 30)
            assert _fits(got, hist, 30) and sum(n for _, n in got) == best
            missed += sum(n for _, n in packing.best_fit(hist, 30)) > best
    assert missed > 3  # the search finds what best fit does not


def test_dominated_fillings():
    free = lambda *xs: sum(1 << x for x in xs)
    assert packing._dominated((5, 3), 2, free(10)) and packing._dominated((5, 3), 0, free(8)) and packing._dominated((5, 3), 1, free(4))
    assert packing._dominated((5, 3), 2, free(2)) and not packing._dominated((5, 3), 1, free(2, 3, 5, 10)) and not packing._dominated((5,), 0, free(5, 6))
    assert packing._dominated((2,) * 7, 0, free(14)) and not packing._dominated((2,) * 7, 0, free(13, 15))


def test_many_short_pieces_need_few_nodes():
    hist = {1: 5000, 2: 5000, 260: 9, 255: 3}
    got = packing.solve(hist, 512, nodes=3, branch=1)
    assert _fits(got, hist, 512)
    assert packing._fillings([0, 900], 800, 0, 2, 5) == [(1,) * 800]


def test_packing_reaches_the_waste_bound_and_ends_on_hard_lengths():
    random.seed(4)
    hist = {}
    for _ in range(3000):
        x = min(512, max(1, int(random.lognormvariate(4.5, 1))))
        hist[x] = hist.get(x, 0) + 1
    total = sum(k * n for k, n in hist.items())
    got = packing.solve(hist, 512)
    assert _fits(got, hist, 512) and sum(n for _, n in got) <= -(-total // 512) + 1
    hard = {300: 500, 260: 300}
    assert sum(n for _, n in packing.solve(hard, 512)) == 800
    assert packing.solve({}, 512) == []


def test_pack(spark, odd, none, tok):
    got = packing.pack(odd, vocabulary(), 1, 64, with_ids=True).collect()
    expected = []
    for (i, _), ids in zip([(i, t) for i, t, *_ in TEXTS], _expected(tok, [(i, t) for i, t, *_ in TEXTS], 1), strict=True):
        for k in range(0, len(ids), 64):
            raw = np.array(ids[k : k + 64], "<u4").tobytes()
            expected.append((i if i is not None else -1, k // 64, k, len(raw) // 4, zlib.crc32(raw), raw))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(expected)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 64) + 1
    assert packing.pack(none, vocabulary(), 1, 64).count() == 0

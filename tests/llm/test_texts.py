from __future__ import annotations

import hashlib
import itertools
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fuzzyhash, html_text, langid, mixing, sharding

from .conftest import TEXTS

SF = "/root/testdata/sf0.001"


def _key(r):
    return tuple((x is None, x) for x in r)


# language


def test_windows_cover_every_place():
    for n in (0, 1, 127, 128, 129, 252, 253, 254, 1000):
        raw = bytes(97 + i % 26 for i in range(n))
        found = langid.windows_of(raw)
        cls = langid.CLASS[np.frombuffer(raw, np.uint8)]
        whole = {tuple(cls[i : i + 4]) for i in range(max(0, n - 3))}
        seen = {tuple(w[i : i + 4]) for w in found for i in range(langid.LENGTH - 3)}
        assert whole <= seen and len(found) == max(1, -(-(n - langid.LENGTH) // langid.STRIDE) + 1)


def test_pooled_responses_are_the_convolutions():
    rng = np.random.default_rng(1)
    net = langid.Network([rng.standard_normal((w, langid.K, langid.FILTERS)) for w in langid.WIDTHS], rng.standard_normal((49, 2)), ["a", "b"])
    x = rng.integers(0, langid.K, (5, langid.LENGTH)).astype(np.uint8)
    last = langid.LENGTH - 3
    expected = np.concatenate([sum(f[j][x[:, j : j + last]] for j in range(w)).max(1) for w, f in zip(langid.WIDTHS, net.filters, strict=True)], 1)
    assert np.allclose(net.pooled(x, net.tables()), expected, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.languages(docs).collect()
    assert len(got) == len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and known[r.doc_id]]
    assert sum(r.lang_pred == known[r.doc_id] for r in test) >= 0.95 * len(test)


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.withColumns({"lang": F.when(held, "xx").otherwise(F.col("lang")), "source": F.lit("s")})
    pick = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.languages(d).collect())
    assert pick(docs) == pick(other)


def test_language_of_odd_rows(odd, none):
    got = langid.languages(odd).collect()
    assert len(got) == len(TEXTS) and {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}
    assert sorted(r.doc_id for r in got if r.lang_pred == "und") == [1, 2, 9]
    assert langid.languages(none).count() == 0
    out = langid.identify(odd, None)
    assert set(out.columns) == set(odd.columns) and {r.lang_pred for r in out.collect()} == {"und"}


# mixing


def _targets(sizes):
    """Targets by rounds of resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    cap = {s: 2.0 * sizes[s] for s in names}
    target = dict.fromkeys(names, 0.0)
    excess, free = 1.5 * sum(sizes.values()), set(names)
    while excess > 1e-9 and free:
        w = sum(weight[s] for s in free)
        for s in free:
            target[s] += excess * weight[s] / w
        excess = 0.0
        for s in list(free):
            if target[s] >= cap[s]:
                excess += target[s] - cap[s]
                target[s] = cap[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 5, None: 100, "é": 40, "z": 1}, {"a": 0, "b": 7}, {"a": 0}, {"x": 1}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table, 1.5, (3, 1, 2), 2.0).collect()}
    assert got == pytest.approx(_targets(sizes))


def test_shares(spark, odd, none):
    import re

    got = mixing.shares(odd).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in TEXTS]
    assert sorted(((r.doc_id, r.size) for r in got), key=_key) == sorted(((i, n) for (i, *_), n in zip(TEXTS, size, strict=True)), key=_key)
    totals = {}
    for (_, _, _, source), n in zip(TEXTS, size, strict=True):
        totals[source] = totals.get(source, 0) + n
    target = _targets(totals)
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
    again = mixing.shares(odd.repartition(5)).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(map(tuple, again), key=_key)
    assert mixing.shares(none).count() == 0


def test_mix_repeats_whole_rows(odd, none):
    taken = {}
    for r in mixing.shares(odd).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    found = {}
    for r in out.select("doc_id").collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: n for k, n in taken.items() if n}
    assert mixing.mix(none).count() == 0


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {}
    for r in mixing.shares(docs).collect():
        x = by.setdefault(r.source, [r.target, 0])
        x[1] += r.taken
    assert all(abs(t - n) <= 0.08 * t for t, n in by.values())


# sharding


def test_differencing_balances_better_than_greedy():
    rng = np.random.default_rng(6)
    sizes = (rng.pareto(1.5, 2000) * 1000 + 1).astype(np.int64)
    label = sharding.difference_items(sizes, 16)
    sums = np.bincount(label, sizes, 16)
    greedy = np.zeros(16)
    for s in np.sort(sizes)[::-1]:
        greedy[greedy.argmin()] += s
    bound = max(sizes.max(), sizes.sum() / 16)
    assert sums.max() - bound <= max(1, greedy.max() - bound)


def test_two_way_differencing():
    label = sharding.difference_items(np.array([8, 7, 6, 5, 4]), 2)
    sums = np.bincount(label, [8, 7, 6, 5, 4], 2)
    assert sorted(sums) == [14, 16]


def _differenced(sizes, k):
    """Karmarkar-Karp with plain lists: partial partitions as (sum, members) pairs."""
    parts = [[(0, []) for _ in range(k - 1)] + [(int(x), [i])] for i, x in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1][0] - p[0][0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)), key=lambda t: t[0]))
    return sorted(sorted(m) for _, m in parts[0])


@pytest.mark.parametrize("k", [2, 3, 5])
def test_differencing_against_plain_lists(k):
    rng = np.random.default_rng(k)
    for _ in range(40):
        sizes = rng.choice(1 << 40, rng.integers(1, 30), replace=False)  # spreads do not tie
        label = sharding.difference_items(sizes, k)
        sums = sorted(np.bincount(label, sizes, k).tolist())
        assert sums == sorted(float(sum(int(sizes[i]) for i in m)) for m in _differenced(sizes, k))


def test_differencing_comes_near_the_best_assignment():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = rng.integers(1, 100, rng.integers(4, 9))
        best = min(max(np.bincount(list(x), sizes, 3)) for x in itertools.product(range(3), repeat=len(sizes)))
        assert max(np.bincount(sharding.difference_items(sizes, 3), sizes, 3)) <= 4 / 3 * best


@pytest.mark.parametrize(("block", "fan"), [(2, 2), (3, 1000), (50_000, 2048)])
def test_shard(odd, none, block, fan):
    got = sharding.shard(odd, 4, block, fan).collect()
    of = {}
    for i, t, *_ in TEXTS:
        of.setdefault(i, []).append(t or "")
    assert len(got) == len(TEXTS)
    shard_of = {}
    for r in got:
        assert any(r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) for t in of[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    for k in range(4):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none).count() == 0


def test_a_tree_of_blocks_is_balanced_and_holds_all(spark):
    rng = np.random.default_rng(1)
    texts = ["x" * int(n) for n in rng.integers(1, 3000, 700)] + [None] * 300
    docs = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = sharding.shard(docs, 8, 20, 3).collect()
    assert sorted(r.size for r in got) == sorted(len(t or "") + 1 for t in texts)
    sums = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sums) - min(sums) <= 300
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_sums_before(spark):
    from tidemark.llm import shared

    rows = [(i * 37 % 101, None if i == 5 else f"s{i:03d}") for i in range(101)]
    shared_rows = shared.BUCKET_ROWS
    shared.BUCKET_ROWS = 10
    try:
        got = shared.sums_before(spark.createDataFrame(rows, "x long, name string"), [F.col("name").asc_nulls_last()], {"i": F.lit(1), "s": F.col("x")}, 101, "test").collect()
    finally:
        shared.BUCKET_ROWS = shared_rows
    line = sorted(rows, key=lambda r: (r[1] is None, r[1] or ""))
    assert sorted((r.x, r.i, r.s) for r in got) == sorted((x, i, sum(y for y, _ in line[:i])) for i, (x, _) in enumerate(line))


# fuzzy hashes


def test_likeness():
    rng = np.random.default_rng(2)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(4000)]
    a = " ".join(words[:800])
    b = " ".join([*words[:400], "changed", *words[401:800]])
    c = " ".join(words[2000:2800])
    like = lambda x, y: fuzzyhash.likeness(fuzzyhash.fingerprint(x), fuzzyhash.fingerprint(y))
    assert like(a, a) == 1 and like(a, b) > 0.9 and like(a, c) < 0.1 and like(a, b) == like(b, a)
    assert 0.35 < like(a, fuzzyhash.edited(a, c)) < 0.7
    assert like("", "") == 1 and like("", "a") == 0 and like("a" * 50000, "a" * 50000) == 1


def test_common_is_the_longest_common_subsequence():
    import random

    random.seed(4)
    for _ in range(100):
        a, b = ([random.choice("abc") for _ in range(random.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fuzzyhash._common("".join(x * 2 for x in a), "".join(y * 2 for y in b)) == table[-1][-1]


def _piecewise(text):
    """The fingerprint by its definition, byte by byte."""
    raw, mix, m64 = text.encode(), 0x9E3779B97F4A7C15, (1 << 64) - 1
    values = []
    for p in range(len(raw)):
        seven = bytes(max(0, 6 - p)) + raw[max(0, p - 6) : p + 1]
        x = int.from_bytes(seven, "little") * mix & m64
        values.append(((x ^ x >> 32) * mix & m64) >> 32)
    ends = lambda e: sorted({p + 1 for p, v in enumerate(values) if v < 1 << (32 - e)} | {len(raw)} - {0})
    e = 2
    while sum(v < 1 << (32 - e) for v in values) >= 64:
        e += 1
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    letters = lambda cuts: [divmod(zlib.crc32(raw[a:b]) & 0xFFF, 64) for a, b in zip([0, *cuts], cuts, strict=False)]
    return ":".join([str(e), *("".join(alphabet[x] + alphabet[y] for x, y in letters(ends(k)) if raw) for k in (e, e + 1))])


def _edit_likeness(one, other):
    """Likeness by a table of edit distances, insertions and deletions."""
    pairs = lambda s: [s[i : i + 2] for i in range(0, len(s), 2)]
    (e, *a), (f, *b) = one.split(":"), other.split(":")
    at = {int(e) + i: pairs(s) for i, s in enumerate(a)}, {int(f) + i: pairs(s) for i, s in enumerate(b)}
    found = [0.0]
    for k in at[0].keys() & at[1].keys():
        x, y = at[0][k], at[1][k]
        line = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            before, line = line, [i]
            for j, q in enumerate(y, 1):
                line.append(min(before[j] + 1, line[-1] + 1, before[j - 1] if p == q else i + j))
        found.append(1 - line[-1] / (len(x) + len(y)) if x and y else float(x == y))
    return max(found)


def test_fingerprints_against_their_definition():
    import random

    random.seed(11)
    words = ["".join(random.choices("abcdefgh é", k=random.randint(1, 9))) for _ in range(300)]
    texts = ["", "a", "é" * 9, "ab" * 40] + [" ".join(random.choices(words, k=n)) for n in (2, 30, 60, 200, 700, 1500, 3000)]
    texts += [fuzzyhash.edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    prints = [fuzzyhash.fingerprint(t) for t in texts]
    assert prints == [_piecewise(t) for t in texts]
    for a in prints:
        for b in prints:
            assert fuzzyhash.likeness(a, b) == pytest.approx(_edit_likeness(a, b))


def test_signatures_do_not_depend_on_steps(monkeypatch):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000))
    whole = fuzzyhash.fingerprint(text)
    monkeypatch.setattr(fuzzyhash, "_STEP", 64)
    assert fuzzyhash.fingerprint(text) == whole
    e, a, b = whole.split(":")
    assert len(a) <= 128 and len(b) <= len(a) and int(e) >= 2


def test_fuzzy_hashes_of_rows(odd, none, spark):
    got = fuzzyhash.fingerprints(odd).collect()
    rows = sorted(((i, t or "") for i, t, *_ in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        e = fuzzyhash.edited(t, following)
        f, g, h = map(fuzzyhash.fingerprint, (t, e, following))
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, fuzzyhash.likeness(f, g), fuzzyhash.likeness(f, h)))
    assert sorted(map(tuple, got), key=_key) == sorted(expected, key=_key)
    assert fuzzyhash.fingerprints(none).count() == 0
    one = fuzzyhash.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1


# pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies and more cookies in a long long sentence.</div>
<main><article><h1>Head &amp; line</h1><p>First <b>para</b>graph with&nbsp;enough text to count as content for anyone who reads it.
<p>Short.<form><input value=x>Search words</form><aside>Aside words that are long enough to look like content, sadly.</aside>
<div class="ad">Buy now</div><p>Last&#33; &copy one.</p></article><section class="comments"><p>A reader comment that is long enough to look like content as well, sadly enough.</p></section></main>
<div id="sidebar"><p>Sidebar</p></div><footer>Foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line First paragraph with enough text to count as content for anyone who reads it. Short. Last! © one."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words only", "plain words only"),
        ("<article><p>one<br>two</p>three", "one two three"),
        ("<article><p>cut &amp; off</p><p cla", "cut & off"),
        ("<article><p>a < b &am", "a < b &am"),
        ("<nav>menu</nav>", ""),
        ('<div class="content with-sidebar"><p>kept</p><div id=userComments>no</div></div>', "kept"),
        ("<article>a<span class=ad>no</span>b<iframe>no</iframe></article>", "ab"),
        ("<body><div><p>" + "Body text without an article. " * 5 + "</p><p>more</p></div><div class=footer>f</div>", "Body text without an article. " * 5 + "more"),
        ("<!-- c --><article>x<script>y</script>z</article>", "xz"),
    ],
)
def test_main_text_of_odd_pages(html, text):
    assert html_text.main_text(html) == text.strip()


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        t = got[r.page_id].text
        assert got[r.page_id].n_chars == len(t) and t == " ".join(t.split()) and "track(" not in t
        body = r.html.split("<article>")[1].split("</article>")[0]
        import html as h
        import re

        assert t == " ".join(h.unescape(re.sub(r"<[^>]*(>|$)", " ", re.sub(r"</?b>", "", body))).split())
    odd = spark.createDataFrame([(1, None, None, 3), (None, "u", "<p>x" * 3, 3), (2, "u", "", 3), (2, "u", "", 3)], "page_id long, url string, html string, text int")
    assert sorted(((r.page_id, r.text) for r in html_text.extract(odd).collect()), key=_key) == [(1, ""), (2, ""), (2, ""), (None, "x x x")]
    assert html_text.extract(odd.limit(0)).count() == 0


def test_nothing_is_fitted_to_files():
    assert not list(Path(html_text.__file__).parent.glob("*.json"))

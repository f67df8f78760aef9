from __future__ import annotations

import base64
import hashlib
import random

import pytest
import zstandard

from tidemark.llm import warc
from tidemark.llm.shared import new_path


def test_bundle_round_trip_and_random_access():
    random.seed(1)
    w = warc.Writer(frame_bytes=2000)
    payloads = [random.randbytes(random.randint(0, 900)) for _ in range(50)]
    for i, p in enumerate(payloads):
        w.add(f"<urn:page:{i}>", warc.record(i, "http://x/é", p, None))
    raw = w.bytes()
    b = warc.Bundle(raw)
    assert len(b) > 5 and [body for _, body in b.records()] == payloads
    for i in (0, 17, 49):
        fields, body = b.read(f"<urn:page:{i}>")
        assert body == payloads[i] and fields["WARC-Record-ID"] == f"<urn:page:{i}>"
    # any Zstandard reader takes the whole bundle
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(b.frame(i) for i in range(len(b)))
    with pytest.raises(ValueError):
        warc.Bundle(raw[:-1])


def test_records_that_share_an_id():
    w = warc.Writer(frame_bytes=10)
    for body in (b"one", b"two"):
        w.add("<urn:page:none>", warc.record(None, None, body, None))
    b = warc.Bundle(w.bytes())
    assert [body for _, body in b.read_all("<urn:page:none>")] == [b"one", b"two"] and b.read_all("<urn:page:3>") == []
    for name in ("<urn:page:none>", "<urn:page:3>"):
        with pytest.raises(KeyError):
            b.read(name)


def _expected(rows, least):
    top = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            top[p] = max(top.get(p, i), i)
    out = []
    n = {}
    for _, _, h in rows:
        n[(h or "").encode()] = n.get((h or "").encode(), 0) + 1
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = n[p] > 1 and p in top and i != top[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top[p] if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 4])
def test_archives(spark, least):
    rows = [(1, "http://a", "<p>one</p>"), (5, "http://b\r\nx: y", "<p>one</p>"), (3, None, "<p>one</p>"), (2, "u", None), (4, "u", ""), (6, "u", "abc"), (7, "v", "abc"), (8, "w", "ü" * 100_000), (None, "n", "<p>one</p>"), (9, "r", "same"), (9, "r", "same")]
    pages = spark.createDataFrame([(*r, b"x") for r in rows], "page_id long, url string, html string, payload binary").repartition(3)
    path = new_path(spark, "w")
    warc.write(pages, path, least, frame_bytes=500, bundle_bytes=2000)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(_expected(rows, least), key=key)


def test_empty_and_export(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = new_path(spark, "w")
    warc.write(pages, path)
    n = warc.export(spark, path, str(tmp_path))
    files = list(tmp_path.iterdir())
    assert len(files) == n and sum(len(list(warc.Bundle(f.read_bytes()).records())) for f in files) == pages.count()
    path = new_path(spark, "w")
    warc.write(pages.limit(0), path)
    assert warc.read(spark, path).count() == 0

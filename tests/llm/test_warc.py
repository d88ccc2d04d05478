"""WARC archives: exact round trips, revisits against a plain rule, members, damaged files."""

import gzip
import hashlib
import io
import json
import random
import zlib

import pytest

from voxelloom.llm import warc
from voxelloom.llm.setup import ready


def expected(rows):
    """[(page, url, html)] -> {page: (bytes, digest, type, refers)}; ids are unique here."""
    payload = {p: (h or "").encode() for p, _, h in rows}
    last = {}
    for p, data in payload.items():
        last[data] = max(last.get(data, p), p)
    return {p: (len(d), hashlib.sha1(d).hexdigest(), "response" if len(d) < 1000 or last[d] == p else "revisit", None if len(d) < 1000 or last[d] == p else last[d])
            for p, d in payload.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["", None, "short", "é" * 500, "é" * 499, "x" * 999, "x" * 1000, "\r\n\r\nWARC/1.1\r\n" * 90, "long " * 700_000, "\x00\x1f" * 600]
    return [(i, rng.choice([None, "http://a/b c\r\nX-Page-ID: 9", "http://ü/"]), rng.choice(texts) if i % 3 else f"page {i} " * 200) for i in range(150)]


def test_archives_read_back_whole(spark, rows):
    df = ready(spark).createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    files = warc.archive(df, file_bytes=1 << 20)
    assert files.count() > 5
    got = warc.read(files, payloads=True).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected(rows) and len(got) == len(rows)
    html = {p: (h or "").encode() for p, _, h in rows}
    for r in got:
        assert r.payload == (html[r.page_id] if r.record_type == "response" else None)
        if r.record_type == "revisit":
            assert html[r.refers_to] == html[r.page_id]
    for f in files.limit(3).collect():  # every member alone is a record; together they are the file
        data, at = open(f.archive, "rb").read(), 0
        for entry in map(json.loads, open(f['index'])):
            assert entry["offset"] == at
            one = zlib.decompress(data[at:at + entry["length"]], wbits=31)
            assert one.startswith(b"WARC/1.1\r\nWARC-Type: " + entry["type"].encode()) and one.endswith(b"\r\n\r\n")
            at += entry["length"]
        assert at == len(data) and gzip.decompress(data).count(b"\r\nWARC-Record-ID: ") == f.records + 1


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    same = "y" * 2000
    rows = [(7, "u", same, "a"), (7, "u", same, "b"), (None, "u", same, "c"), (3, "u", same, "d"), (None, None, None, "e")]
    df = ready(spark).createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(1)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.read(warc.archive(df)).collect())
    assert got == [(-1, "response", None), (-1, "revisit", 7), (3, "revisit", 7), (7, "response", None), (7, "revisit", 7)]
    assert warc.read(warc.archive(df.limit(0))).count() == 0


def _one(payload: bytes) -> bytes:
    return warc.head({"WARC-Type": "response", "WARC-Record-ID": f"<{len(payload)}>", "Content-Length": str(len(payload))}) + payload + b"\r\n\r\n"


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_streams_of_one_or_many_members(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    blocks = [b"HTTP/1.1 200\r\nA: b\r\n\r\n" + bytes([65 + i]) * n for i, n in enumerate((0, 1, 50, 3000))]
    plain = [_one(b) for b in blocks]
    for data in (gzip.compress(b"".join(plain)), b"".join(map(gzip.compress, plain)), gzip.compress(plain[0]) + gzip.compress(b"".join(plain[1:]))):
        sink = io.BytesIO()
        entries = list(warc.rewrite(io.BytesIO(data), sink, {f"<{len(blocks[3])}>": {"WARC-Refers-To": "<x>"}}))
        out = sink.getvalue()
        members = [zlib.decompress(out[e["offset"]:e["offset"] + e["length"]], wbits=31) for e in entries]
        assert members[:3] == plain[:3]
        assert b"WARC-Type: revisit" in members[3] and members[3].endswith(b"\r\n\r\nHTTP/1.1 200\r\nA: b\r\n\r\n\r\n\r\n")


def test_torn_streams_are_refused():
    data = gzip.compress(_one(b"z" * 5000) + _one(b"q" * 100))
    whole = _one(b"z" * 5000)
    for bad in (data[:-20], gzip.compress(whole[:-300]), gzip.compress(b"no record\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.rewrite(io.BytesIO(bad), io.BytesIO(), {}))
    assert list(warc.rewrite(io.BytesIO(b""), io.BytesIO(), {})) == []

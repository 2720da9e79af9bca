"""WARC: round trips, revisits, foreign archives, assembly by either link, edge rows."""

import base64
import gzip
import hashlib

import pytest
from pyspark.errors import PythonException

from movecheck.llm import queries, warc
from movecheck.session import scratch_folder

KINDS = "page_id bigint, url string, html string, type string, digest int"


def _page_of(row):
    return row.metadata[0].payload.decode().removeprefix("page-id: ").strip()


def _round(spark, rows, **options):
    path = scratch_folder(spark)
    warc.write_archives(spark.createDataFrame(rows, KINDS), path, **options)
    return path, warc.captures(spark, path).collect()


def _digest(payload):
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_round_trip(spark):
    texts = ["plain", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "é日本\n\r\n", "", None, "plain", "x" * 3_000_000, "plain"]
    rows = [(10 - i, f"https://h{i}.example/p/{i}?q=é#f", t, "clash", 1) for i, t in enumerate(texts)]
    path, found = _round(spark, rows, archive_bytes=1_000_000)
    pages = {_page_of(r): r for r in found}
    assert len(found) == len(pages) == len(rows)
    by_id = {r.record_id: r for r in found}
    for page, url, text, *_ in rows:
        row = pages[str(page)]
        payload = (text or "").encode()
        smallest = min(p for p, _, t, *_ in rows if (t or "") == (text or ""))
        assert row.type == ("response" if smallest == page else "revisit") and row.target_uri == url
        assert row.payload_digest == _digest(payload)
        assert bytes(row.payload) == (payload if smallest == page else b"")
        if row.type == "revisit":
            assert _page_of(by_id[row.refers_to]) == str(smallest)
        assert f"Content-Length: {len(payload)}" in row.http_head and len(row.requests) == len(row.metadata) == 1
        assert row.requests[0].http_head.startswith(f"GET /p/{10 - page}?q=é HTTP/1.1\r\nHost: h{10 - page}.example")
    # Other software finds the same records: plain gzip, lengths that add up.
    names = [f for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert len(names) > 1
    for file in names:
        data = gzip.decompress(bytes(file.content))
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            length = int(next(line for line in head.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
            assert head.startswith(b"WARC/1.1\r\n") and data[length : length + 4] == b"\r\n\r\n"
            data = data[length + 4 :]


def test_small_payloads_stay_whole(spark):
    rows = [(1, "u", "same", "", 0), (2, "u", "same", "", 0), (3, "u", "longer same", "", 0), (4, "u", "longer same", "", 0)]
    _, found = _round(spark, rows, min_revisit_bytes=5)
    assert {_page_of(r): r.type for r in found} == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_edge_rows(spark):
    rows = [(None, None, "t", None, None), (7, "a\r\nWARC-Type: x", "t", None, None), (7, "a\r\nWARC-Type: x", "t", None, None)]
    _, found = _round(spark, rows)
    kinds = sorted((_page_of(r), r.type, r.target_uri or "") for r in found)
    assert kinds == [("", "revisit", ""), ("7", "response", "a%0D%0AWARC-Type: x"), ("7", "revisit", "a%0D%0AWARC-Type: x")]
    _, found = _round(spark, [])
    assert found == []


def _written(folder, name, parts, packed=False):
    body = []
    for fields, block in parts:
        head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
        record = head.encode() + block + b"\r\n\r\n"
        body.append(gzip.compress(record) if packed else record)
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(b"".join(body))


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives(spark, tmp_path, packed):
    # The response names the request, two metadata records name the response, one names nothing.
    parts = [
        ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: other\r\n"),
        ([("warc-type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Concurrent-To", "<q>"), ("Content-Type", "application/http;msgtype=response")],
         b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody \xff\x00"),
        ([("WARC-Type", "request"), ("WARC-Record-ID", "<q>"), ("Content-Type", "application/http")], b"GET / HTTP/1.1\r\n\r\n"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m2>"), ("WARC-Concurrent-To", "<r>"), ("WARC-Concurrent-To", "<s>")], b"two"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m1>"), ("WARC-Concurrent-To", "<r>")], b"one"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m0>")], b"alone"),
        ([("WARC-Type", "resource"), ("WARC-Record-ID", "<s>"), ("WARC-Target-URI", "file:///x"), ("X", "a\r\n  folded")], b"raw\r\n\r\nraw"),
    ]
    _written(tmp_path / "w", "a.warc.gz" if packed else "a.warc", parts[:4], packed)
    _written(tmp_path / "w", "b.warc", parts[4:])
    found = {r.record_id: r for r in warc.captures(spark, str(tmp_path / "w")).collect()}
    assert found.keys() == {"<r>", "<s>"}
    assert bytes(found["<r>"].payload) == b"body \xff\x00" and found["<r>"].http_head == "HTTP/1.1 200 OK\r\nA: b"
    assert [m.record_id for m in found["<r>"].metadata] == ["<m1>", "<m2>"]
    assert [m.record_id for m in found["<r>"].requests] == ["<q>"]
    assert bytes(found["<s>"].payload) == b"raw\r\n\r\nraw" and [m.record_id for m in found["<s>"].metadata] == ["<m2>"]
    assert found["<s>"].requests == [] and warc.records(spark, str(tmp_path / "w")).count() == 7


def test_broken_archive_is_named(spark, tmp_path):
    _written(tmp_path / "w", "cut.warc", [([("WARC-Type", "resource")], b"whole")])
    file = tmp_path / "w" / "cut.warc"
    file.write_bytes(file.read_bytes()[:-7])
    with pytest.raises(PythonException, match="cut.warc"):
        warc.records(spark, str(tmp_path / "w")).collect()


def test_query_over_copies(spark, tmp_path):
    rows = [(i, f"http://a/{i}", ["same", "", None, f"own {i}"][i % 4], "", 0) for i in range(40, 0, -1)]
    spark.createDataFrame(rows, KINDS).write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r for r in queries.op13_warc(spark, str(tmp_path)).collect()}
    firsts = {}
    for page, _, text, *_ in sorted(rows):
        payload = (text or "").encode()
        first = firsts.setdefault(payload, page)
        row = found[page]
        assert (row.payload_bytes, "sha1:" + row.payload_digest) == (len(payload), _digest(payload))
        assert (row.record_type, row.refers_to) == (("response", None) if first == page else ("revisit", first))

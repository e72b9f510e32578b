"""WARC transactions: round trips, joins by identifiers, other archives and odd rows."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from seepage.llm import warc as A

SCHEMA = "page_id long, url string, html string, key string, row int, payload string, record_id string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 1, "p", "r") for i, u, h in rows], SCHEMA)


ROWS = [
    (1, "http://a.example/x?y=1", "one"), (2, "http://a.example/", "two"), (5, "http://b.example/", "one"), (4, "u", "one"),
    (7, None, None), (6, "http://[bad", ""), (8, "http://c.example/é\r\nX-Evil: 1", "é" * 200_000), (None, "n", "zero"), (9, "n", "zero"),
    (10, "same", "again"), (10, "same", "again"), (11, "http://t/", "line\r\n\r\nWARC/1.1\r\n"), (None, "m", "alone"),
]


def test_round_trip(spark):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in A.archived(pages(spark, ROWS)).collect()), key=str)
    last = {}
    for i, _, h in ROWS:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want, used = [], set()
    for i, _, h in ROWS:
        h = h or ""
        first = (-1 if i is None else i) == last[h] and h not in used
        used |= {h} if first else set()
        want.append((i, len(h.encode()), digest(h), "response" if first else "revisit", None if first else last[h]))
    assert got == sorted(want, key=str)


def test_small_payloads_are_not_revisited(spark):
    got = A.archived(pages(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "long"), (4, "d", "long")]), least_bytes=2)
    assert sorted((r.page_id, r.record_type) for r in got.collect()) == [
        (1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_payloads_and_nested_rows(spark, tmp_path):
    manifest = A.write_warc(pages(spark, ROWS), str(tmp_path), file_bytes=500)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == 3 * len(ROWS)
    rows = A.captures(spark, str(tmp_path)).collect()
    assert len(rows) == len(ROWS) and all(r.request and r.metadata for r in rows)
    held = {r.metadata.fields.get("page-id"): r for r in rows}
    assert held["8"].response.payload.decode() == "é" * 200_000
    assert held["8"].response.uri == "http://c.example/é%0D%0AX-Evil:%201" and held["7"].response.uri is None
    assert held["11"].response.payload == b"line\r\n\r\nWARC/1.1\r\n"
    assert held["1"].request.http_headers.startswith("GET /x?y=1 HTTP/1.1") and held["1"].record_type == "revisit"
    assert held["1"].refers_to == held["5"].record_id and held["1"].response.payload is None


def test_empty_table(spark):
    assert A.archived(pages(spark, []).limit(0)).count() == 0


def record(kind, name, block=b"", *more, content="application/http"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"Content-Type: {content}", *more, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\nbody"


def test_transactions_across_files(spark, tmp_path):
    """The response may name the request, a metadata record the request, and their files differ; one file is cut, one not packed."""
    files = {
        "a.warc": record("response", "r1", HTTP, "WARC-Concurrent-To: <q1>") + b"\r\n" + record("response", "r2", HTTP)
                  + record("response", "r1", HTTP, "WARC-Concurrent-To: <q1>"),
        "deep/b.warc.gz": gzip.compress(record("request", "q1", b"GET / HTTP/1.1\r\n\r\n")) + gzip.compress(
            record("metadata", "m1", b"via: here\r\nno field", "warc-concurrent-to: <q1>", content="application/warc-fields")),
        "c.warc.gz": gzip.compress(record("request", "q2", b"", "WARC-Concurrent-To: <r2>") + record("request", "q3", b"", "WARC-Concurrent-To: <r2>")
                                   + record("request", "lost", b"", "WARC-Concurrent-To: <nowhere>") + record("metadata", "bare")),
        "cut.warc.gz": gzip.compress(record("response", "r9", HTTP) + record("response", "r10", HTTP))[:-30],
        "chunks.WARC": record("response", "r4", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"),
        "not.txt": b"WARC",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    records = A.read_records(A.archive_files(spark, str(tmp_path)))
    assert [r.file.rsplit("/", 1)[1] for r in records.where("error IS NOT NULL").collect()] == ["cut.warc.gz"]
    rows = A.captures(spark, str(tmp_path)).collect()
    by = {r.record_id: r for r in rows}
    assert len(rows) == len(by) and set(by) >= {"<r1>", "<r2>", "<r4>", "<q3>", "<lost>", "<bare>"}
    assert by["<r1>"].request.record_id == "<q1>" and by["<r1>"].metadata.fields == {"via": "here"}
    assert by["<r2>"].request.record_id == "<q2>" and by["<q3>"].response is None and by["<q3>"].request.concurrent_to == ["<r2>"]
    assert (by["<r2>"].response.http_status, by["<r2>"].response.payload) == (404, b"body")
    assert by["<lost>"].record_type == "request" and by["<bare>"].metadata is not None
    assert bytes(by["<r4>"].response.payload) == b"Wikipedia"


def test_a_damaged_own_file_is_told(spark, tmp_path):
    manifest = A.write_warc(pages(spark, ROWS), str(tmp_path))
    path = tmp_path / manifest.first().file
    path.write_bytes(path.read_bytes()[:-40])
    with pytest.raises(ValueError, match="records of"):
        A.captures(spark, str(tmp_path), files=manifest)

"""WARC archives: an exact round trip, revisits, foreign archives."""

from __future__ import annotations

import gzip
import hashlib

import pytest

from shelfmark.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first int"
LONG = "<p>é</p>" * 40
TRAP = "x" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.fixture
def pages(spark):
    rows = [
        (5, "http://a.example/x?y=1", LONG),
        (3, "http://a.example/\r\nz", LONG),
        (9, None, LONG),
        (1, "http://b.example", "short"),
        (2, "http://b.example", "short"),
        (4, "http://c.example", None),
        (6, "http://c.example", ""),
        (7, "http://c.example", TRAP),
        (8, "http://d.example", "line\nends\r\n\r\n" + "y" * 200),
        (8, "http://d.example", "line\nends\r\n\r\n" + "y" * 200),
        (None, "http://e.example", LONG),
        (None, "http://e.example", "nobody" * 30),
    ]
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartition(3)


def plain(rows):
    out = []
    for r in rows:
        data = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "") == (r.html or "") and x.page_id is not None]
        first = min(same, default=None) if len(data) >= 100 else r.page_id
        again = first is not None and r.page_id != first
        out.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, pages, tmp_path):
    warc.write(pages, f"{tmp_path}/w")
    found = warc.read(spark, f"{tmp_path}/w")
    assert sorted((tuple(r) for r in warc.summary(found).collect()), key=str) == plain(pages.collect())
    payloads = {r.page_id: bytes(r.payload).decode() for r in captured(found) if r.page_id and r.payload is not None}
    assert payloads[7] == TRAP
    assert payloads[3] == LONG
    assert 5 not in payloads


def captured(found):
    return warc.assemble(found).select(
        warc.field(warc.F.col("metadata.fields"), "page_id").cast("long").alias("page_id"), "response.payload", "request"
    ).collect()


def test_every_capture_has_its_request(spark, pages, tmp_path):
    warc.write(pages, f"{tmp_path}/w")
    found = captured(warc.read(spark, f"{tmp_path}/w"))
    assert len(found) == pages.count()
    assert all(r.request.http.startswith("GET ") for r in found)


def record(kind, name, block, *more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """A member for each record, a plain file, kinds that are not assembled, and captures without company."""
    info = record("warcinfo", "<i>", b"software: x")
    answer = record("response", "<r>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", "WARC-Target-URI: http://x.example/")
    asked = record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r>")
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, (info, answer, asked))))
    (tmp_path / "plain.warc").write_bytes(record("response", "<s>", b"HTTP/1.1 404 No\r\n\r\n"))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = {r.record_id: r for r in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r>", "<s>"}
    assert bytes(got["<r>"].response.payload) == b"body"
    assert got["<r>"].request.record_id == "<q>"
    assert got["<s>"].request is None


def test_damage_is_told(spark, tmp_path):
    (tmp_path / "cut.warc").write_bytes(record("response", "<r>", b"HTTP/1.1 200 OK\r\n\r\nbody")[:-12])
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, str(tmp_path)).collect()


def test_nothing(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/w")
    assert warc.summary(warc.read(spark, f"{tmp_path}/w")).count() == 0


def test_revisits_take_what_they_refer_to_from_the_record_itself(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nbody"
    made = [
        record("response", "<r>", body),
        record("metadata", "<m1>", b"page_id: 7", "WARC-Concurrent-To: <r>"),
        record("revisit", "<v>", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <r>"),
        record("metadata", "<m2>", b"page_id: 9", "WARC-Concurrent-To: <v>"),
        record("revisit", "<w>", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <elsewhere>"),
    ]
    for i, data in enumerate(made):
        (tmp_path / f"{i}.warc").write_bytes(data)
    got = {(r.page_id, r.record_type): (r.payload_bytes, r.refers_to) for r in warc.summary(warc.read(spark, str(tmp_path))).collect()}
    assert got == {(7, "response"): (4, None), (9, "revisit"): (4, 7), (None, "revisit"): (None, None)}

"""ARC files of both versions, their conversion, and the query against its SQL."""

import hashlib

import pytest

from earmark.llm import archives
from earmark.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

PAGE = "<html>" + "é" * 60 + "</html>"
PAGES = [(5, "http://a.example/x y", PAGE, "v"), (3, "http://b.example/", PAGE, "v"), (9, None, PAGE, "v"), (1, "http://c.example/", "tiny", "v"),
         (2, "http://d.example/", "tiny", "v"), (4, "http://e.example/\n", None, "v"), (6, "http://f.example/", "", "v"),
         (None, "http://g.example/", PAGE, "v"), (7, "http://h.example/", "x" * 99, "v"), (8, "http://i.example/", "x" * 99, "v"),
         (10, "http://j.example/", "y" * 100, "v"), (11, "http://k.example/", "y" * 100, "v"), (12, "u", "line\r\n\r\nWARC/1.1\r\n" * 30, "v")]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, version, compress):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(3)
    arc = archives.write_arc(pages, version=version, compress=compress)
    rows = archives.read_warc(archives.arc_to_warc(arc, compress=compress)).collect()
    by_id = {r.record_id: r for r in rows}
    assert len(by_id) == len(rows) == len(PAGES)
    first = {PAGE: 3, "y" * 100: 10}
    for key, url, html, _ in PAGES:
        r = next(r for r in rows if r.key == key)
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r.uri == archives.clean_url(url) and r.date == "1996-01-01T00:00:00Z"
        if html in first and first[html] != key:
            assert r.record_type == "revisit" and by_id[r.refers_to_id].key == first[html]
        else:
            assert r.record_type == "response" and r.refers_to_id is None
    assert archives.read_warc(archives.arc_to_warc(archives.write_arc(pages.where("false")))).count() == 0


def arc(version, *records):
    return archives.arc_version_block("t.arc", version, "19970101") + b"\n" + b"\n".join(records)


def test_parser_of_odd_records():
    one = archives.arc_record(1, "http://a b/c d", "1.2.3.4", "199702", "text/html", 200, b"HTTP/1.0 200 OK\n\nbody\n\nmore", 0, "t")
    two = archives.arc_record(1, "dns:host", "-", "19970203040506", "text/dns", 200, b"1.2.3.4", 0, "t")
    rows = list(archives.parse_arc(arc(1, one, b"", two, one[:-4])))
    assert [r["URL"] for r in rows] == ["http://a b/c d", "dns:host", "http://a b/c d"]
    assert [r["truncated"] for r in rows] == [False, False, True] and rows[0]["body"].endswith(b"more")
    assert archives.split_http(rows[0]["body"])[1] == b"body\n\nmore" and archives.split_http(rows[1]["body"]) is None
    rows = list(archives.parse_arc(arc(2, archives.arc_record(2, "http://x/", "0.0.0.0", "1997", "text/html", 404, b"HTTP/1.0 404\r\n\r\n", 7, "t"))))
    assert (rows[0]["Result-code"], rows[0]["Offset"], rows[0]["Filename"]) == ("404", "7", "t")
    assert archives.iso_date("1997") == "1997-01-01T00:00:00Z" and archives.iso_date("19970203040506") == "1997-02-03T04:05:06Z"
    with pytest.raises(ValueError):
        list(archives.parse_arc(b"http://x/ 1 2 3 4\n"))


def test_converted_headers():
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\ndata"
    r = next(archives.parse_arc(arc(1, archives.arc_record(1, "http://x/", "9.9.9.9", "20000102030405", "text/html", 200, body, 0, "t"))))
    (h, block), = archives.parse_warc(archives.converted(r, "t.arc", None))
    assert h["warc-type"] == "response" and block == body and h["warc-ip-address"] == "9.9.9.9"
    assert h["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"data").hexdigest()
    (h, block), = archives.parse_warc(archives.converted(r, "t.arc", ("urn:uuid:1", "http://y/", "2000-01-01T00:00:00Z")))
    assert h["warc-type"] == "revisit" and block == body[:-4] and h["warc-refers-to"] == "<urn:uuid:1>"
    dns = next(archives.parse_arc(arc(1, archives.arc_record(1, "dns:x", "-", "2000", "text/dns", 200, b"1.1.1.1", 0, "t"))))
    (h, block), = archives.parse_warc(archives.converted(dns, "t.arc", None))
    assert h["warc-type"] == "resource" and h["content-type"] == "text/dns" and block == b"1.1.1.1"


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op10_arc_to_warc"
    ok, note = compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name])
    assert ok, note


def test_tasks_follow_files_and_hot_payloads_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(archives, "FILE_BYTES", 1 << 12)
    hot = "<p>" + "one payload " * 20
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", hot if i % 3 == 0 else f"{i} " + "z" * 400) for i in range(300)],
                                  "page_id long, url string, html string").repartition(2)
    manifest = archives.write_arc(pages, compress=False)
    files = manifest.count()
    assert files > 16
    warc = archives.arc_to_warc(manifest, compress=False)
    found = archives.read_warc(warc)
    assert found.rdd.getNumPartitions() == archives.arc_records(manifest).rdd.getNumPartitions() == files
    kinds = {r.key: r.record_type for r in found.collect()}
    assert kinds == {i: "revisit" if i % 3 == 0 and i else "response" for i in range(300)}

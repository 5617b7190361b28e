import gzip
import hashlib

import pytest

from skuforge.llm import common, warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_by_declared_lengths(version):
    docs = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\nhttp://looks like a header 1 2 3\n", b"", b"\n\n\xff\x00", b"x" * 200_000]
    raw = b"\n".join([warc.arc_version_block(version, "t"), *(warc.arc_record(version, f"http://h/{i} x", d) for i, d in enumerate(docs))]) + b"\n"
    for content in (raw, gzip.compress(raw), gzip.compress(raw[:100]) + gzip.compress(raw[100:])):
        got = list(warc.read_arc(content))
        assert [r["document"] for r in got[1:]] == docs and got[0]["URL"].startswith("filedesc:")
        assert got[2]["URL"] == "http://h/1%20x" and {r["version"] for r in got} == {version}
    with pytest.raises(ValueError):
        list(warc.read_arc(raw[:-10]))


def test_dates_and_identifiers():
    assert warc.iso_date("19961231235958") == "1996-12-31T23:59:58Z" and warc.iso_date("1999") == "1999-01-01T00:00:00Z"
    assert warc.record_id(1) == warc.record_id("1") != warc.record_id(2) and warc.record_id(1).startswith("urn:uuid:")
    block = b"HTTP/1.1 200 OK\r\n\r\nhello\r\n\r\nWARC/1.0\r\n"
    made = warc.warc_record("response", block, {"WARC-Target-URI": "http://x/"}, warc.record_id(1), warc.iso_date("2001"))
    (fields, got), (_, again) = warc.read_warc(made + b"\r\n\r\n" + made + b"\r\n\r\n")
    assert got == again == block and fields["WARC-Type"] == "response"


def test_pages_through_both_archives(spark):
    big, other = "é<p>" * 400, "z" * 999
    rows = [(1, "http://a/ b", big, "x"), (2, None, big, "x"), (3, "http://c", other, "x"), (4, "http://c", other, "x"), (5, "u", None, "x"), (6, "u", "", "x"), (None, "u", big, "x"), (7, "u", "a\r\n\r\nWARC/1.0\r\n", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string").repartition(3)
    for version in (1, 2):
        got = sorted((tuple(r) for r in warc.archive(pages, version=version).collect()), key=str)
        want = []
        for key, _, html, _ in rows:
            p = (html or "").encode()
            revisit = html == big and key != 2
            want.append((key, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
        assert got == sorted(want, key=str)
    assert warc.archive(pages.limit(0)).count() == 0


def test_payloads_survive(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, "http://b", "")], "page_id long, url string, html string")
    work = common.Workspace(spark, "warc-test")
    arc, out = work.folder("arc"), work.folder("warc")
    warc.write_arc(pages, arc)
    warc.convert(spark, arc, out, work)
    got = {int(r.key): bytes(r.payload).decode() for r in warc.warc_records(spark, out).collect()}
    assert got == {1: "<p>é</p>", 2: ""}

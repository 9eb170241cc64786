"""WARC archives: exact round trip, revisits against plain Python."""

import base64
import hashlib

import duckdb
import pytest
from motorisk.llm import warc
from motorisk.llm.queries import ORACLE
from motorisk.sources.files import scratch_dir

SCHEMA = "page_id long, url string, html string"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def pages(n):
    return ([(i, f"http://x.org/{i} {i}\n", ["same", "", None, f"page {i} é🙂", TRICKY, TRICKY + str(i)][i % 6]) for i in range(n)]
            + [(5000, None, None), (5001, "", "same"), (5002, "http://long.org/", "lang " * 300_000)])


def brute(rows, min_bytes=0):
    best = {}
    for page, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), page)
    out = set()
    for page, _, html in rows:
        data = (html or "").encode()
        first = best[html or ""]
        again = first != page and len(data) >= min_bytes
        out.add((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return out


def result(df, **more):
    return {tuple(r[c] for c in COLUMNS) for r in warc.archived_pages(df, **more).collect()}


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_against_plain_python(spark, min_bytes, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    rows = pages(400)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5), min_bytes=min_bytes) == brute(rows, min_bytes)


@pytest.mark.parametrize("compression", ["gzip", None])
def test_round_trip_and_fresh_headers(spark, compression):
    rows = pages(60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    raw, kept = scratch_dir(spark, "warc-test"), scratch_dir(spark, "warc-test")
    warc.write_archives(df, raw, date="2024-01-02T03:04:05Z", compression=compression)
    back = {r.page_id: r for r in warc.read_archives(spark, raw, payload=True).collect()}
    assert {p: bytes(r.payload).decode() for p, r in back.items()} == {p: h or "" for p, _, h in rows}
    assert all(r.record_type == "response" and r.date == "2024-01-02T03:04:05Z" for r in back.values())
    assert back[3].url == "http://x.org/3%203%0A" and back[5000].url is None and back[5001].url == ""
    warc.deduplicate(spark, raw, kept, compression=compression)
    new = {r.page_id: r for r in warc.read_archives(spark, kept, payload=True).collect()}
    assert new.keys() == back.keys()
    for r in new.values():
        if r.record_type == "revisit":
            first = next(x for x in new.values() if x.record_id == r.refers_to_record)
            assert bytes(r.payload) == b"" and first.record_type == "response" and first.payload_digest == r.payload_digest


def test_digest_by_hand():
    rec = warc.response("urn:x:1", 1, "http://a/", "2024-01-02T03:04:05Z", b"hello")
    (headers, block), = warc.parse(rec + b"\r\n\r\n")
    assert headers["warc-payload-digest"] == "sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N"
    assert int(headers["content-length"]) == len(block) and warc.payload_of(headers, block) == b"hello"
    with pytest.raises(ValueError):
        list(warc.parse(rec + b"\r\nx\r\n"))


def test_revisits_that_came_in(spark):
    """A revisit is joined to the response with its payload; one without any stays as it was."""
    raw, kept = scratch_dir(spark, "warc-test"), scratch_dir(spark, "warc-test")
    digest, lost = warc.sha1_base32(b"hello"), warc.sha1_base32(b"gone")
    recs = [warc.response("urn:x:1", 1, "http://a/1", "2024-01-01T00:00:00Z", b"hello"),
            warc.response("urn:x:4", 4, "http://a/4", "2024-01-04T00:00:00Z", b"hello"),
            warc.revisit("urn:x:9", 9, "http://a/9", "2024-01-09T00:00:00Z", digest, ("urn:x:1", "http://a/1", None)),
            warc.revisit("urn:x:8", 8, "http://a/8", "2024-01-08T00:00:00Z", lost, ("urn:x:7", None, None))]
    spark.createDataFrame([(warc.BETWEEN.join(r.decode() for r in recs),)], "archive string").coalesce(1).write.option("lineSep", warc.BETWEEN).text(raw)
    warc.deduplicate(spark, raw, kept)
    got = {r.page_id: (r.record_type, r.refers_to_record) for r in warc.read_archives(spark, kept).collect()}
    assert got == {1: ("revisit", "urn:x:4"), 4: ("response", None), 9: ("revisit", "urn:x:4"), 8: ("revisit", "urn:x:7")}


def test_nulls_repeated_rows_clashing_names_empty(spark):
    rows = [(None, None, "x"), (None, "http://a/", "x"), (7, "http://a/", "y"), (7, "http://a/", "y"), (8, "u", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0) for r in
                 warc.archived_pages(df.selectExpr("*", "1 as path", "2 as content", "3 as Archive", "4 as payload")).collect())
    assert got == [(False, 7, "response", 0), (False, 7, "revisit", 7), (False, 8, "response", 0), (True, 0, "revisit", 8), (True, 0, "revisit", 8)]
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_test_table_and_sql(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    df = spark.read.parquet(path)
    got = result(df)
    assert got == brute([tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}')")
    assert {tuple(r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_warc']})").fetchall()} == got

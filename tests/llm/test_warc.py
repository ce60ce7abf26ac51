import base64
import gzip
import hashlib
from collections import Counter

import duckdb
import pytest
from corpus import CLASHING, rows
from pyspark.sql import functions as F

from ticketlake.llm import warc
from ticketlake.llm.queries import ORACLE, QUERIES

SCHEMA = "page_id long, url string, html string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
PAGES = [
    (1, "http://a.example/x", "<p>one</p>"),
    (2, "http://b.example", "<p>one</p>"),
    (3, "https://c.example/a b\r\nc", "été \U0001f600\r\n\r\nWARC/1.1\r\n"),
    (4, None, None),
    (5, "", ""),
    (None, "http://n.example/", "<p>one</p>"),
    (6, "http://f.example/", FAKE * 3),
    (7, "http://f.example/", "x" * 400_000 + FAKE),
    (8, "http://w.example/", "WARC/1." * 5_000),
]


def frame(spark, pages, parts=2):
    table = spark.createDataFrame(pages, SCHEMA).repartition(parts)
    return table.withColumns({name: F.lit("clash") for name in CLASHING})


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def captured(spark, tmp_path, pages, **options):
    warc.write_archive(frame(spark, pages), f"{tmp_path}/a", **options)
    records = warc.read_archive(spark, f"{tmp_path}/a")
    return records, warc.assemble(records)


def test_every_page_comes_back(spark, tmp_path):
    records, captures = captured(spark, tmp_path, PAGES)
    assert Counter(r["type"] for r in rows(records.select("type"))) == {
        "request": 9, "metadata": 9, "response": 6, "revisit": 3
    }
    full = warc.referred(warc.with_payloads(captures, records), "page_id")
    found = {r["metadata"]["fields"].get("page_id"): r for r in rows(full)}
    first = {"<p>one</p>": "2", "": "5"}
    for page_id, _, html in PAGES:
        r = found[None if page_id is None else str(page_id)]
        revisit = first.get(html or "") not in (None, str(page_id))
        assert r["type"] == ("revisit" if revisit else "response")
        assert r["referred"] == (first[html or ""] if revisit else None)
        assert r["payload"].decode() == (html or "")
        assert r["response"]["payload_bytes"] == len((html or "").encode())
        assert r["response"]["payload_digest"] == digest(html)
        assert r["response"]["intact"] is (None if revisit else True)
        assert (r["n_requests"], r["n_metadata"]) == (1, 1)
    assert found["3"]["target_uri"] == "https://c.example/a%20b%0D%0Ac"
    assert found["4"]["target_uri"] is None
    assert found["1"]["request"]["http"][":status"] == "GET /x HTTP/1.1"
    assert warc.unmatched(records).count() == 0


def test_short_payloads_are_written_whole(spark, tmp_path):
    _, captures = captured(spark, tmp_path, PAGES, min_bytes=11)
    assert {r["type"] for r in rows(captures)} == {"response"}


def test_repeated_rows_keep_their_number(spark, tmp_path):
    pages = [(1, "u", "a")] * 3 + [(2, "u", "a")] * 2 + [(2, "v", "a")]
    _, captures = captured(spark, tmp_path, pages)
    found = rows(warc.referred(captures, "page_id"))
    assert Counter((r["type"], r["referred"]) for r in found) == {("response", None): 1, ("revisit", "2"): 5}


def test_no_pages(spark, tmp_path):
    _, captures = captured(spark, tmp_path, [])
    assert captures.count() == 0


def record(kind, name, block="", extra=()):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *extra, f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n").encode()


def test_foreign_archives(spark, tmp_path):
    """Either side may name the other; records cut short and parts without a capture are told."""
    members = [
        record("warcinfo", "<i>", "software: x"),
        record("response", "<r1>", "HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody",
               ["WARC-Concurrent-To: <q1>", "Content-Type: application/http; msgtype=response"]),
        record("request", "<q1>"),
        record("metadata", "<m2>", extra=["WARC-Concurrent-To: <r1>", "X-Folded: a", " b"]),
        record("metadata", "<m1>", extra=["warc-concurrent-to: <r1>"]),
        record("request", "<q2>", extra=["WARC-Concurrent-To: <nothing>"]),
        record("resource", "<r2>", "raw")[:-6],
    ]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    (tmp_path / "plain.warc").write_bytes(record("response", "<r3>", "third"))
    records = warc.read_archive(spark, str(tmp_path))
    found = {r["capture_id"]: r for r in rows(warc.with_payloads(warc.assemble(records), records))}
    assert set(found) == {"<r1>", "<r2>", "<r3>"}
    one = found["<r1>"]
    assert (one["request"]["record_id"], one["metadata"]["record_id"], one["n_metadata"]) == ("<q1>", "<m1>", 2)
    assert (one["payload"], one["response"]["status"]) == (b"body", "HTTP/1.1 200 OK")
    assert (found["<r2>"]["payload"], found["<r2>"]["response"]["intact"]) == (b"r", False)
    assert found["<r3>"]["payload"] == b"third"
    assert [r["record_id"] for r in rows(warc.unmatched(records))] == ["<q2>"]


def test_pieces_are_put_together_in_linear_time():
    body = b"WARC/1." * 200_000
    data = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    pieces = [("f", p) for p in (data * 2).split(b"WARC/1.")]
    found = list(warc.whole_records(iter(pieces)))
    assert [(len(block), complete) for _, _, block, complete in found] == [(len(body), True)] * 2


def test_query_against_sql(spark, sf_dir):
    found = QUERIES["op12_warc_transactions"](spark, sf_dir)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    expected = db.sql(ORACLE["op12_warc_transactions"])
    assert found.columns == expected.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected.fetchall(), key=str)


@pytest.mark.parametrize("text", ["", "a", "é" * 50])
def test_base32(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(warc.base32_sha1(F.col("t"))).head()
    assert row[0] == digest(text)

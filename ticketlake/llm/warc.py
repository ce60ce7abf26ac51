"""WARC archives: written one transaction per page, read back, and assembled to captures.

A page becomes three records: the request, the response (or, if another page has the same payload,
a revisit that refers to that page's response and leaves the payload out) and a metadata record.
Request and metadata name the capture in ``WARC-Concurrent-To``; :func:`assemble` joins them by
these identifiers to one nested row per capture.

Archives are written by Spark's text writer, records ended by two line breaks, so a folder of
archives appears whole or not at all and a lost task is written again. Each file is one gzip
stream, as readers accept; it isn't compressed record by record. Reading streams through a file:
pieces between version lines are put together until a record has the length that its header
states, so payloads may hold anything, version lines and whole records included, and no more than
one record and one batch is held at a time.

Defined results: a null payload is empty; a null url has no target field; a null page id has no
metadata field and is smaller than any other. Pages that agree in id, url and payload are repeated
rows: their records carry the same identifiers and each gives its own capture. If several pages
share the largest id of a payload, the one with the largest url is the response. No page gives no
record. Other columns are ignored. On reading, a record that ends before its stated length is
returned with ``complete`` false, one without identifier or header never meets another.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ticketlake.llm.common import settle
from ticketlake.operators.skew import hot_keys, salted_join

BREAK = "\r\n"
#: What every record starts with, up to the minor version.
MARK = "WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Time of capture where the pages table has none.
CAPTURED = "2000-01-01T00:00:00Z"
#: Payloads of fewer bytes are written whole even if they repeat.
MIN_REVISIT_BYTES = 0
#: Types of records that stand for a capture, and of those that belong to one.
CAPTURE_TYPES, PART_TYPES = ("response", "revisit", "resource"), ("request", "metadata")
#: Bytes of payload that a worker returns at a time.
BATCH_BYTES = 8 << 20

RECORD = pa.schema(
    [
        ("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()),
        ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
        ("target_uri", pa.string()), ("date", pa.string()), ("stated_digest", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())), ("http", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()),
        ("complete", pa.bool_()),
    ]
)
RECORD_DDL = (
    "file string, record_id string, type string, concurrent_to array<string>, refers_to string, "
    "target_uri string, date string, stated_digest string, fields map<string,string>, "
    "http map<string,string>, payload binary, payload_bytes long, digest string, complete boolean"
)


# Writing --------------------------------------------------------------------------------------


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: 60, 60 and 40 bits at a time."""
    digest = F.sha1(payload)
    digits = F.concat(
        *[
            F.lpad(F.conv(F.substring(digest, start, n), 16, 32), n * 4 // 5, "0")
            for start, n in ((1, 15), (16, 15), (31, 10))
        ]
    )
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _identifier(kind: str, page: Column) -> Column:
    """``urn:uuid`` of a record, from its kind and the page that it belongs to."""
    h = F.md5(F.concat(F.lit(kind), page))
    parts = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Version line, the headers that aren't null, the block; the writer ends the record."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block))
    return F.concat(F.concat_ws(BREAK, F.lit(f"{MARK}1"), *lines, length), F.lit(BREAK * 2), block)


def _one_line(text: Column) -> Column:
    """A header value: line breaks, tabs and blanks percent-encoded."""
    for code in (0x20, 0x0D, 0x0A, 0x09):
        text = F.replace(text, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return text


def transactions(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, captured: str = CAPTURED) -> DataFrame:
    """``record``: the three records of each row of ``pages`` (``page_id, url, html``).

    Payloads are equal if their lengths and SHA-256 are. A first pass reduces the pages to one row
    per repeated payload, combined before the shuffle; the pages meet it by payload, repeated
    payloads with many pages split over tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    read = pages.select("page_id", "url", payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    keyed = read.withColumn("_key", F.concat_ws(":", size, F.sha2("payload", 256))).withColumn(
        "_place", F.monotonically_increasing_id()
    )
    repeated = settle(
        keyed.filter(size >= min_bytes)
        .groupBy("_key")
        .agg(F.max(F.struct("page_id", "url")).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    hot = hot_keys(repeated, "_key", "_n")
    met = salted_join(keyed, repeated.drop("_n"), "_key", hot, ["_place"], "left")
    own, first = F.struct("page_id", "url"), F.col("_first")
    page = F.to_json(F.struct("page_id", "url", "_key"))
    referred = F.to_json(
        F.struct(first["page_id"].alias("page_id"), first["url"].alias("url"), F.col("_key"))
    )
    is_response = first.isNull() | own.eqNullSafe(first)
    url, date = _one_line(F.col("url")), F.lit(captured)
    capture = _identifier("capture", page)
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))
    status = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        size, F.lit(BREAK * 2),
    )
    named = [("WARC-Target-URI", url), ("WARC-Date", date)]
    held = [("WARC-Payload-Digest", digest), *named]
    response = _record(
        [
            ("WARC-Type", F.lit("response")), ("WARC-Record-ID", capture), *held,
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(status, F.col("payload")),
    )
    revisit = _record(
        [
            ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", capture), *held,
            ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", _identifier("capture", referred)),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        status,
    )
    path = F.coalesce(F.nullif(F.regexp_extract(url, "^[a-zA-Z]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract(url, "^[a-zA-Z]+://([^/]*)", 1), F.lit(""))
    request = _record(
        [
            ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _identifier("request", page)),
            ("WARC-Concurrent-To", capture), *named,
            ("Content-Type", F.lit("application/http;msgtype=request")),
        ],
        F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{BREAK}Host: "), host, F.lit(BREAK * 2)),
    )
    about = F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(BREAK))
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _identifier("metadata", page)),
            ("WARC-Concurrent-To", capture), *named,
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.coalesce(about, F.lit("")),
    )
    capture_record = F.when(is_response, response).otherwise(revisit)
    return met.select(F.explode(F.array(request, capture_record, metadata)).alias("record"))


def write_archive(
    pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, captured: str = CAPTURED
) -> None:
    """The transactions of all pages as a folder of compressed archives."""
    records = transactions(pages, min_bytes, captured)
    records.write.option("lineSep", BREAK * 2).option("compression", "gzip").text(path)


# Reading --------------------------------------------------------------------------------------


def header_fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Names in lower case and values; a line that starts with a blank continues the one before."""
    found: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and found:
            found[-1] = found[-1][0], f"{found[-1][1]} {line.decode('utf-8', 'replace').strip()}"
            continue
        name, colon, value = line.partition(b":")
        if colon:
            found.append((name.strip().lower().decode("utf-8", "replace"), value.decode("utf-8", "replace").strip()))
    return found


def stated_length(head: bytes) -> int:
    """Content-Length of a record's header; 0 if it has none that can be read."""
    text = dict(header_fields(head.split(b"\r\n"))).get("content-length", "")
    return int(text) if text.isascii() and text.isdigit() else 0


def whole_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes, bytes, bool]]:
    """``(file, header, block, complete)`` from pieces between marks, in the order of the file.

    A piece is part of the record before it while that one lacks bytes of its stated length; the
    mark that the reader took as a separator is then put back. Linear in the bytes read.
    """
    mark = MARK.encode()
    file, parts, held, needed, tail = None, [], 0, None, b""

    def record() -> Iterator[tuple[str, bytes, bytes, bool]]:
        data = mark.join(parts)
        head, _, block = data.partition(b"\r\n\r\n")
        length = stated_length(head)
        yield file, head, block[:length], needed is not None and held >= needed

    for own, piece in pieces:
        first = own != file
        missing = bool(parts) and not first and (needed is None or held < needed)
        if missing:
            parts.append(piece)
            held += len(mark) + len(piece)
            tail += mark + piece
        else:
            if parts:
                yield from record()
            # What stands before the first mark of a file is no record.
            file, parts, held, needed = own, [] if first else [piece], 0 if first else len(piece), None
            tail = piece
        if parts and needed is None:
            if b"\r\n\r\n" in tail:
                head = mark.join(parts).partition(b"\r\n\r\n")[0]
                needed = len(head) + 4 + stated_length(head)
            tail = tail[-3:]
        else:
            tail = b""
    if parts:
        yield from record()


def _row(file: str, head: bytes, block: bytes, complete: bool) -> dict:
    fields = header_fields(head.split(b"\r\n")[1:])
    named = dict(fields)
    kind = named.get("warc-type")
    http, own, payload = [], [], block
    content = named.get("content-type", "").split(";")[0].strip().lower()
    if content == "application/http":
        lines, _, payload = block.partition(b"\r\n\r\n")
        status, *rest = lines.split(b"\r\n")
        http = [(":status", status.decode("utf-8", "replace")), *header_fields(rest)]
    elif content == "application/warc-fields":
        own = header_fields(block.split(b"\r\n"))
    return {
        "file": file,
        "record_id": named.get("warc-record-id"),
        "type": kind,
        "concurrent_to": [v for name, v in fields if name == "warc-concurrent-to"],
        "refers_to": named.get("warc-refers-to"),
        "target_uri": named.get("warc-target-uri"),
        "date": named.get("warc-date"),
        "stated_digest": named.get("warc-payload-digest"),
        "fields": list(dict(own).items()),
        "http": list(dict(http).items()),
        "payload": payload,
        "payload_bytes": len(payload),
        "digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "complete": complete,
    }


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            files, values = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                yield files[i].as_py(), values[i].as_py()

    rows, size = [], 0
    for found in whole_records(pieces()):
        rows.append(_row(*found))
        size += rows[-1]["payload_bytes"] + 512
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=RECORD)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=RECORD)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, plain or compressed.

    A compressed file is read by one task, in the order of its bytes. So is a plain one if it is
    smaller than a split; larger plain files must be compressed first, and stop the read.
    """
    pieces = (
        spark.read.option("lineSep", MARK)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.when(F.col("_metadata.file_block_start") == 0, F.col("value").cast("binary"))
            .otherwise(F.raise_error(F.lit("compress archives that are larger than a split")))
            .alias("piece"),
        )
    )
    return pieces.mapInArrow(_parsed, RECORD_DDL)


# Assembly -------------------------------------------------------------------------------------


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, type, target_uri, date, refers_to, request,
    response, metadata, n_requests, n_metadata``.

    A request or metadata record belongs to a capture if either names the other in
    ``WARC-Concurrent-To``. A capture shows the ones with the smallest identifiers and counts all:
    they are combined before the shuffle, so a capture that many records name stays one row.
    ``response`` holds length and digest of the payload as read, those of the header for a revisit,
    and whether both agree; :func:`with_payloads` adds the bytes. Parts without a capture are
    returned by :func:`unmatched`.
    """
    heads = settle(records.drop("payload"))
    captures = heads.filter(F.col("type").isin(*CAPTURE_TYPES))
    by_capture = _attached(heads).groupBy("anchor").agg(
        *[
            F.min_by(F.struct("record_id", "fields", "http"), F.when(F.col("type") == kind, F.col("record_id"))).alias(kind)
            for kind in PART_TYPES
        ],
        F.count_if(F.col("type") == "request").alias("n_requests"),
        F.count_if(F.col("type") == "metadata").alias("n_metadata"),
    )
    revisit = F.col("type") == "revisit"
    stated = F.regexp_replace("stated_digest", "^sha1:", "")
    response = F.struct(
        F.element_at("http", ":status").alias("status"),
        F.when(revisit, F.element_at("http", "content-length").try_cast("long"))
        .otherwise(F.col("payload_bytes"))
        .alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("digest")).alias("payload_digest"),
        F.when(~revisit, F.coalesce(stated == F.col("digest"), F.lit(True)) & F.col("complete")).alias("intact"),
    )
    joined = captures.join(by_capture, captures["record_id"] == by_capture["anchor"], "left")
    return joined.select(
        F.col("record_id").alias("capture_id"), "type", "target_uri", "date", "refers_to",
        "request", response.alias("response"), "metadata",
        F.coalesce("n_requests", F.lit(0)).alias("n_requests"),
        F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
    )


def _attached(heads: DataFrame) -> DataFrame:
    """Requests and metadata records with the identifier that links them: ``anchor``."""
    parts = heads.filter(F.col("type").isin(*PART_TYPES)).select(
        "record_id", "type", "fields", "http", "concurrent_to"
    )
    content = ["record_id", "type", "fields", "http"]
    naming = parts.select(*content, F.explode("concurrent_to").alias("anchor"))
    named = heads.filter(F.col("type").isin(*CAPTURE_TYPES)).select(
        F.col("record_id").alias("anchor"), F.explode("concurrent_to").alias("record_id")
    )
    lookup = parts.select(*content).dropDuplicates(["record_id"])
    hot = hot_keys(named.groupBy("record_id").agg(F.count("*").alias("_n")), "record_id", "_n")
    return naming.unionByName(salted_join(named, lookup, "record_id", hot, ["anchor"]).select(*content, "anchor"))


def unmatched(records: DataFrame) -> DataFrame:
    """Requests and metadata records that belong to no capture."""
    heads = settle(records.drop("payload"))
    captures = heads.filter(F.col("type").isin(*CAPTURE_TYPES)).select(F.col("record_id").alias("anchor"))
    met = _attached(heads).join(captures, "anchor", "left_semi").select("record_id").distinct()
    return heads.filter(F.col("type").isin(*PART_TYPES)).join(met, "record_id", "left_anti")


def with_payloads(captures: DataFrame, records: DataFrame) -> DataFrame:
    """Adds ``payload``: the bytes of responses, and of revisits those that they refer to."""
    bodies = records.filter(F.col("type").isin("response", "resource")).groupBy(
        F.col("record_id").alias("_held")
    ).agg(F.first("payload").alias("payload"))
    keyed = captures.withColumn("_held", F.coalesce("refers_to", "capture_id"))
    hot = hot_keys(keyed.groupBy("_held").agg(F.count("*").alias("_n")), "_held", "_n")
    return salted_join(keyed, bodies, "_held", hot, ["capture_id"], "left").drop("_held")


def referred(captures: DataFrame, name: str) -> DataFrame:
    """Adds ``referred``: the metadata field ``name`` of the capture that a revisit refers to."""
    fields = captures.filter(F.col("type") != "revisit").groupBy(F.col("capture_id").alias("refers_to")).agg(
        F.first(F.element_at("metadata.fields", name)).alias("referred")
    )
    counts = captures.filter(F.col("refers_to").isNotNull()).groupBy("refers_to").agg(F.count("*").alias("_n"))
    hot = hot_keys(counts, "refers_to", "_n")
    return salted_join(captures, fields, "refers_to", hot, ["capture_id"], "left")

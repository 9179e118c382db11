"""WARC archives: writing captures as records, and assembling records into captures again.

A capture is three records: the request, the response (or a revisit of an earlier response with the
same payload) and a metadata record. Request and metadata name the response in WARC-Concurrent-To; the
assembly joins them through it into one nested row per capture.

Archives are written and read by Spark's text source, one record per "line": a record ends with the
line separator it was written with, and is read with the version line as separator. Where a payload
holds a version line itself, Content-Length tells that the record goes on, and the pieces are put together again;
compressed files are read by one task each, in order, one record at a time. Any bytes may be
in a payload.

Cases: null html counts as an empty payload and takes part in the revisits; a row without a page id
is a response of its own and nobody's original; all rows of the smallest page id of a payload are
responses, so repeated rows come back as often as they went in; null urls stay null; other columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm.common import batches_of, rows_of
from tallyloom.sources.workspace import new_path, stage

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"


def base32_sha1(content: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits at a time, digits of base 32 renamed."""
    digest = F.sha1(content)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """``capture, page_id, url, payload, digest, original``: the smallest page id with an equal payload.

    The originals are found from digests alone; payloads are shuffled once, by capture. Digests of one
    hot payload are combined before the shuffle and looked up in a table of the repeated ones.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    long_enough = F.octet_length("payload") >= least
    firsts = rows.where(long_enough & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    repeated = stage(firsts.where("n > 1").select("digest", "original"), "originals")
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", "original")


def _record(kind: str, record: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    lines = [F.lit(f"{VERSION}{_END}WARC-Type: {kind}{_END}WARC-Date: {DATE}{_END}WARC-Record-ID: "), record, F.lit(_END)]
    for name, value in headers:
        lines.append(F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(_END))))
    lines += [F.lit(f"Content-Type: {content_type}{_END}Content-Length: "), F.octet_length(block).cast("string")]
    return F.concat(*[x.cast("binary") for x in [*lines, F.lit(_END + _END)]], block, F.lit(_END).cast("binary"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a request, a response or revisit, and a metadata record per page under ``path``."""
    rows = with_originals(pages, least).withColumn("capture", F.expr("uuid()"))
    name = lambda part: F.concat(F.lit("<urn:uuid:"), F.col("capture"), F.lit(f"#{part}>"))
    revisits = F.col("original").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("original"))
    page, url = F.col("page_id").cast("string"), F.regexp_replace("url", "[\\r\\n]+", " ")
    body = "application/http; msgtype="
    asked = F.concat(F.lit("GET "), F.coalesce(url, F.lit("")), F.lit(f" HTTP/1.1{_END}{_END}")).cast("binary")
    head = F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}{_END}").cast("binary")
    shared = [("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    answer = _record("response", name("response"), shared, body + "response", F.concat(head, F.col("payload")))
    refers = ("WARC-Refers-To-Page", F.col("original").cast("string"))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    again = _record("revisit", name("response"), [*shared, refers, profile], body + "response", head)
    with_answer = ("WARC-Concurrent-To", name("response"))
    request = _record("request", name("request"), [with_answer, shared[0]], body + "request", asked)
    facts = F.concat(F.coalesce(F.concat(F.lit("page-id: "), page, F.lit(_END)), F.lit("")), F.lit("fetchTimeMs: 0" + _END)).cast("binary")
    metadata = _record("metadata", name("metadata"), [with_answer], "application/warc-fields", facts)
    records = F.concat(request, F.lit(_END).cast("binary"), F.when(revisits, again).otherwise(answer), F.lit(_END).cast("binary"), metadata)
    # the text source ends each "line" with the second line end that closes a record
    rows.select(records.cast("string").alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(path)


def _header(lines: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in re.sub(rb"\r\n[ \t]+", b" ", lines).split(b"\r\n") if b":" in line)
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, v in pairs}


def _whole(pieces, separator: bytes):
    """Records from the pieces between version lines; those that lie inside a block are put back."""
    held: list[bytes] = []
    size = wanted = -1
    for piece in pieces:
        if held:  # inside a block
            held += [separator, piece]
            size += len(separator) + len(piece)
        else:
            end = piece.find(b"\r\n\r\n")
            length = re.search(rb"(?:^|\r\n)content-length:[ \t]*(\d+)", piece[: end + 2], re.I) if end >= 0 else None
            if length is None:
                continue  # before the first record, or not a record
            held, size, wanted = [piece], len(piece), end + 4 + int(length[1])
        if size >= wanted:
            yield b"".join(held)
            held = []


def read(spark: SparkSession, path: str, version: str = VERSION, with_block: bool = True) -> DataFrame:
    """Records of all archives: ``record_id, type, concurrent_to, uri, digest, content_type, refers_to_page, page_id,
    payload_bytes, payload_sha1, block``.

    ``payload_bytes`` counts what follows the HTTP header, ``payload_sha1`` is taken from these bytes of a response, while
    ``digest`` is what its header says; ``block`` is null unless asked for. A record is held whole, whatever its length.
    """
    separator = f"{version}{_END}"
    schema = pa.schema(
        [(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "uri", "digest", "content_type")]
        + [("refers_to_page", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("block", pa.binary())]
    )

    def run(batches):
        import base64
        import hashlib

        def rows():
            pieces = (value for batch in batches for (value,) in rows_of(batch))
            for record in _whole(pieces, separator.encode()):
                end = record.index(b"\r\n\r\n") + 4
                header = _header(record[:end])
                block = record[end : end + int(header["content-length"])]
                kind, page, payload = header.get("warc-type"), None, None
                if kind == "metadata":
                    page = _header(block).get("page-id")
                elif kind in ("response", "revisit"):
                    payload = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
                yield (
                    *(header.get("warc-record-id"), kind, header.get("warc-concurrent-to"), header.get("warc-target-uri")),
                    *(header.get("warc-payload-digest"), header.get("content-type")),
                    _number(header.get("warc-refers-to-page")),
                    _number(page),
                    None if payload is None else len(payload),
                    base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None,
                    block if with_block else None,
                )

        yield from batches_of(rows(), schema, lambda row: len(row[-1] or b""))

    pieces = spark.read.option("lineSep", separator).text(path).select(F.col("value").cast("binary"))
    return pieces.mapInArrow(
        run,
        "record_id string, type string, concurrent_to string, uri string, digest string, content_type string, "
        "refers_to_page long, page_id long, payload_bytes long, payload_sha1 string, block binary",
    )


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture, request, response, metadata``.

    Request and metadata are led to their response through WARC-Concurrent-To, the response through its own
    id; a capture is one group of at most three records (the first of each kind by record id).
    """
    inner = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    keyed = records.select(F.coalesce("concurrent_to", "record_id").alias("capture"), F.col("type"), inner.alias("record"))
    kinds = {"request": F.col("type") == "request", "response": F.col("type").isin("response", "revisit"), "metadata": F.col("type") == "metadata"}
    return keyed.groupBy("capture").agg(*[F.min(F.when(test, F.col("record"))).alias(kind) for kind, test in kinds.items()])


def page_table(captures: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` per capture.

    A revisit has no payload in the archive: its length is that of the response it refers to. A response whose payload
    is not the one its header has the digest of is an error.
    """
    digest, own = F.substring_index("response.digest", ":", -1), F.col("response.payload_sha1")
    broken = F.raise_error(F.concat(F.lit("payload of record "), "response.record_id", F.lit(" does not have its digest")))
    answers = captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("stored_bytes"),
        F.when(own.isNull() | (own == digest), digest).otherwise(broken.cast("string")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to_page").alias("refers_to"),
    )
    answers = stage(answers, "captures")
    wanted = answers.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    lengths = answers.where("record_type = 'response'").join(wanted, "page_id", "left_semi")
    lengths = stage(lengths.groupBy("page_id").agg(F.min("stored_bytes").alias("full_bytes")).withColumnRenamed("page_id", "refers_to"), "lengths")
    joined = answers.join(lengths, "refers_to", "left")
    return joined.select("page_id", F.coalesce("full_bytes", "stored_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = f"{new_path(spark, 'warc')}-{uuid.uuid4().hex[:4]}"
    write(pages, path, least)
    return page_table(assemble(read(spark, path, with_block=False)))


#: DuckDB SQL of the query.
SQL = """
WITH pages_ AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM pages_),
coded AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT)
  >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31), 1)), 'string_agg', '') AS payload_digest FROM hashed),
firsts AS (SELECT payload_digest, min(page_id) AS original FROM coded GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM coded JOIN firsts USING (payload_digest)
"""

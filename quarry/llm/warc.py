"""WARC archives with revisit records.

Write: payload digests are computed where the pages are read; headers alone (page, digest)
are shuffled by digest to find the smallest page of each payload.  That page's record is a
response with the payload; the others are revisit records that refer to it and carry no
payload.  Records are written through Spark's own writer, so any file system that Spark
knows will do.  Pages are dealt by hash to as many files as hold ``FILE_BYTES`` of headers and
payloads each; only a record that is longer by itself makes a longer file.  Spark's writers
compress a file as one gzip member, not each record, so a reader starts at a file's beginning.

Read: files are parsed record by record by their Content-Length, and payloads go on in batches
of at most ``BATCH_BYTES`` (or one record); revisit records are joined by payload digest to the
responses that they refer to.

A payload shared by a third of all pages costs one header row for each page in the shuffle
by digest; its minimum is combined before the shuffle, and the join's hot side can be split
because the other side has one row for each digest.

Defined results: null html is an empty payload; a null page_id comes after all others when
the response is chosen; of rows with one page_id and one payload, the first is the
response and the others revisit it; null url gives ``urn:page:``; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DATE, FILE_BYTES, BATCH_BYTES, HEADER_BYTES = "2024-01-01T00:00:00Z", 32 << 20, 8 << 20, 500
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
LAST = 9223372036854775807  # stands for a null page_id in comparisons
SCHEMA = "record_id string, record_type string, page_id long, payload_digest string, refers_to_id string, payload_bytes long, payload binary"


def base32(hex_digits: Column) -> Column:
    """Upper-case base 32 of the 40 hex digits of a SHA-1."""
    groups = [F.lpad(F.conv(F.substring(hex_digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolved(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row per page: page, url, html, bytes, digest, nth, original (the page of the response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("page", F.coalesce("page_id", F.lit(LAST))).withColumn("bytes", F.octet_length("html").cast("long"))
    rows = rows.withColumn("digest", base32(F.sha1("html")))
    heads = common.materialize(rows.select("page", "digest", "bytes").distinct(), "warc-heads")
    first = common.materialize(heads.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page").alias("original")), "warc-first")
    heads = common.materialize(heads.join(first, "digest", "left").select("page", "digest", "bytes", F.coalesce("original", "page").alias("original")), "warc-resolved")
    # texts go by page and digest, which are as good as unique, never by digest
    total = heads.agg(F.sum(F.col("bytes") + HEADER_BYTES)).first()[0] or 0
    files = max(-(-total // FILE_BYTES), common.partitions(rows.sparkSession))
    rows = rows.repartition(files, "page", "digest").join(heads.drop("bytes").hint("merge"), ["page", "digest"])
    nth = F.row_number().over(Window.partitionBy("page", "digest").orderBy("url"))
    return rows.withColumn("nth", nth).withColumn("is_response", (F.col("original") == F.col("page")) & ((F.col("nth") == 1) | (F.col("bytes") < least)))


def record_id(page: Column, digest: Column, nth: Column) -> Column:
    """Stable and unique: page, place among equal rows, digest."""
    return F.concat(F.lit("urn:page:"), page.cast("string"), F.lit(":"), nth.cast("string"), F.lit(":"), digest)


def records(rows: DataFrame) -> DataFrame:
    """The text of each record, with fresh headers."""
    page = F.when(F.col("page") == LAST, F.lit("null")).otherwise(F.col("page").cast("string"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), page)), r"[\x00-\x20]", "%20")
    shared = F.concat(
        F.lit("\r\nWARC-Record-ID: <"), record_id(page, F.col("digest"), F.col("nth")),
        F.lit(">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
    )
    response = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response"), shared,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.col("bytes")).cast("string"), F.lit(END), http, F.col("html"),
    )
    original = F.when(F.col("original") == LAST, F.lit("null")).otherwise(F.col("original").cast("string"))
    revisit = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: revisit"), shared,
        F.lit("\r\nWARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: <"), record_id(original, F.col("digest"), F.lit(1)),
        F.lit(">\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http).cast("string"), F.lit(END), http,
    )
    return rows.select(F.when(F.col("is_response"), response).otherwise(revisit).alias("value"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes deduplicated archives of pages (page_id, url, html) to a folder."""
    out = records(resolved(pages, least))
    out.write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, compressed or not."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            head[key.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in a folder; the digest of a response is taken from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "page_id", "payload_digest", "refers_to_id", "payload_bytes", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        def made(rows: list[list]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        rows, held = [], 0
        for batch in batches:
            for data in batch.column(0):
                for head, block in parse(data.as_py()):
                    own = head["warc-record-id"].strip("<>")
                    page = own.split(":")[2]
                    row = [own, head["warc-type"], None if page == "null" else int(page), head["warc-payload-digest"].removeprefix("sha1:"), head.get("warc-refers-to", "").strip("<>") or None, None, None]
                    if head["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        row[3], row[5], row[6] = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), payload
                    rows.append(row)
                    held += HEADER_BYTES + len(block)
                    if held >= BATCH_BYTES:
                        yield made(rows)
                        rows, held = [], 0
        yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("content").mapInArrow(run, SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: writes archives of all pages, reads them back and resolves revisits."""
    path = common.new_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    common.release(spark)
    found = common.materialize(read(spark, path).drop("payload"), "warc-records")
    common.delete(spark, path)  # the query's own archives; write() keeps those that it is asked for
    originals = found.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), F.col("page_id").alias("_page"))
    match = (found["refers_to_id"] == originals["_id"]) & (found["payload_digest"] == originals["_digest"])
    return found.join(originals, match, "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to")
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS x FROM p),
b AS (
  SELECT page_id, payload_bytes, x, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM h),
f AS (SELECT x, min(page_id) AS first FROM h GROUP BY x)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b JOIN f USING (x)
"""

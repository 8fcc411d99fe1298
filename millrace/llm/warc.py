"""Content-addressed web archive.

``payloads`` keeps the bytes of each distinct payload once, under its SHA-256; ``headers`` keeps
the exact header bytes of every record, those of its HTTP response included. Records are put together again by joining the two on the
address, both digests are checked on the way, and what a record says is read from its bytes. Everything is DataFrame expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, shuffles_removed, text_or_empty

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 40 bits at a time, as ten hex digits and as eight base-32 ones."""
    hex_ = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hex_, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _CONV32, _BASE32)


def _described(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    payload = F.encode(text_or_empty(body_col), "UTF-8")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"address": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write one record a row (null body: empty) under ``path``.

    Of records with equal payloads of at least ``min_bytes`` bytes that with the largest page_id
    is a response and the others revisit it; a null page_id is below all others, and rows that
    repeat the largest id are all responses. Shorter payloads are all responses, their bytes still
    stored once. An empty table gives an empty archive.
    """
    rows = _described(pages, id_col, url_col, body_col)
    # only payloads that occur more than once; partial counts are summed before the shuffle, and the
    # small result is written so that the joins below can split a hot address
    shared = materialize(rows.groupBy("address").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "shared-payloads")

    first = F.col("response_id").isNull() | F.col("page_id").eqNullSafe(F.col("response_id"))
    revisit = ~first & (F.col("payload_bytes") >= min_bytes)
    # line ends in an address would end its header
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block_bytes = F.octet_length(http) + F.col("payload_bytes")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), ident(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), ident(F.col("response_id")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(block_bytes).cast("string"), F.lit("\r\n\r\n"),
        F.when(revisit, "").otherwise(http),
    )
    small = rows.withColumn("digest", base32_sha1(F.col("payload"))).select("page_id", "url", "address", "payload_bytes", "digest")
    headers = small.join(shared, "address", "left").select("address", F.encode(header, "UTF-8").alias("header"))
    kept = rows.select("page_id", "address", "payload").join(shared, "address", "left").filter(first)
    payloads = kept.select("address", "payload").dropDuplicates(["address"])
    # what was dealt to write the bytes goes before they are dealt to be read
    with shuffles_removed(pages.sparkSession):
        headers.write.option("compression", "zstd").parquet(f"{path}/headers")
        payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name: str, value: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: {value}\r\n", 1), F.lit(""))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    kept = spark.read.schema("address string, header binary").parquet(f"{path}/headers")
    return kept.select(
        "address", "header", _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"), _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"), _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
    )


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    kept = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("stored bytes do not match their address "), F.col("address")))
    return kept.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(wrong.cast("binary")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records themselves: page_id, record_type, refers_to, payload_digest as its header has them, header, record (exact bytes) and payload.

    A revisit has no block; its payload is that of the record it refers to.
    """
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    whole = F.concat("header", block, F.lit(b"\r\n\r\n"))
    return _headers(spark, path).join(_payloads(spark, path), "address", "left").select("page_id", "record_type", "refers_to", "payload_digest", "header", whole.alias("record"), "payload")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, from rebuilt records.

    A response's payload is cut out of the record's own bytes, by the lengths that its headers tell; a revisit's is the stored one. Length
    and digest are measured on that, and a record whose header tells another digest or whose bytes do not add up raises an error.
    """
    records = read_records(spark, path)
    text = F.decode("header", "ISO-8859-1")  # a character a byte
    # the record's own header ends at the first empty line, and its length is that of what follows
    block_at = F.instr(text, "\r\n\r\n") + 4
    told = F.regexp_extract(text, "\r\nContent-Length: ([0-9]+)\r\n\r\n", 1).cast("int")
    http = F.octet_length("header") - block_at + 1
    cut = F.substring("record", F.octet_length("header") + 1, told - http)
    sizes = F.octet_length("record") - 4 - (block_at - 1)
    own = F.when(F.col("record_type") == "revisit", F.col("payload")).when(told == sizes, cut).otherwise(F.raise_error(F.lit("a record's bytes do not add up")).cast("binary"))
    measured = records.select("page_id", "record_type", "refers_to", F.col("payload_digest").alias("told"), own.alias("body")).select(
        "page_id", F.octet_length("body").cast("long").alias("payload_bytes"), "told", base32_sha1(F.col("body")).alias("measured"), "record_type", "refers_to"
    )
    digest = F.when(F.col("told") == F.col("measured"), F.col("measured")).otherwise(F.raise_error(F.lit("a header's digest is not its payload's")).cast("string"))
    return measured.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to a new archive in the shared folder, put its records together again and return what they say.

    Nulls, repeated rows and empty tables are as in ``write_archive``: a null body is an empty payload, a null page_id is named none, each row is a record.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(pages, path, min_bytes)
    return read_index(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS response_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(((('0x' || substr(h, 1 + 10 * CAST(i // 8 AS INTEGER), 10))::UBIGINT >> CAST(5 * (7 - i % 8) AS UBIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to
FROM g
"""

"""Content-addressed WARC archive.

Two tables make an archive. ``headers`` has the exact WARC header and HTTP
header bytes of every record; ``payloads`` has the bytes of each distinct
payload once, keyed by ``content``. ``records`` joins them to the original
records.

Two payloads count as equal if SHA-1, SHA-256 and length all agree; ``content``
is made of the three, so a SHA-1 collision alone cannot merge two payloads.
Reading computes the stored payloads' digests anew and fails on a mismatch.

Defined results: null html is the empty payload; null url is the empty target;
rows that repeat the smallest page_id of a payload are all responses, and the
payload is stored once; a null page_id sorts after the others; an empty table
gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: RFC 4648 base 32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_sha1(hex_digest: Column) -> Column:
    """Bare upper-case base 32 of a SHA-1 in hex: each 5 hex digits are 4 characters."""
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def _content(payload: Column) -> Column:
    """The key of a payload: SHA-1, SHA-256 and length."""
    return F.concat_ws("-", F.sha1(payload), F.sha2(payload, 256), F.octet_length(payload).cast("string"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as an archive; payloads under ``min_bytes`` are never revisits.

    Which row is the response is settled on digests alone, by pre-aggregated
    minima: however many copies a payload has, no task gathers them. A second
    join, dealt by page, takes the payload bytes to the store.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("content", _content(F.col("payload")))
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("page_id"))
    first = rows.groupBy("content").agg(F.min(order).alias("first"))

    size = F.substring_index("content", "-", -1).cast("long")
    light = rows.select("page_id", "url", "content").join(first, "content")
    response = order.eqNullSafe(F.col("first")) | (size < min_bytes)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_sha1(F.substring_index("content", "-", 1))),
        F.when(~response, F.concat(F.lit(f"WARC-Profile: {_PROFILE}{CRLF}WARC-Refers-To: "), _urn(F.col("first.page_id")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.length(http) + F.when(response, size).otherwise(0)).cast("string")),
    ]
    header = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)), "UTF-8")
    light.select("page_id", header.alias("warc_header"), F.encode(http, "UTF-8").alias("http_header"), "content").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")

    key = [F.col("page_id").isNull().alias("k0"), F.coalesce("page_id", F.lit(0)).alias("k1")]
    storing = first.select("content", *[c.alias(a) for c, a in ((F.col("first.last"), "k0"), (F.coalesce("first.page_id", F.lit(0)), "k1"))])
    stored = rows.select("content", "payload", *key).join(storing, ["k1", "k0", "content"])
    once = stored.withColumn("copy", F.row_number().over(Window.partitionBy("k1", "k0", "content").orderBy("k1"))).where("copy = 1")
    once.select("content", "payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    """A named field of the WARC header; null if it is absent."""
    return F.nullif(F.regexp_extract(F.decode("warc_header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def _page_of(urn: Column) -> Column:
    text = F.regexp_extract(urn, r"^<urn:page:(-?\d+|null)>$", 1)
    return F.when(text != "null", text).cast("long")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Read an archive back: one row per record, with the full payload's size and digest.

    Both come from the stored payload bytes, computed anew, not from the
    headers; a payload whose bytes don't match its key stops the query.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    checked = payloads.select("content", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_sha1(F.sha1("payload")).alias("payload_digest"), F.when(_content(F.col("payload")) == F.col("content"), True).otherwise(F.raise_error(F.concat(F.lit("payload does not match its key "), F.col("content")))).alias("sound"))
    record_type = _field("WARC-Type")
    return headers.join(checked.where("sound"), "content").select(
        _page_of(_field("WARC-Record-ID")).alias("page_id"), "payload_bytes", "payload_digest", record_type.alias("record_type"),
        F.when(record_type == "revisit", _page_of(_field("WARC-Refers-To"))).alias("refers_to"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: (page_id, record, payload).

    ``record`` is the record's exact bytes, which end with two line ends and
    hold the payload only in a response; ``payload`` is the full payload of
    either kind.
    """
    headers = spark.read.parquet(f"{path}/headers")
    joined = headers.join(spark.read.parquet(f"{path}/payloads"), "content")
    body = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", F.concat("warc_header", "http_header", body, F.lit((CRLF * 2).encode())).alias("record"), "payload")

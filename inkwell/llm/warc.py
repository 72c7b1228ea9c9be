r"""A content-addressed web archive: payload bytes stored once, exact record headers beside them, records by joins.

`write` stores two tables. `payloads` holds each distinct payload once under its SHA-256; `headers` holds every record's
header bytes in full and the key of its payload. Payloads are equal if SHA-256, SHA-1 and length all are, and `read`
recomputes the digest of the stored bytes. Of records with equal payloads of at least `LEAST` bytes the one with the
largest page id is a response, the others are revisits of it.

Nulls and extremes: a null payload is empty; a null url has no target line; line breaks in a url are percent-encoded;
payloads may have any length that a Spark value can. Null page ids are records without an id and never the largest.
Repeated rows are all stored as records. Empty tables give empty archives; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"


def digested(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).select("*", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("size"))


def header(kind: Column) -> Column:
    """The record's header lines; a revisit names its response and has no payload of its own."""
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    name = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(kind == "revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", 0).otherwise(F.col("size")).cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws(END, *lines), F.lit(END * 2)), "UTF-8")


def write(pages: DataFrame, path: str) -> None:
    """Write the archive of pages (page_id, url, html) to the folder `path`, which all executors must share."""
    all_pages = digested(pages)
    meta = all_pages.drop("payload")
    same = ["key", "sha1", "size"]
    first = meta.groupBy(*same).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    shared = first.where((F.col("n") > 1) & (F.col("size") >= LEAST) & F.col("keeper").isNotNull())
    joined = meta.join(shared.drop("n"), same, "left")
    follows = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    typed = joined.withColumn("refers_to", F.when(follows, F.col("keeper")))
    typed.select("key", header(F.when(follows, "revisit").otherwise("response")).alias("header")).write.parquet(f"{path}/headers")
    payloads = all_pages.groupBy(*same).agg(F.first("payload").alias("payload"))
    payloads.select("key", "payload").write.parquet(f"{path}/payloads")


def field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read(spark, path: str, payload: bool = False) -> DataFrame:
    """Records of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked, the payload.

    Length and digest are those of the stored bytes; a header that disagrees with them makes the read fail.
    """
    headers, stored = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    content = stored.select("key", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.sha2("payload", 256).alias("again"), *(["payload"] if payload else []))
    number = lambda name: F.nullif(F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("bigint")
    records = headers.select("key", number("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest").alias("said"), "header")
    right = (F.col("again") == F.col("key")) & (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest")))
    checked = F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("stored payload differs from its record: "), F.col("key"))).cast("string"))
    return records.join(content, "key").select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", *(["header", "payload"] if payload else []))


def records(spark, path: str) -> DataFrame:
    """page_id and the bytes of each record: header, payload (none for a revisit) and the two line ends after it."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return read(spark, path, payload=True).select("page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))

"""WARC as a content-addressed archive.

An archive is two tables in one folder: ``headers`` holds the exact header bytes of every record,
``payloads`` holds each payload once under its SHA-256. Reading joins them, checks the digest of
the bytes that came back and returns the records; ``record_bytes`` is the record as a WARC file has it.

Payload bytes cross the network once, in the join that reads. For writing, a fixed-size bitmap of
the repeated digests tells which few rows need a look at who comes first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm.common import bitmap, materialize, split_by_bitmap
from trolley.session import checkpoint_root

MIN_REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"   # the tables have no fetch time


def new_archive(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/llm/warc-{uuid.uuid4().hex}"


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _uri(url: Column) -> Column:
    """Header-safe URI: line ends, which would end the header line, are percent-encoded."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def header() -> Column:
    """Header text of a record from page_id, url, record_type, refers_to, payload_digest and payload_bytes.

    The block of a revisit is empty; its payload is the one stored under the digest.
    """
    revisit = F.col("record_type") == "revisit"
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        _line("WARC-Target-URI", _uri(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", urn(F.col("refers_to"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))
        .otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"))


def write_archive(pages: DataFrame, root: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per row. A null html is the empty payload; a null id or url has no header line.

    Of equal payloads of ``min_revisit_bytes`` or more, rows with the smallest id are responses and
    the others revisits of it; rows without an id are revisits where some row has one. Repeated rows
    repeat their record.
    """
    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                         F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
            .withColumn("payload_digest", F.sha2("payload", 256))
            .withColumn("short", F.xxhash64("payload_digest")))
    meta = materialize(rows.select("page_id", "url", "payload_digest", "short",
                                   F.octet_length("payload").cast("long").alias("payload_bytes"),
                                   F.xxhash64("payload").alias("second")), "warc-meta")
    by_digest = meta.groupBy("payload_digest", "short").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
        (F.min("second").eqNullSafe(F.max("second")) & (F.min("payload_bytes") == F.max("payload_bytes"))).alias("same"))
    repeated = materialize(by_digest.where("copies > 1").select(
        "payload_digest", "short", "first_id",
        F.when(F.col("same"), True).otherwise(F.raise_error(F.lit("one digest, different payloads")).cast("boolean"))
        .alias("same")), "warc-repeated")
    joined = meta.join(repeated.select("payload_digest", "first_id"), "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & F.coalesce(
        ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    (joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
     .withColumn("refers_to", F.when(revisit, F.col("first_id")))
     .select("payload_digest", F.encode(header(), "UTF-8").alias("header")).write.parquet(f"{root}/headers"))
    # unrepeated payloads go to the store as they are; of repeated ones an aggregate keeps one
    marked = split_by_bitmap(rows.select("payload_digest", "short", "payload"), "short", bitmap(repeated, "short"))
    alone = marked.where(~F.col("maybe")).select("payload_digest", "payload")
    once = (marked.where("maybe").groupBy("payload_digest").agg(F.min("payload").alias("payload")))
    (alone.unionByName(once).select("payload_digest", F.encode("payload", "UTF-8").alias("payload"))
     .write.option("compression", "zstd").parquet(f"{root}/payloads"))


def _field(name: str) -> Column:
    found = F.regexp_extract(F.decode("header", "UTF-8"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """The records, rebuilt by joining headers and payloads.

    Fields come from the header text, sizes and digests from the payload bytes. A payload that does
    not have the digest of its header is an error; a header without stored payload too.
    """
    headers = spark.read.parquet(f"{root}/headers")
    payloads = spark.read.parquet(f"{root}/payloads")
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    records = headers.join(payloads, "payload_digest", "left")
    checked = F.when(F.sha2("payload", 256).eqNullSafe(F.col("payload_digest")), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload missing or changed: "), F.col("payload_digest"))))
    rid, ref = page(_field("WARC-Record-ID")), page(_field("WARC-Refers-To"))
    return records.select(
        rid.try_cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"),
        ref.try_cast("long").alias("refers_to"),
        checked.alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        "header", "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """``records`` plus ``record``: header, block (empty for a revisit) and the two closing line ends."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.withColumn("record", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")))

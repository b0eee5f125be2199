"""A content-addressed WARC archive: payload bytes once, record headers on their own, records by joining both.

``payloads`` holds each distinct payload under its SHA-256; ``headers`` holds the exact header bytes of every record.
Both are parquet tables in the shared folder. A record is header, payload and the two line ends that close it. Reading
verifies every payload against its digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacast.session import staging_folder

LEAST_REVISITED = 100
DATE = "2024-01-01T00:00:00Z"
LINE = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Where the two tables lie."""

    folder: str

    @property
    def payloads(self) -> str:
        return f"{self.folder}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.folder}/headers"


def _identifier(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(LINE))).otherwise(F.lit(""))


def write_archive(pages: DataFrame, archive: Archive, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per row.

    Of the records with the same payload of ``LEAST_REVISITED`` bytes or more, those of the smallest key are responses and the
    others revisits of it; all shorter ones are responses. A null payload is empty, a null url has no header line and line ends in
    urls are percent-encoded. Rows that repeat the smallest key are responses like it; null keys come last. The payloads travel
    once, to be stored; copies meet in a partial aggregation before that.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    named = rows.withColumn("digest", F.sha2("payload", 256))
    stored = named.groupBy("digest").agg(
        F.min("id").alias("first_id"), F.first("payload").alias("payload"),
        F.min(F.xxhash64("payload")).alias("low"), F.max(F.xxhash64("payload")).alias("high"),
    )
    same = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads with one digest")))
    stored.select("digest", "first_id", same.alias("payload")).write.option("compression", "zstd").parquet(archive.payloads)

    first = pages.sparkSession.read.parquet(archive.payloads).select("digest", "first_id")
    size = F.octet_length("payload").cast("long")
    records = named.select("id", "url", "digest", size.alias("size")).join(first, "digest")
    revisit = (F.col("size") >= LEAST_REVISITED) & ~F.col("id").eqNullSafe(F.col("first_id"))
    safe_url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1" + LINE),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _identifier(F.col("id"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", safe_url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(revisit, _identifier(F.col("first_id")))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.col("size").cast("string")),
        F.lit(LINE),
    )
    records.select("digest", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(archive.headers)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """``(digest, header, payload)`` of every record, the payload verified against its name."""
    payloads = spark.read.parquet(archive.payloads).select("digest", "payload")
    records = spark.read.parquet(archive.headers).join(payloads, "digest", "left")
    right = F.coalesce(F.sha2("payload", 256) == F.col("digest"), F.lit(False))
    return records.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))))


def record_bytes(records: DataFrame) -> DataFrame:
    """The exact bytes of each record as they stand in a WARC file; a revisit names its payload and repeats it in full."""
    end = F.lit(LINE * 2).cast("binary")
    return records.select(F.concat("header", "payload", end).alias("record"))


def _value(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def described(records: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, payload_bytes, payload_digest, record_type, refers_to)`` read from the headers, lengths checked."""
    number = r"^<urn:record:(.*)>$"
    length = F.octet_length("payload").cast("long")
    checked = F.when(_value("Content-Length").cast("long") == length, length).otherwise(F.raise_error(F.lit("a record has another length")))
    refers = F.regexp_extract(_value("WARC-Refers-To"), number, 1)
    return records.select(
        F.regexp_extract(_value("WARC-Record-ID"), number, 1).try_cast("long").alias(key),
        checked.alias("payload_bytes"),
        F.substring(_value("WARC-Payload-Digest"), 8, 64).alias("payload_digest"),
        _value("WARC-Type").alias("record_type"),
        refers.try_cast("long").alias("refers_to"),
    )


def archived(pages: DataFrame, name: str) -> DataFrame:
    """Write the archive ``name`` under the shared folder, read it back and describe its records."""
    spark = pages.sparkSession
    archive = Archive(f"{staging_folder(spark)}/{name}")
    write_archive(pages, archive)
    return described(read_records(spark, archive))

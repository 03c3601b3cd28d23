"""Content-addressed web archive.

A payload is stored once under its SHA-256; the exact header block of every record is stored apart, and the original
records come back by a join.  Writing checks that rows of one digest agree in length and in a second digest, reading
recomputes both digests from the stored bytes.

Defined cases: a null payload is empty; repeated rows (same page, address and payload) become numbered copies, the first
of which may be the response; a null page id sorts after all others, and revisits of such a record carry a null
`refers_to`; line ends inside an address are percent-encoded; other input columns are ignored; an empty table gives an
empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folder, pick, zstd

END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Two tables: `payloads` (key, payload) and `headers` (page_id, copy, key, header)."""
    path: str

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("key string, payload binary").parquet(f"{self.path}/payloads")

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("page_id long, copy long, key string, header string").parquet(f"{self.path}/headers")


def base32_sha1(hexed: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 given as 40 hex digits: four runs of 40 bits are eight base-32 digits each."""
    runs = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*runs)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")),
                    F.when(copy > 1, F.concat(F.lit(":"), copy.cast("string"))).otherwise(""), F.lit(">"))


def write_archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Archive `pages` (page_id, url, html).

    Of equal payloads of at least `min_bytes` the smallest page id is the response and the others revisit it.
    """
    spark = pages.sparkSession
    path = path or folder(spark, "warc")
    base = pick(pages, page_id="long", url="string", html="string").select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.select("page_id", "url", "payload", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha1"),
                       F.octet_length("payload").cast("long").alias("n_bytes"))

    # One row per digest: partial aggregation leaves one payload per digest and task before the shuffle.
    same = (F.min("n_bytes") == F.max("n_bytes")) & (F.min("sha1") == F.max("sha1"))
    (base.groupBy("key").agg(F.first("payload").alias("payload"), same.alias("same"))
     .select("key", F.when(F.col("same"), F.col("payload")).otherwise(
         F.raise_error(F.concat(F.lit("two payloads under digest "), F.col("key"))).cast("binary")).alias("payload"))
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))

    rows = base.groupBy("key", "sha1", "n_bytes", "page_id", "url").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    first = rows.groupBy("key").agg(F.min(order).alias("first"))
    rows = (rows.join(first, "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .withColumn("is_first", (F.col("copy") == 1) & F.col("page_id").eqNullSafe(F.col("first.page_id"))
                        & F.col("url").eqNullSafe(F.col("first.url"))))
    response = F.col("is_first") | (F.col("n_bytes") < min_bytes)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(END))

    address = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("copy"))), line("WARC-Target-URI", address),
        line("WARC-Date", F.lit(date)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("sha1")))),
        F.when(response, "").otherwise(F.concat(
            line("WARC-Refers-To", record_id(F.col("first.page_id"), F.lit(1))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, F.col("n_bytes")).otherwise(0).cast("string")), F.lit(END))
    zstd(rows.select("page_id", "copy", "key", header.alias("header")), f"{path}/headers")
    return Archive(path)


def field(header: Column, name: str) -> Column:
    """A header field's value; null where the header has none."""
    value = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(header.contains(f"{END}{name}: "), value)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record: page_id, copy, header, block (as written), payload (also of revisits), payload_sha1.

    The digests of the stored bytes must equal the key and the header's digest.
    """
    kept = archive.payloads(spark).select(
        "key", F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("key"))).cast("binary")).alias("payload"),
        base32_sha1(F.sha1("payload")).alias("payload_sha1"))
    told = F.concat(F.lit(f"{END}WARC-Payload-Digest: sha1:"), F.col("payload_sha1"), F.lit(END))
    return (archive.headers(spark).join(kept, "key").select(
        "page_id", "copy", F.when(F.col("header").contains(told), F.col("header")).otherwise(
            F.raise_error(F.concat(F.lit("header and payload disagree at "), F.col("key")))).alias("header"),
        F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b"")).alias("block"),
        "payload", "payload_sha1"))


def record_bytes(records: DataFrame) -> DataFrame:
    """The records as they stand in a .warc file."""
    return records.select("page_id", "copy", F.concat(F.encode("header", "UTF-8"), F.col("block"), F.encode(F.lit(END + END), "UTF-8")).alias("record"))


def page_digests(spark: SparkSession, archive: Archive) -> DataFrame:
    """Per page what the archive holds of it, read back from header and payload."""
    header = F.col("header")
    return read_records(spark, archive).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"),
        field(header, "WARC-Type").alias("record_type"),
        F.regexp_extract(F.coalesce(field(header, "WARC-Refers-To"), F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"))

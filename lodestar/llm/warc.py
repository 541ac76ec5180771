"""WARC as a content-addressed archive.

An archive is a folder with two Parquet tables. `payloads` holds each payload's
bytes once, by SHA-256; payloads of equal digests are verified to have equal
length and equal second digest as they are stored. `headers` holds the exact
header block of each record with the digest of its payload. Reading joins the
two on the digest, checks every payload against its digest, and gives back the
original records: header block, payload (none for a revisit) and the closing
line ends. `listing` parses those records.

Copies are found on digests alone. The payload table comes from one
aggregation by digest in which each task first drops its own copies, so a
payload that a third of all pages share travels once for each task. The joins
are between plain exchanges, which adaptive execution splits where skewed.

Defined cases: a null payload counts as empty; payloads of under `least` bytes
are always responses; of larger equal ones the smallest id is the response and
all others revisit it (a null id is largest; rows that repeat that smallest id
and payload are all responses). A null url is written as an empty target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import cut, fresh_path

#: Payloads from this many bytes on are written once and revisited.
LEAST = 100
#: Fixed values of the public WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
#: What some readers take for the end of a line, and all other controls.
BREAKS = r"[\x00-\x1F\x7F-\x9F\u2028\u2029]"


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _one_line(url: Column) -> Column:
    """The address with controls and line separators percent-encoded, so that no
    reader takes part of it for another field."""
    coded = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    each = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(BREAKS), coded(c)).otherwise(c))
    return F.when(url.rlike(BREAKS), F.array_join(each, "")).otherwise(url)


def _header(date: str) -> Column:
    """The exact header block of a record, its blank line included."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(LINE))
    return F.concat(
        F.lit(VERSION + LINE),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _one_line(F.coalesce(F.col("url"), F.lit("")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(LINE),
    ).cast("binary")


def write_archive(pages: DataFrame, folder: str | None = None, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> str:
    """Write one record per row; returns the archive's folder."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.length("payload").cast("long"))
    second = F.struct("bytes", F.md5("payload"), F.xxhash64("payload"))
    once = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(second).alias("low"), F.max(second).alias("high"))
    refused = F.raise_error(F.lit("different payloads have one digest")).cast("binary")
    once.select("digest", F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(refused).alias("payload")).write.parquet(f"{folder}/payloads")
    known = cut(rows.select("page_id", "url", "digest", "bytes"))
    shared = known.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = cut(shared.where("n > 1").select(F.col("digest").alias("of"), "first"))
    marked = known.join(shared, F.col("digest") == F.col("of"), "left")
    again = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))
    marked.select("page_id", "digest", _header(date).alias("header")).write.parquet(f"{folder}/headers")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, header, payload (in full, for revisits too) and `record`, the
    original record's bytes. A payload that does not match its digest fails."""
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").select(F.col("digest").alias("of"), "payload")
    checked = F.when(F.sha2("payload", 256) == F.col("of"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary"))
    payloads = payloads.select("of", checked.alias("payload"))
    whole = headers.join(payloads, F.col("digest") == F.col("of"), "left")
    whole = whole.withColumn("payload", F.coalesce("payload", F.raise_error(F.lit("a record's payload is not stored")).cast("binary")))
    body = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return whole.select("page_id", "header", "payload", F.concat("header", body, F.lit(LINE * 2).cast("binary")).alias("record"))


def field(header: Column, name: str) -> Column:
    """A field's value in a header block, whose lines end in CR LF and nothing
    else; null if the record has none."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"(?dm)^{name}: ([^\r\n]*)\r$", 1)
    return F.when(found != "", found)


def listing(records: DataFrame) -> DataFrame:
    """What the archive's records say: the fields of each record's own header
    block, and size and digest of its payload: a response's own block, for a
    revisit the payload that it refers to. A record whose block is not as long
    as it says, or not of the digest it says, fails."""
    kind = records.schema["page_id"].dataType
    start = F.instr(F.decode("record", "ISO-8859-1"), LINE * 2) + 3  # bytes of the header block
    parts = records.select("page_id", "payload", F.substring("record", F.lit(1), start).alias("head"), F.substring("record", start + 1, F.octet_length("record") - start - 4).alias("block"))
    said = parts.select(
        "page_id",
        field(F.col("head"), "WARC-Type").alias("record_type"),
        F.regexp_extract(field(F.col("head"), "WARC-Refers-To"), "^<urn:page:(.*)>$", 1).cast(kind).alias("refers_to"),
        F.regexp_extract(field(F.col("head"), "WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("said"),
        (F.octet_length("block") == field(F.col("head"), "Content-Length").cast("long")).alias("whole"),
        F.when(field(F.col("head"), "WARC-Type") == "revisit", F.col("payload")).otherwise(F.col("block")).alias("full"),
    )
    found = said.withColumn("digest", F.sha2("full", 256))
    wrong = F.raise_error(F.lit("a record does not hold what its header says")).cast("string")
    return found.select(
        "page_id",
        F.octet_length("full").cast("long").alias("payload_bytes"),
        F.when(F.col("whole") & (F.col("digest") == F.col("said")), F.col("digest")).otherwise(wrong).alias("payload_digest"),
        "record_type",
        "refers_to",
    )

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import warc

PAGES = [(1, "http://a", "x" * 150), (2, "http://b\r\nWARC-Type: revisit", "x" * 150), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "ü", "é" * 60), (8, "u", "é" * 60), (None, "u", "x" * 150), (9, "u", "y" * 200_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "z", 1) for p in PAGES], "page_id long, url string, html string, digest string, bytes int")


def test_records_come_back_as_written(spark, pages, tmp_path):
    folder = warc.write_archive(pages, f"file://{tmp_path}/w")
    records = {r["page_id"]: r for r in warc.read_archive(spark, folder).collect()}
    rows = {r["page_id"]: r for r in warc.listing(warc.read_archive(spark, folder)).collect()}
    first = {}
    for page, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        body = (html or "").encode()
        again = len(body) >= 100 and body in first
        first.setdefault(body, page)
        r = rows[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[body]) if again else ("response", None))
        record = bytes(records[page]["record"])
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n")
        assert record == bytes(records[page]["header"]) + (b"" if again else body) + b"\r\n\r\n"
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(h or "") for _, _, h in PAGES})


def test_damaged_payloads_are_noticed(spark, pages, tmp_path):
    folder = warc.write_archive(pages, f"file://{tmp_path}/w")
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    bad.write.parquet(f"{folder}/other")
    import shutil

    shutil.rmtree(f"{tmp_path}/w/payloads")
    shutil.move(f"{tmp_path}/w/other", f"{tmp_path}/w/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, folder).collect()


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.listing(warc.read_archive(spark, warc.write_archive(empty, f"file://{tmp_path}/w"))).count() == 0


def test_listing_reads_the_records_alone(spark, pages, tmp_path):
    """Fields come from the rebuilt records; a record that was changed fails."""
    records = warc.read_archive(spark, warc.write_archive(pages, f"file://{tmp_path}/w"))
    blind = records.withColumn("header", F.lit(b"")).withColumn("payload", F.when(F.col("record").contains(F.lit(b"Type: revisit")), F.col("payload")))
    assert sorted(map(str, warc.listing(blind).collect())) == sorted(map(str, warc.listing(records).collect()))
    cut_off = records.withColumn("record", F.expr("substring(record, 1, octet_length(record) - 1)"))
    with pytest.raises(Exception, match="does not hold"):
        warc.listing(cut_off).collect()


def test_payloads_of_one_digest_are_compared(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc.F, "sha2", lambda *_: F.lit("same"))
    with pytest.raises(Exception, match="different payloads"):
        warc.write_archive(pages, f"file://{tmp_path}/w")


def test_addresses_cannot_pass_for_fields(spark):
    fields = ["WARC-Payload-Digest: sha256:00", "WARC-Type: revisit", "Content-Length: 1", "WARC-Refers-To: <urn:page:9>", "WARC-Record-ID: x", "WARC-Date: y"]
    breaks = ["\u2028", "\u2029", "\u0085", "\r", "\n", "\r\n", "\x0b", "\x0c", "\x1c"]
    rows = [(i, f"http://a/é𝛼{b}{f}", f"<p>{i}</p>" * 30) for i, (b, f) in enumerate((b, f) for b in breaks for f in fields)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.read_archive(spark, warc.write_archive(df))
    assert {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.listing(records).collect()} == {(i, "response", None, len(h)) for i, _, h in rows}
    heads = [bytes(r["header"]).decode() for r in records.collect()]
    assert all(len(h.splitlines()) == len(h.split("\r\n")) - 1 for h in heads) and any("é𝛼%E2%80%A8WARC-Type" in h for h in heads)

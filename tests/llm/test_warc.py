import duckdb
import pytest
from pyspark.sql import functions as F

from isoreach.llm import warc

ROWS = [(5, "http://a", "<p>x</p>", 1), (3, "http://b\r\nX: y", "<p>x</p>", 2), (9, None, None, 3), (8, "u", "", None), (7, "u", "é" * 3000, 1), (7, "u", "é" * 3000, 1), (11, "u", "é" * 3000, 1)]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, refers_to int")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert [g[:3] for g in got] == [(3, 8, "response"), (5, 8, "revisit"), (7, 6000, "response"), (7, 6000, "response"), (8, 0, "response"), (9, 0, "revisit"), (11, 6000, "revisit")]
    assert [g[3] for g in got] == [None, 3, None, None, None, 8, 7]
    assert warc.round_trip(pages.limit(0)).count() == 0
    payloads = {r["page_id"]: r["payload"] for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert payloads[7] == ("é" * 3000).encode() and payloads[11] is None


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = warc.round_trip(spark.read.parquet(f"{sf}/pages.parquet"))
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    rel = c.sql(warc.SQL).select(*df.columns)
    assert sorted(map(str, rel.fetchall())) == sorted(str(tuple(r)) for r in df.collect())


def test_format():
    d = warc.train([(b"<html><body>%d" % i) * 2000 for i in range(20)])
    assert d
    w = warc.Writer(d)
    recs = [warc.record(1, "http://a", b"abc"), warc.record(2, "http://b", b"abc", 1)]
    for r in recs:
        w.add(r)
    data = w.bytes()
    assert list(warc.frames(data)) == recs
    assert list(warc.frames(b"")) == []
    assert warc.read_record(recs[1])["refers_to"] == 1
    for bad in (data[:-3], data[:20], data + b"zz", data + b"zzzzzzzz", data[:-1] + bytes([data[-1] ^ 1])):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))
    for bad in (b"", recs[0].replace(b"WARC/1.1", b"HTTP/1.1"), recs[0].replace(b"abc", b"abd"), recs[0].replace(b"WARC-Date", b"WARC-Dat"), recs[0][:-1], recs[0].replace(b"Content-Length: 3", b"Content-Length: 4"), recs[0].replace(b"WARC-Type: response", b"WARC-Type: revisit")):
        with pytest.raises(warc.WarcError):
            warc.read_record(bad)


def test_null_pages(spark):
    """Rows without an id are kept: revisits of the smallest id with their payload, else responses; columns that clash play no part."""
    rows = [(None, "a", "same", "x"), (4, "b", "same", "y"), (6, None, "same", "z"), (None, "c", "other", None), (None, "c", "other", None), (2, "d", "long " * 200_000, "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").withColumn("records", F.lit(3))
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(0, 4, "revisit", 4), (4, 4, "response", None), (6, 4, "revisit", 4), (0, 5, "response", None), (0, 5, "response", None), (2, 1_000_000, "response", None)], key=str)


def test_frame_ends():
    """Of frames of any content, with and without checksums, the end is found by block headers."""
    import random

    import zstandard

    r = random.Random(1)
    for n in (0, 1, 100, 70_000, 400_000):
        for raw in (b"a" * n, r.randbytes(n), b"".join(r.choice([b"ab ", b"cde "]) for _ in range(n // 3))):
            for check in (False, True):
                f = zstandard.ZstdCompressor(write_checksum=check).compress(raw)
                assert warc.frame_end(b"xyz" + f + b"more", 3) == 3 + len(f)

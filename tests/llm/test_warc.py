import base64
import hashlib

from pyspark.sql import functions as F

from tidewell.llm.warc import MAGIC, page_of, read_warc, write_warc


def fake(body):
    block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n{body}"
    return f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:tidewell:page:999>\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"


def trip(spark, rows, path, split=None, least=0):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "'k' as payload", "2 as n", "3 as _key", "4 as first")
    write_warc(pages.coalesce(1), path, least)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split or "128m")
    try:
        read = read_warc(spark, path)
        return [tuple(r) for r in read.select(page_of(F.col("record_id")), "type", page_of(F.col("refers_to")), "payload_bytes", "payload_digest", "payload").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def want(rows, least=0):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        revisit = len(raw) >= least and same and min(same) != i
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, "revisit" if revisit else "response", min(same) if revisit else None, len(raw), digest, None if revisit else raw))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_magic_in_payload_repeats_and_nulls(spark, tmp_path):
    rows = [(5, "http://a/ b\r\nX: y", "hi"), (3, None, "hi"), (9, "u", "hi"), (4, "u", None), (6, "u", ""), (7, "u", fake("é") + "tail " + MAGIC), (8, "u", MAGIC), (10, "u", "naïve 日本\r\n\r\n"), (None, "u", "hi"), (11, "u", fake("x") * 3)]
    assert order(trip(spark, rows, str(tmp_path / "w"))) == order(want(rows))


def test_chains_over_many_splits(spark, tmp_path):
    rows = [(i, "u", ("x" * (i * 37 % 900)) + (fake("y" * i) if i % 3 == 0 else "") + str(i)) for i in range(60)]
    assert order(trip(spark, rows, str(tmp_path / "w"), "700b")) == order(want(rows))


def test_very_long_payloads(spark, tmp_path):
    """Records over many splits, with magic inside; and many empty pages."""
    long = ("lorem " * 3000 + MAGIC) * 40
    rows = [(1, "u", long), (2, "u", "between"), (3, "u", long), (4, "u", long + "x"), *[(i, "u", None) for i in range(10, 40)]]
    assert order(trip(spark, rows, str(tmp_path / "w"), "200000b")) == order(want(rows))


def test_small_payloads_are_never_revisits(spark, tmp_path):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    assert order(trip(spark, rows, str(tmp_path / "w"), least=5)) == order(want(rows, 5))


def test_empty_table(spark, tmp_path):
    assert trip(spark, [], str(tmp_path / "w")) == []

"""Archives: written, indexed, read back, and looked up."""

import hashlib

from pyspark.sql import functions as F

from quernstone.llm import common, warc


def expected(rows):
    body = [((h or "").encode()) for _, _, h in rows]
    first = {}
    for (i, _, _), b in zip(rows, body, strict=True):
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for (i, _, _), b in zip(rows, body, strict=True):
        f = first.get(b)
        again = f is not None and i != f
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert rows_of(warc.archive_round_trip(pages)) == expected([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_odd(spark):
    long = "é" * 60
    rows = [(5, "http://a.example/x", long), (3, "https://A.example:443/x", long), (3, "https://A.example:443/x", long), (9, None, long), (None, "bad url\r\nX: y", long), (1, "", None), (2, "http://[bad", "short"), (4, "http://b.example/?q=ü a", "short"), (6, "u", "y" * 99), (7, "u", "y" * 99), (8, "u", "z" * 100), (10, "u", "z" * 100), (11, "u", "w" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("key", F.lit(2))
    assert rows_of(warc.archive_round_trip(df)) == expected(rows)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_lookup(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.concat(F.lit("http://h.example/"), (F.col("page_id") % 7).cast("string")).alias("url"), "html")
    folder = common.scratch(spark, "warc")
    index = warc.write_index(warc.write_archives(pages, folder), folder, block_lines=3)
    urls = spark.createDataFrame([("http://h.example/3",), ("http://h.example/9",), ("http://h.example/0",)], "url string")
    got = warc.lookup(urls, index, folder).collect()
    want = {(r.url, r.page_id) for r in pages.collect() if r.url[-1] in "30"}
    assert {(r.url, r.page_id) for r in got} == want and len(got) == len(want)
    assert all(r.html == h for r in got for h in [{p.page_id: p.html for p in pages.collect()}[r.page_id]] if r.record_type == "response")


def test_surt():
    assert warc.surt("https://www.Example.com/a?b=1") == b"com,example,www)/a?b=1"
    assert warc.surt("http://example.com:8080") == b"com,example:8080)/"


def test_hot_payload_and_key(spark):
    """A third of the pages share a payload and the empty key, over many blocks and parts."""
    rows = [(i, None if i % 3 else f"http://h{i}.example/", "same " * 40 if i % 3 == 1 else f"page {i} " * 20) for i in range(400, 0, -1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert rows_of(warc.archive_round_trip(df)) == expected(rows)
    folder = common.scratch(spark, "warc")
    index = warc.write_index(warc.write_archives(df, folder), folder, block_lines=7)
    reader = warc.Reader(folder, warc._parts(index))
    empty = sorted(i for i, u, _ in rows if u is None)
    assert [x[1] for x in reader.find(b"")] == empty
    for i in (1, 5, 250, 400):
        assert [x[1] for x in reader.find(b"", i)] == [x for x in empty if x >= i]
    assert rows_of(warc.read_back(spark, index, folder)) == expected(rows)

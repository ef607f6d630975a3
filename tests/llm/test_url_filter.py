import re

import duckdb
from pyspark.sql import functions as F

from modgauge.llm import url_filter as op

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.NET/en/a?x=1#y", "https://example.net", "https://a.example.com/de/x.html", "https://notexample.com/de/", "https://example.com:80/de/", "http://x.org/fr/b/",
    "http://x.org/frb", "http://y.net?q=://z.org/fr/", "http://m.site.io/a.html?utm_source=feed", "https://site.io/a", "https://site.io/a/", "https://site.io/A", "ftp://org/fr/", "http://ÄB.net/", "x://y/z?utm_source=feed",
]


def brute(url, listed):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    best = max(((len(h + p), h + p, v) for v, h, p in op.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    canon = re.sub(r"^(www|m)\.", "", host) + re.sub(r"(\.html|/)$", "", path) if host else None
    return host, path, best and best[1], best[2] if best else "block" if canon in listed and canon else "allow", canon


def rows_of(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=repr)


def check(pages):
    rows = pages.collect()
    listed = {brute(r.url, set())[4] for r in rows if "utm_source=feed" in (r.url or "")} - {None}
    want = sorted(((r.page_id, *brute(r.url, listed)[:4]) for r in rows), key=repr)
    got = op.judge(pages)
    assert rows_of(got) == want
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    assert sorted(con.execute("select page_id, host, path, rule, verdict from (" + op.ORACLE + ")").fetchall(), key=repr) == want


def test_whole_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_edges(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS + URLS)] + [(None, URLS[5], None)], "page_id long, url string, html string")
    check(pages.withColumns({c: F.lit("x") for c in ("host", "path", "_key", "_word", "listed", "_may", "rule")}).withColumn("page_id", F.coalesce("page_id", F.lit(-1))))
    assert op.judge(pages.where("false")).count() == 0 and op.judge(pages).count() == pages.count()


def test_exact_join_removes_false_positives(spark):
    pages = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    listed = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("u"))
    for bits in (1, 16):  # one bit a key lets most pages through the filter
        got = op.in_list(pages, "k", listed, bits).where("listed").count()
        assert got == 1000
    assert op.in_list(pages, "k", listed.where("false")).where("listed").count() == 0


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string, _key string, listed boolean")
    assert op.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x", "h", "k", True)], "page_id long, url string, host string, _key string, listed boolean")
    assert [(r.host, r.rule, r.verdict) for r in op.judge(one).collect()] == [("a.net", "net/", "block")]

"""The URL filter against a plain loop over all entries."""

import re

from pyspark.sql import functions as F

from colsense.llm import url_filter as uf

ENTRIES = [(e, v) for e, v in uf.RULES] + [
    ("Sub.Example.NET/en/", "block"), ("example.net/en/a", "block"), ("example.net/", "allow"), ("example.net/", "block"),
    ("co.uk", "block"), ("shop.co.uk/x/y/z", "allow"), (None, "block"), ("/only/path", "block"), ("xn--é.org/ü/", "block")]
URLS = [None, "", "no scheme", "http://", "http:///x", "http://a.net", "http://a.net/", "http://a.net?x=/", "HTTP://A.NET/#f", "ftp://net/", "http://xnet/",
        "http://example.net/en/", "http://example.net/en", "http://m.EXAMPLE.net/en/a/b", "http://sub.example.net/en/q", "http://example.net/EN/", "x://y://example.com/de/1",
        "http://example.com/de/?a", "http://example.com/d/e/", "http://foo.org/fr/", "http://org/fr/", "http://org./fr/", "http://u@a.net:80/", "http://a.b.shop.co.uk/x/y/zz",
        "http://shop.co.uk/x/y/", "http://co.uk?q", "http://co.uk", "http://é.xn--é.org/ü/ö", "http://a.org/fr/\nnew/line", "http://" + "a." * 3000 + "net/" + "d/" * 3000,
        "http://a.net/", "http://a.net/"]


def _judge(url, entries):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in entries.items()
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def _plain(entries):
    out = {}
    for e, v in entries:
        if e and not e.startswith("/"):
            host, slash, rest = e.partition("/")
            key = (re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + rest)
            out[key] = "block" if "block" in (v, out.get(key)) else "allow"
    return out


def _run(spark, urls, entries, **kw):
    u = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("site", F.lit(1))
    out = uf.judge_urls(u, uf.listed(spark.createDataFrame(entries, "entry string, verdict string")), keep=["page_id"], **kw)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def test_against_a_loop_over_the_list(spark):
    want = {i: _judge(u, _plain(ENTRIES)) for i, u in enumerate(URLS)}
    assert _run(spark, URLS, ENTRIES) == want
    # a filter of one block, full of bits, only lets more through to the exact join
    many = ENTRIES + [(f"h{i}.net/p{i % 7}/", "allow") for i in range(3000)]
    urls = URLS + [f"http://w.h{i}.net/p{i % 5}/{i}" for i in range(0, 4000, 3)]
    want = {i: _judge(u, _plain(many)) for i, u in enumerate(urls)}
    assert _run(spark, urls, many, max_blocks=1) == want == _run(spark, urls, many)


def test_filter_passes_few_others(spark):
    entries = uf.listed(spark.range(4000).select(F.concat(F.lit("h"), "id", F.lit(".net/")).alias("entry"), F.lit("block").alias("verdict")))
    probes = spark.range(20_000).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.lit("/").alias("path"))
    assert 4000 <= uf.possible_hits(probes, entries, 256).count() < 4040


def test_empty(spark):
    assert _run(spark, [], ENTRIES) == {}
    assert _run(spark, ["http://a.net/x"], []) == {0: ("a.net", "/x", None, "allow")}


def test_hot_url_joins_one_row_a_cut(spark):
    urls = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("http://hot.net/a/")).otherwise(F.concat(F.lit("http://h"), "id", F.lit(".com/de/"))).alias("url"))
    out = uf.judge_urls(urls, uf.listed(spark.createDataFrame(uf.RULES, "entry string, verdict string")))
    assert {(r.verdict, r["n"]) for r in out.groupBy("verdict").agg(F.count("*").alias("n")).collect()} == {("block", 1667), ("allow", 3333)}

import numpy as np
from pyspark.sql import functions as F

from revlens.llm import url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), ("a.com", "/d", "allow"), ("x.net", "", "block")]


def brute(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG/es/1", "http://example.org/es", "https://m.example.org/es/2?x=/de/",
    "https://notexample.org/es/1", "ftp://a.com/de/x", "https://b.a.com/d#/x", "https://com/de/", "http://x.net", "http://y.x.net?q#h",
    "http://x.net#/a://b", "http://ÄB.com/de/é", "a://b://c.com/de/", "http://org/", "http://org", "http://..org/", "http://h\nost.org/a\nb",
    "http://" + "s." * 300 + "com/de/" + "p" * 5000,
]


def test_odd_urls(spark):
    rows = [(k if k % 5 else None, u, "x", 1, "h") for k, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, row int, host string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for frame in (rules, rules.union(rules)):
        got = url_filter.judge(spark, pages, frame).select("page_id", "host", "path", "rule", "verdict").collect()
        want = [(r[0], *brute(r[1], RULES)) for r in rows]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_no_rules_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r["verdict"] for r in url_filter.judge(spark, pages, none).collect()] == ["allow"]
    assert url_filter.judge(spark, pages.filter("false"), none).collect() == []


def test_long_list_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SENT_RULES", 1)
    rules = [(f"h{k}.com", f"/{k % 7}", "block") for k in range(300)]
    pages = spark.createDataFrame([(k, f"http://www.h{k}.com/{k % 5}/x") for k in range(600)], "page_id long, url string")
    out = url_filter.judge(spark, pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = {k: brute(f"http://www.h{k}.com/{k % 5}/x", rules)[2] for k in range(600)}
    assert {r["page_id"]: r["rule"] for r in out.collect()} == want


def test_filter_has_no_false_negatives(spark):
    rules = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"))
    table = url_filter.build_filter(rules, 5000)
    keys = np.array([r[0] for r in rules.select(F.xxhash64("host", "path")).collect()])
    block, masks = url_filter._block_and_masks(keys, len(table))
    assert ((table[block] & masks) == masks).all()
    other = np.random.default_rng(1).integers(-(2**62), 2**62, 20000)
    block, masks = url_filter._block_and_masks(other, len(table))
    assert ((table[block] & masks) == masks).all(axis=1).mean() < 0.01

from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagesift.functions.urls import is_announcement_url, resolve_url

BASE = "https://www.amazonaws.cn/en/new/"
FX9 = [("a/b", "https://www.amazonaws.cn/en/new/a/b", True), ("../x", "https://www.amazonaws.cn/en/x", True),
       ("/a/../b", "https://www.amazonaws.cn/b", True), ("?q=1", "https://www.amazonaws.cn/en/new/?q=1", True),
       ("#top", "https://www.amazonaws.cn/en/new/#top", True), ("//cdn.x/y", "https://cdn.x/y", False),
       ("/about", "https://www.amazonaws.cn/about", True), ("/about/", "https://www.amazonaws.cn/about/", False),
       ("/New/Pricing/x", "https://www.amazonaws.cn/New/Pricing/x", False),
       ("javascript:void(0)", "javascript:void(0)", True), ("mailto:a@b.cn", "mailto:a@b.cn", True),
       ("tel:1", "tel:1", False), ("https://www.amazonaws.cn/", "https://www.amazonaws.cn/", False)]


def test_fx9_resolution_and_screening(spark):
    df = spark.createDataFrame([(h,) for h, _, _ in FX9], "h string")
    r = df.select("h", resolve_url(F.col("h"), BASE).alias("u")) \
        .select("h", "u", is_announcement_url(F.col("u")).alias("ok")).collect()
    assert {x.h: (x.u, x.ok) for x in r} == {h: (u, ok) for h, u, ok in FX9}


HREFS = ["", "a", "./a", "../a", "../../../a", "a/./b/../c", "/a//b", "a//b/", ".", "..", "./", "../",
         "?x", "#f", "?x#f", "//h", "//h/p?q#f", "http://h2/a/../b", "https://h3", "HTTPS://H/x", "ftp://f/x",
         "javascript:alert(1)", "mailto:x", "tel:+1", "a;p", "a/b;p?q", ";p", "/a;b/c;d", "a:b", "1a:b",
         " /lead", "a\tb", "\n/x", "g?y/./x", "g#s/../x", "..g", "g..", "./g/.", "g/../..", "%2e%2e/x"]
BASES = ["https://www.amazonaws.cn/en/new/", "http://h/a/b/c?q#f", "https://h", "http://h/a/b;p?q",
         "http://ththre.example.com/fr/825?page=2&ref=x", "https://m.ththth.example.net/en/25#top"]


def test_resolution_agrees_with_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "b string, h string")
    got = df.select("b", "h", resolve_url(F.col("h"), F.col("b")).alias("u")).collect()
    bad = [(x.b, x.h, x.u, urljoin(x.b, x.h)) for x in got if x.u != urljoin(x.b, x.h)]
    assert not bad, bad[:5]

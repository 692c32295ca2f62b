from urllib.parse import urljoin, urlparse

from conftest import pages_df
from pagesift.functions.urls import is_announcement_url, resolve_url
from pagesift.operators.content import extract_content
from pyspark.sql import functions as F

HREFS = ["http://[bad/x", "http://bad]/x", "//[::1]/x", "//[::1/x", "http://[::1]:80/x", "http://[::1]80/x", "http://a[::1]/x",
         "http://user@[::1]/x", "http://[v1.a]/x", "http://[v.a]/x", "http://[vg.a]/x", "http://[1.2.3.4]/x", "http://[1:2:3:4:5:6:7:8]/x",
         "http://[1:2:3:4:5:6:7]/x", "http://[1:2:3:4:5:6:7::]/x", "http://[1::2::3]/x", "http://[::1.2.3.4]/x", "http://[::1.2.3.04]/x",
         "http://[fe80::1%eth0]/x", "http://[fe80::1%]/x", "http://[12345::]/x", "http://[]/x", "http://]a[/x", "/p/[x]", "?q=[1]", "#[",
         "http://ex℀mple/x", "http://／a/x", "http://bücher.example/x", "/plain/path", "/a//b/", "/", "//host/x", "/.a", "../x", "x;y"]
BASES = ["https://www.amazonaws.cn/en/new/", "http://h", "HTTP://H/a/b?c", "http://[::1]/a/", "http://[oops/a/", "https://h.x:80/a;b"]


def expected(base, href):
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def test_malformed_hosts_resolve_to_null(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    got = spark.createDataFrame(rows, "base string, href string").select("base", "href", resolve_url(F.col("href"), F.col("base")).alias("u")).collect()
    wrong = [(tuple(r), expected(r.base, r.href)) for r in got if r.u != expected(r.base, r.href)]
    assert not wrong


def test_malformed_hosts_are_no_announcements(spark):
    def parses(u):
        try:
            urlparse(u)
            return True
        except ValueError:
            return False
    got = spark.createDataFrame([(h,) for h in HREFS], "u string").select("u", is_announcement_url(F.col("u"), "").alias("ok")).collect()
    assert not any(r.ok for r in got if not parses(r.u))
    assert sum(r.ok for r in got) > 5


def test_links_with_malformed_hosts_vanish(spark):
    anchors = "".join(f'<a href="{h}">t{i}</a>' for i, h in enumerate(HREFS))
    html = f"<h1>Long title</h1><article>{anchors}<p>{'some text of the page ' * 5}</p></article>"
    (row,) = extract_content(pages_df(spark, [(1, BASES[0], html)])).collect()
    want = [(f"t{i}", expected(BASES[0], h)) for i, h in enumerate(HREFS) if not h.startswith("#")]
    assert [(x.text, x.url) for x in row.embedded_links] == [(t, u) for t, u in want if u is not None]


def test_workers_join_as_the_standard_library_does():
    from pagesift.functions.urls import join_url
    more = ["https://x.example/1", "http://a.b", "HTTPS://x.y/z", "https://a.b/x/../y", "https://a.b:80/x", "/a.b", "/p;a/b;c", "mailto:x@y", "tel:1", "http:x", "./", ".."]
    for base in BASES:
        for href in HREFS + more:
            assert join_url(base, href) == expected(base, href), (base, href)
    assert (join_url(None, "/x"), join_url("", "/x"), join_url("http://h/a", "")) == ("/x", "/x", "http://h/a")


def test_links_of_a_run_are_resolved_once_and_in_the_worker(spark):
    from pagesift.operators.content import split_results
    from pagesift.operators.render import announcement_struct
    pages = pages_df(spark, [(1, "https://h/", '<h1>A long title</h1><article><a href="/x">t</a></article>')])
    plan = split_results(extract_content(pages))[0].select(announcement_struct())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_extract" not in plan and "lambda" not in plan

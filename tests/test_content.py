from datetime import datetime

from conftest import pages_df
from pagesift.operators.content import extract_content, split_results

FX5 = ('<html><head><title>Site</title><script type="application/ld+json">{"datePublished":"bad",'
       '"dateCreated":"2025-11-02T08:00:00Z"}</script></head><body><article><h1>Hi</h1>'
       '<div class="post-title">New <b>storage</b> class</div><!-- internal --><p>Body text that is surely '
       'longer than fifty characters in total.</p><script>x()</script><p>See <a href="../doc?a=1">the guide'
       '</a> or <a href="#top">top</a> or <a href="mailto:x@y.cn"></a>.</p></article></body></html>')
LONG = "<p>" + "Long article text that goes on and on. " * 4 + "</p>"


def test_fx5_announcement_page(spark):
    r = extract_content(pages_df(spark, [(1, "https://www.amazonaws.cn/en/new/2025/x/", FX5)])).first()
    assert r.title == "Newstorageclass"
    assert r.publication_date == datetime(2025, 11, 2, 8, 0)
    assert r.content_text == ("Hi\nNew storage class internal \nBody text that is surely longer than fifty "
                              "characters in total.\nSee the guide or top or .")
    links = [tuple(x) for x in r.embedded_links]
    assert links == [("the guide", "https://www.amazonaws.cn/en/new/2025/doc?a=1", "Seethe guideortopor."),
                     ("mailto:x@y.cn", "mailto:x@y.cn", "Seethe guideortopor.")]
    assert r.error_message is None


def test_fx6_failures(spark):
    rows = [
        (1, "u1", "<h1>Abc</h1><article>" + LONG + "</article>"),
        (2, "u2", "<h1>A long enough title</h1><article><p>" + "x" * 50 + "</p></article>"),
        (3, "u3", "<h1>Abc</h1><article><p>short</p></article>"),
        (4, "u4", '<script type="application/ld+json"></script><h1>A long title</h1><article>' + LONG + "</article>"),
        (5, "u5", "<h1>A long title</h1><div>" + "y" * 100 + "</div>"),
        (6, "u6", "<h1>A long title</h1><div>" + "y" * 101 + "</div>"),
    ]
    out = {r.page_id: r for r in extract_content(pages_df(spark, rows)).collect()}
    prefix = "Content parsing failed: "
    assert out[1].error_message == prefix + "Could not extract title from announcement page"
    assert out[2].error_message == prefix + "Could not extract content text from announcement page"
    assert out[3].error_message == prefix + "Could not extract title from announcement page"
    assert out[4].error_type == "ValueError" and out[4].error_message.startswith(prefix)
    assert out[5].error_message == prefix + "Could not extract content text from announcement page"
    assert out[6].error_message is None and out[6].content_text == "y" * 101
    assert {r.error_type for r in out.values() if r.error_message} == {"ValueError"}


def test_given_date_skips_broken_jsonld(spark):
    df = spark.createDataFrame(
        [(4, "u4", '<script type="application/ld+json"></script><h1>A long title</h1><article>' + LONG
          + "</article>", datetime(2024, 5, 6))], "page_id long, url string, html string, d timestamp_ntz")
    r = extract_content(df, given_date="d").first()
    assert r.error_message is None and r.publication_date == datetime(2024, 5, 6)


def test_date_cascade_order(spark):
    base = "<h1>A long title</h1><article>" + LONG + "{}</article>"
    rows = [(1, "u", base.format('<time datetime="2024-01-02">x</time><span class="date">2023-01-01</span>')),
            (2, "u", base.format('<span class="date">March 4, 2022</span>')),
            (3, "u", base.format("<p>on 13/45/2025 then 01/02/2025 and 2024-99-99</p>")),
            (4, "u", base.format("<p>01/02/2025 ... 2024-03-04</p>")),
            (5, "u", base.format("<p>December 5, 2025</p>"))]
    out = {r.page_id: r.publication_date for r in extract_content(pages_df(spark, rows)).collect()}
    assert out == {1: datetime(2024, 1, 2), 2: datetime(2022, 3, 4), 3: datetime(2025, 1, 2),
                   4: datetime(2024, 3, 4), 5: datetime(2026, 1, 1)}


def test_success_plus_failure_equals_input(spark):
    from conftest import SF
    from pagesift.sources.tables import read_pages
    ex = extract_content(read_pages(spark, SF))
    content, failures = split_results(ex)
    assert content.count() + failures.count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_one_parse_per_page_in_plan(spark):
    from conftest import SF
    from pagesift.plans import catalog
    plan = catalog.page_failures(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_rejected_page_is_a_failure_row(spark):
    page = "<article><h1>A long enough title</h1>" + LONG + "</article>"
    _, failures = split_results(extract_content(pages_df(spark, [(1, "u1", page + "<![foo[x]]>"), (2, "u2", page)])))
    rows = failures.collect()
    assert [r.url for r in rows] == ["u1"] and rows[0].error_message.startswith("Content parsing failed: AssertionError: ")


def test_extraction_is_evaluated_once(spark):
    from pagesift.operators.content import TITLE_SELECTORS
    content, failures = split_results(extract_content(pages_df(spark, [(1, "u", "<h1>x</h1>")])))
    for half in (content.select("url", "title"), failures):
        plan = half._jdf.queryExecution().executedPlan().toString()
        assert plan.count(TITLE_SELECTORS[2][1:]) == 1 and plan.count("MapInArrow") == 1


def test_links_meet_the_first_page_of_their_url(spark):
    from datetime import datetime

    from pagesift.operators.content import extract_links_pages
    page = "<article><h1>Title of page {}</h1>" + LONG + "</article>"
    pages = pages_df(spark, [(7, "u1", page.format(7)), (3, "u1", page.format(3)), (5, "u2", page.format(5)), (9, "u9", page)])
    links = spark.createDataFrame([(1, i, "u1", None) for i in range(40)] + [(2, 1, "u2", datetime(2020, 1, 2)), (2, 2, "u3", None)],
                                  "page_id long, ordinal int, url string, publication_date timestamp_ntz")
    rows = extract_links_pages(links, pages).collect()
    assert len(rows) == 42
    assert {r.title for r in rows if r.url == "u1"} == {"Title of page 3"}
    by = {r.url: r for r in rows}
    assert by["u2"].publication_date == datetime(2020, 1, 2) and by["u2"].error_message is None
    assert by["u3"].error_type == "PageNotFound" and by["u3"].title is None

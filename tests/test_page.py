import random

import pytest
from conftest import pages_df

from pagesift.functions.page import Page
from pagesift.functions.shred import _TreeBuilder, plain_page, shred_one
from pagesift.operators.content import extract_content
from pagesift.operators.links import page_links

PIECES = ["<div>", "</div>", '<p class="a b">', "</p>", "<br>", "</br>", "<pre>", "</pre>", "<textarea>", "</textarea>", "<script>", "</script>",
          '<script type="application/ld+json">', "<style>", "</style>", "<template>", "</template>", "<rt>", "</rt>", "<title>", "</title>",
          '<a href="/x">', "</a>", '<A HREF="/y" Class="c  d" ID="i">', "</A>", '<time datetime="2024-01-02">', "</time>", "<h1>", "</h1>", "</i>",
          " \n", "  ", "\x85", "text > more", "été ", "<x-y>", "<p", "< p>", "<!-- c -->", "<br/>", "&amp;", "<noscript>", "<p q='1'>"]


def slowly(html):
    b = _TreeBuilder()
    b.feed_plain = None
    b.feed(html)
    b.finish()
    return b


def test_plain_pages_are_taken_down_as_the_tree_builder_does():
    rng, plain = random.Random(4), 0
    for _ in range(6000):
        html = "".join(rng.choice(PIECES[:-9] if rng.random() < 0.98 else PIECES) for _ in range(rng.randint(0, 14)))
        fast = plain_page(html)
        if fast is None:
            continue
        plain += 1
        slow = slowly(html)
        for name in ("kind", "tag", "attrs", "text", "end", "parent"):
            assert getattr(fast, name) == getattr(slow, name), (name, html)
        a, b = Page(fast), Page(slow)
        for name in ("end", "parent", "first", "anchors", "scripts", "upto", "texts", "chars"):
            assert getattr(a, name) == getattr(b, name), (name, html)
        assert [x if type(x) is str else x[1:] for x in a.nodes] == [x if type(x) is str else x[1:] for x in b.nodes], html
    assert plain > 1000


@pytest.mark.parametrize("html", ["<p>a &amp; b</p>", "<!-- c -->", "<br/>", "<p", "<p q='1'>x</p>", "<noscript>x</noscript>", "<script>a<b</script>",
                                  "<script>x", "a < b"])
def test_other_pages_are_left_to_the_tokenizer(html):
    assert plain_page(html) is None and shred_one(html)[0] is not None


def test_nodes_stay_where_the_page_was_parsed(spark):
    pages = pages_df(spark, [(1, "https://h/", '<h1>A long title</h1><article><a href="/x">t</a></article>')])
    for df in (extract_content(pages), page_links(pages), page_links(pages, "area")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "lambda" not in plan and "dom#" not in plan


# -- dates -----------------------------------------------------------------------------
DATES = ["2024-01-02", "2024-1-2", "2024-13-02", "2024-02-30", "0000-01-01", "0001-01-01", "01/02/2024", "1-2-2024", "01-02/2024", "March 4, 2022",
         "Mar 4, 2022", "mARCH 04, 2022", "4 March 2022", "04 sept 2022", "4 Sep 2022", "2024-01-02T03:04:05", "2024-01-02T3:4:5Z",
         "2024-01-02T03:04:05.123Z", "2024-01-02T03:04:60Z", "2024-01-02T24:04:00Z", "2024-01-02T03:04:05.1234567Z", "2024-01-02T03:04:05.5",
         "2024-01-02T03:04:05.000001Z", "  March \n 4,\u2003 2022 ", "", " ", None, "May 5, 2020", "5/5/20", "\uff15/5/2020", "12024-01-02", "2024-01-02x"]
TEXTS = ["on 13/45/2025 then 01/02/2025 and 2024-99-99", "01/02/2025 ... 2024-03-04", "due 12-31-2020.", "12024-01-021", "since December  5 2001",
         "99-99-9999 12-11-2020", "MAY 5, 2020 and 4 May 2021", "\u0661\u0662/01/2020", "", "no date 24-1-1", "1/2/2024"]


def test_dates_are_read_as_the_columns_read_them(spark):
    from pagesift.functions.dates import date_in_text, dates_in_text, parse_date_string, read_date
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(DATES + TEXTS)], "i int, s string")
    got = rows.select("i", parse_date_string(rows.s).alias("whole"), dates_in_text(rows.s).alias("inside"),
                      dates_in_text(rows.s, True).alias("named")).orderBy("i").collect()
    for s, r in zip(DATES + TEXTS, got):
        assert read_date(s) == r.whole, s
        assert (date_in_text(s or ""), date_in_text(s or "", True)) == (r.inside, r.named), s
    assert sum(r.whole is not None for r in got) > 12 and sum(r.inside is not None for r in got) > 6


# -- JSON-LD ---------------------------------------------------------------------------
NO_STRIP, DAY = "'{}' object has no attribute 'strip'", "2020-01-02"
SCRIPTS = [
    ('{"datePublished":"2020-01-02"}', DAY, None), ('{"datePublished":"bad","dateCreated":"2020-01-02"}', DAY, None),
    ('{"datePublished":"1999-01-01","datePublished":"2020-01-02"}', DAY, None), ('{"a":NaN,"dateModified":"2020-01-02"}', DAY, None),
    ('{"datePublished":0,"dateCreated":false,"dateModified":"2020-01-02"}', DAY, None),
    ('{"datePublished":null,"dateCreated":[],"dateModified":"2020-01-02"}', DAY, None), ('{"datePublished":5}', None, NO_STRIP.format("int")),
    ('{"datePublished":1.5}', None, NO_STRIP.format("float")), ('{"datePublished":Infinity}', None, NO_STRIP.format("float")),
    ('{"datePublished":12345678901234567890}', None, NO_STRIP.format("float")), ('{"datePublished":true}', None, NO_STRIP.format("bool")),
    ('{"datePublished":["2020"]}', None, NO_STRIP.format("list")), ('{"datePublished":{"a":1}}', None, NO_STRIP.format("dict")),
    ('["x","datePublished"]', None, "list indices must be integers or slices, not str"), ('["x",1]', None, None),
    ('"a datePublished"', None, "string indices must be integers, not 'str'"), ('"x"', None, None), ("5", None, "argument of type 'int' is not iterable"),
    ("null", None, "argument of type 'NoneType' is not iterable"), ("nan", None, None), ("{bad", None, None),
    ('{"x":1e999,"datePublished":"2020-01-02"}', None, None), ('{"x":' + "[" * 1000 + "]" * 1000 + ',"datePublished":"2020-01-02"}', None, None),
    ("", None, "the JSON object must be str, bytes or bytearray, not NoneType")]


@pytest.mark.parametrize("script,date,error", SCRIPTS)
def test_jsonld_scripts_are_read_by_the_worker(script, date, error):
    from datetime import datetime

    from pagesift.functions.page import jsonld_date
    from pagesift.operators.content import LD_DATE_FIELDS
    for html in ('<script type="application/ld+json">{}</script><h1>t</h1>', '<!-- c --><script type="application/ld+json">{}</script>'):
        page = Page(shred_one(html.replace("{}", script, 1))[0])
        assert jsonld_date(page, LD_DATE_FIELDS) == (date and datetime.fromisoformat(date), error)

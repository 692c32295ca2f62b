"""Registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the given tables (or rows Spark derives from them) whole;
no row caps, id subsets or samples.  Column names match the oracle SQL in
``plans/oracle.py``.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from ..functions.sqltext import F

from ..operators.content import extract_content, split_results
from ..session import checkpoint_dir, materialize
from ..sources.tables import read_pages

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_content(read_pages(spark, sf_dir))


@query
def page_title(spark, sf_dir):
    """E2 over every crawled page (NULL when no selector gives > 5 chars)."""
    return _extracted(spark, sf_dir).select("page_id", "url", "title")


@query
def page_content(spark, sf_dir):
    """The content rows."""
    content, _ = split_results(_extracted(spark, sf_dir))
    return content.select("page_id", "url", "title", "content_text",
                          F.length("content_text").cast("bigint").alias("n_chars"),
                          F.size("embedded_links").cast("bigint").alias("n_links"))


@query
def page_failures(spark, sf_dir):
    """The failure rows."""
    _, failures = split_results(_extracted(spark, sf_dir))
    return failures.select("url", "error_message", "error_type")


# -- links, URLs, duplicates ------------------------------------------------------
def _links(spark, sf_dir):
    """Every ``a[href]`` of every page (document scope) with its raw href."""
    from ..operators.links import page_links
    links = page_links(read_pages(spark, sf_dir), scope="document")
    return links.withColumn("href", F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1))


@query
def page_links(spark, sf_dir):
    """Links as rows (text, resolved URL, context)."""
    return _links(spark, sf_dir).select("page_id", "position", "text", "url", "context")


@query
def link_context(spark, sf_dir):
    """Contexts per page: how many links, how many distinct contexts."""
    return _links(spark, sf_dir).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_distinct("context").alias("n_contexts"),
        F.max(F.length("context")).cast("bigint").alias("max_context_len"))


@query
def candidate_urls(spark, sf_dir):
    """L12 with the driver's domain: which link URLs look like announcements."""
    from ..operators.links import screen_links
    return screen_links(_links(spark, sf_dir), domain="example") \
        .select("page_id", "position", "url", "accepted")


# Relative forms derived from each link's href (L11); the base is the page URL.
RELATIVE_FORMS = {
    "root": "{h}",
    "relative": "substr({h}, 2)",
    "parent": "concat('../', substr({h}, 2))",
    "dot": "concat('./', substr({h}, 2), '?x=1')",
    "netloc": "concat('//cdn.example.org', {h})",
    "fragment": "concat('#', substr({h}, 2))",
    "query": "concat('?q=', substr({h}, 2))",
}


@query
def resolve_urls(spark, sf_dir):
    """L11 on seven relative forms of every link against its page URL."""
    from ..functions.urls import resolve_url
    links = _links(spark, sf_dir).select("page_id", "position", "page_url", "href")
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.expr(v.format(h="href")).alias("rel"))
                      for k, v in RELATIVE_FORMS.items()])
    return links.select("page_id", "position", "page_url", F.inline(forms)) \
        .select("page_id", "position", "form", "rel",
                resolve_url(F.col("rel"), F.col("page_url")).alias("resolved"))


def _link_rows(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "position", F.col("href").alias("url"),
                                        F.col("text").alias("title"), "page_url")


@query
def dedup_skip(spark, sf_dir):
    """First link per target URL in (page_id, position) order."""
    from ..operators.dedup import handle_duplicates
    return handle_duplicates(_link_rows(spark, sf_dir).drop("page_url"), "skip")


@query
def dedup_overwrite(spark, sf_dir):
    """Every row kept."""
    from ..operators.dedup import handle_duplicates
    return handle_duplicates(_link_rows(spark, sf_dir).drop("page_url"), "overwrite")


@query
def dedup_version(spark, sf_dir):
    """D3: n-th copy of a URL titled ``title (vN)``."""
    from ..operators.dedup import handle_duplicates
    return handle_duplicates(_link_rows(spark, sf_dir).drop("page_url"), "version")


@query
def dedup_cross_batch(spark, sf_dir):
    """D1 + T3: pages stored in three batches by host (.com, .net, then the
    rest); each batch skips URLs stored by earlier ones."""
    from ..functions.urls import url_host
    from ..operators.dedup import dedup_batches
    rows = _link_rows(spark, sf_dir)
    host = url_host(F.col("page_url"))
    rows = rows.withColumn("batch", F.when(host.endswith(".com"), 1).when(host.endswith(".net"), 2)
                           .otherwise(3)).drop("page_url")
    return dedup_batches(rows, "batch")


# -- month filter -----------------------------------------------------------------
MONTH = "2001-03"


@query
def month_filter(spark, sf_dir):
    """Orders of one month; both bounds reach the parquet scan."""
    from ..operators.filters import month_filter as mf
    from ..sources.tables import read_table
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    return mf(orders, "o_orderdate", MONTH)


@query
def month_filter_events(spark, sf_dir):
    """An invalid filter under ``on_invalid='pass'`` leaves the events as
    they are."""
    from ..operators.filters import month_filter as mf
    from ..sources.tables import read_table
    events = read_table(spark, sf_dir, "events", "event_id", "ts", "event_type")
    return mf(events, "ts", "2024-1", on_invalid="pass")


LOOSE_MONTHS = ["2001-3", "2001-13", "spring"]


@query
def month_filter_loose(spark, sf_dir):
    """P4 with a month that only the loose form accepts, one that no calendar
    has (no row) and one that is no month (all rows)."""
    from ..operators.filters import month_filter_loose as mf
    from ..sources.tables import read_table
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    parts = [mf(orders, "o_orderdate", m).select(F.lit(m).alias("month"), "o_orderkey") for m in LOOSE_MONTHS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- runs, summaries ----------------------------------------------------------------
def _items(spark, sf_dir):
    """Processed pages as run items: run = registrable domain of the page
    host, ordinal = page_id, ok = extracted without error."""
    from ..functions.urls import url_host
    ex = _extracted(spark, sf_dir)
    return ex.select(
        F.regexp_extract(url_host(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("run_id"),
        F.col("page_id").alias("ordinal"), "url", F.col("error_message").isNull().alias("ok"),
        "error_message", "error_type")


@query
def run_summary(spark, sf_dir):
    """A1, A2, A5: totals, success rate and status per run."""
    from ..operators.summary import run_summary as rs
    return rs(_items(spark, sf_dir)).drop("execution_time")


@query
def run_status(spark, sf_dir):
    """A5 for every page as its own run of one item (ok / failed)."""
    from ..operators.summary import run_summary as rs
    items = _items(spark, sf_dir).withColumn("run_id", F.col("url"))
    return rs(items).select("run_id", "status")


@query
def progress_points(spark, sf_dir):
    """A3: checkpoints at every 10th item and the last of each run."""
    from ..operators.summary import progress_points as pp
    return pp(materialize(_items(spark, sf_dir).select("run_id", "ordinal", "ok")))


@query
def first_failures(spark, sf_dir):
    """A4: first five failures per run and the count of the rest."""
    from ..operators.summary import first_failures as ff
    fails = materialize(_items(spark, sf_dir).filter(~F.col("ok")))
    return ff(fails).select("run_id", "rank", "url", "error_type", "error_message", "more")


# -- rendering and search -------------------------------------------------------------
def _content(spark, sf_dir):
    content, _ = split_results(_extracted(spark, sf_dir))
    return content


@query
def csv_rows(spark, sf_dir):
    """CSV rows with the run's total joined on (a one-row side)."""
    from ..operators.render import csv_columns
    total = read_pages(spark, sf_dir).select("page_id") \
        .agg(F.count(F.lit(1)).alias("total_processed")).withColumn("execution_time", F.lit(0.0))
    content, _ = split_results(_extracted(spark, sf_dir))
    return content.crossJoin(F.broadcast(total)).select("page_id", *csv_columns(True))


@query
def html_cards(spark, sf_dir):
    """One escaped HTML card per announcement."""
    from ..operators.render import html_card
    return _content(spark, sf_dir).select("page_id", html_card().alias("card"))


@query
def txt_blocks(spark, sf_dir):
    """C4, K4: numbered text blocks (numbers from a skew-safe prefix sum)."""
    from ..operators.ranking import positions
    from ..operators.render import txt_block
    content = materialize(_content(spark, sf_dir)).withColumn("_run", F.lit("all"))
    numbered = positions(content, ["_run"], "page_id", [], name="number")
    return numbered.select("page_id", "number", txt_block(F.col("number")).alias("block"))


SEARCH = " THE "


@query
def search(spark, sf_dir):
    """P5: announcements whose lowercased title + ' ' + text holds the query."""
    from ..operators.filters import search as srch
    return srch(_content(spark, sf_dir), SEARCH).select("page_id", "title")


@query
def detect_language(spark, sf_dir):
    """X1 on documents."""
    from ..operators.summary import detect_language as dl
    from ..sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return docs.select("doc_id", "lang", dl(F.col("text")).alias("detected"))


@query
def category_counts(spark, sf_dir):
    """Documents per service category of their whole text, by the table
    of rules."""
    from ..operators.summary import CATEGORY_RULES, categorize_by
    from ..sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    rules = spark.createDataFrame(CATEGORY_RULES, "category string, keyword string, priority int")
    return categorize_by(docs, rules).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query
def lang_target(spark, sf_dir):
    """Normalised language, its label and listing URL."""
    from ..operators.summary import language_label, normalize_language, target_url
    from ..sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents", "doc_id", "lang")
    norm = normalize_language(F.col("lang"))
    return docs.select("doc_id", "lang", norm.alias("norm_lang"),
                       language_label(norm).alias("label"), target_url(norm).alias("target_url"))


# -- fetch log ----------------------------------------------------------------------
def _fetch_log(spark, sf_dir):
    from ..operators.fetchlog import events_as_fetch_log
    from ..sources.tables import read_table
    return events_as_fetch_log(read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type"))


@query
def fetch_verdict(spark, sf_dir):
    """Verdict and delay of every attempt."""
    from ..operators.fetchlog import attempt_verdict
    return attempt_verdict(_fetch_log(spark, sf_dir))


@query
def fetch_outcome(spark, sf_dir):
    """outcome, attempts and waiting time per URL."""
    from ..operators.fetchlog import attempt_verdict
    from ..operators.fetchlog import fetch_outcome as fo
    return fo(attempt_verdict(_fetch_log(spark, sf_dir)))


# -- listing pages derived from orders (one page per order row) ----------------------
BASE = "https://www.amazonaws.cn/en/new/"


def _orders(spark, sf_dir, *cols):
    from ..sources.tables import deal_rows, read_table
    return deal_rows(read_table(spark, sf_dir, "orders", *cols))     # pages are made of them


def _k(c="o_orderkey"):
    return F.col(c).cast("string")


@query
def listing_json_links(spark, sf_dir):
    """One JSON listing per order (three items, the third
    repeating the first link)."""
    from ..operators.listing import harvest_links
    o = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    html = F.concat(
        F.lit('<html><body><script>{"data":{"items":[{"fields":{"itemTitle":"Order '), _k(), F.lit(" "),
        F.col("o_orderpriority"), F.lit(' ","itemLink":"/en/new/'), _k(),
        F.lit('/","itemBody":"<p>Customer '), _k("o_custkey"), F.lit('</p>","itemMetadataDate":"'),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T00:00:00.000+08:00"}},{"fields":{"itemTitle":"Status '),
        F.col("o_orderstatus"), F.lit('","itemLink":"https://www.amazonaws.cn/en/new/s/'), _k(),
        F.lit('/","itemBody":""}},{"fields":{"itemTitle":"Again '), _k(), F.lit('","itemLink":"/en/new/'), _k(),
        F.lit('/"}}]}}</script></body></html>'))
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit(BASE), _k()).alias("url"),
                     html.alias("html"))
    links, _ = harvest_links(pages, base=BASE)
    return links


@query
def listing_json_fallback(spark, sf_dir):
    """Items without ``fields`` and without a body are found only by
    the large ``data.items`` structure; an empty itemTitle does not fall back."""
    from ..operators.listing import harvest_links
    o = _orders(spark, sf_dir, "o_orderkey")
    html = F.concat(F.lit('<script>{"data": {"items": [{"itemTitle":"T'), _k(), F.lit('","itemLink":"/en/new/t'),
                    _k(), F.lit('/"},{"itemTitle":"","title":"Never","itemLink":"/x/"}]}}</script>'))
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("url"), html.alias("html"))
    links, _ = harvest_links(pages, base=BASE)
    return links


@query
def listing_html_links(spark, sf_dir):
    """A section found by its heading, anchors screened,
    titled and previewed."""
    from ..operators.listing import harvest_links
    o = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderpriority")
    html = F.concat(
        F.lit("<div><h2>Most Recent Announcements from Amazon Web Services</h2><ul>"
              '<li><a href="/en/new/'), _k(), F.lit('/">Order '), _k(), F.lit("</a></li>"
              '<li><a href="/en/about/'), _k(), F.lit('">About</a></li>'
              '<li><a href="javascript:void(0)">Menu</a></li>'
              '<li><a href="https://other.example.com/en/new/'), _k(), F.lit('/">Ext</a></li>'
              '<li><div><a href="/p/'), _k(), F.lit('/" title="Title '), _k(), F.lit('">x</a></div>'
              "<p>Preview for customer "), _k("o_custkey"), F.lit(" longer than twenty</p></li>"
              '<li><a href="/q/'), _k(), F.lit('/">Two</a> and a trailing text for '), F.col("o_orderpriority"),
        F.lit(" orders</li></ul></div>"))
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("url"), html.alias("html"))
    links, _ = harvest_links(pages, base=BASE)
    return links


@query
def listing_failures(spark, sf_dir):
    """L1, Q16: the crawled pages read as listings have no section."""
    from ..operators.listing import harvest_links
    _, failures = harvest_links(read_pages(spark, sf_dir))
    return failures


@query
def listing_class_links(spark, sf_dir):
    """No heading; a list whose class speaks of news and that has three
    links is the section."""
    from ..operators.listing import harvest_links
    o = _orders(spark, sf_dir, "o_orderkey")
    item = [F.concat(F.lit(f'<li><a href="/en/new/{x}'), _k(), F.lit(f'/">{x.upper()} number '), _k(), F.lit("</a></li>"))
            for x in "abc"]
    html = F.concat(F.lit('<p><a href="/en/new/outside/">Outside</a></p><ul class="Latest-News">'), *item, F.lit("</ul>"))
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("url"), html.alias("html"))
    links, _ = harvest_links(pages, base=BASE)
    return links


@query
def listing_title_only(spark, sf_dir):
    """L2d, L7: a page that names item titles but no item links is searched
    whole; the link comes from the next key."""
    from ..operators.listing import harvest_links
    o = _orders(spark, sf_dir, "o_orderkey")
    html = F.concat(F.lit('<script>{"data": {"items": [{"itemTitle":" T'), _k(), F.lit('","url":"/en/new/u'), _k(),
                    F.lit('/"},{"itemTitle":"Again","linkURL":"/en/new/u'), _k(), F.lit('/"}]}}</script>'))
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("url"), html.alias("html"))
    links, _ = harvest_links(pages, base=BASE)
    return links


@query
def listing_attribute_json(spark, sf_dir):
    """L4 in the tree written out again: JSON in an attribute, its quotes as
    entities or raw, is found; a value with both kinds of quotes is not."""
    from ..operators.listing import harvest_links
    o = _orders(spark, sf_dir, "o_orderkey", "o_orderpriority")

    def item(quote, name):
        q = F.lit(quote)
        parts = [F.lit("{"), q, F.lit("fields"), q, F.lit(": {"), q, F.lit("itemTitle"), q, F.lit(":"), q, F.lit(name), _k(), q,
                 F.lit(","), q, F.lit("itemLink"), q, F.lit(":"), q, F.lit("/en/new/"), _k(), F.lit("/"), q, F.lit("}}")]
        return F.concat(*parts)
    entity = F.concat(F.lit('<div class="a  b" data-item="'), item("&quot;", "Entity "), F.lit('">x</div>'))
    raw = F.concat(F.lit("<div data-item='"), item('"', "Raw R&amp;D "), F.lit("'>x</div>"))
    both = F.concat(F.lit('<div data-item="'), item("&quot;", "It's "), F.lit('">x</div>'))
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("url"), F.concat(entity, raw, both).alias("html"))
    links, _ = harvest_links(pages, base=F.concat(F.lit(BASE), F.col("page_id").cast("string")))
    return links


_TOLERANT = """<script>[{"fields":{"itemTitle":"old","itemTitle":"Last %s","rank":NaN,"itemLink":"/en/new/%s/"}},
{"fields":{"itemTitle":"No number","itemLink":"/n/","itemMetadataDate":-Infinity}},
{"fields":{"itemTitle":"Unread %s","itemLink":"/u/","rank":nan}},{"fields":{"itemTitle":"End","itemLink":"//[bad/"}}]</script>"""


def _tolerant_pages(spark, sf_dir):
    o = _orders(spark, sf_dir, "o_orderkey")
    return o.select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("url"),
                    F.regexp_replace(F.lit(_TOLERANT), "%s", _k()).alias("html"))


@query
def listing_tolerant_json(spark, sf_dir):
    """Of repeated keys the last counts, NaN and Infinity are
    numbers; unreadable items, wrong types and malformed hosts are dropped."""
    from ..operators.listing import harvest_links
    links, _ = harvest_links(_tolerant_pages(spark, sf_dir), base=BASE)
    return links


@query
def listing_unreadable(spark, sf_dir):
    """L4: the JSON hits of each listing that no reading fits, counted."""
    from ..operators.listing import unreadable_hits
    return unreadable_hits(_tolerant_pages(spark, sf_dir)).withColumn("unreadable", F.col("unreadable").cast("bigint"))


# -- links and their pages (S2), derived from orders ---------------------------------
def _announcements(orders, crawled="o_orderkey % 5 != 0"):
    """Announcement pages of orders: every fifth was never crawled, every
    seventh twice (the second copy says something else)."""
    k = _k()
    url = F.concat(F.lit(BASE), k, F.lit("/"))
    article = F.concat(
        F.lit('<html><head><title>Site</title></head><body><a href="/menu">Menu</a><article><h1>Order number '), k,
        F.lit("</h1><p>Customer <a href=\"/c/"), _k("o_custkey"), F.lit('">c'), _k("o_custkey"),
        F.lit('</a> and <a href="#top">top</a> <a href="https://x.example/'), k,
        F.lit('">out</a> placed this order with a text longer than fifty characters.</p></article></body></html>'))
    there = orders.filter(crawled)
    once = there.select((F.col("o_orderkey") * 2).alias("page_id"), url.alias("url"), article.alias("html"))
    again = there.filter("o_orderkey % 7 = 0").select(
        (F.col("o_orderkey") * 2 + 1).alias("page_id"), url.alias("url"),
        F.concat(F.lit("<h1>Another title of "), k, F.lit("</h1>")).alias("html"))
    return once.unionByName(again)


@query
def area_links(spark, sf_dir):
    """E13, E14 in the content area: resolved links with their contexts."""
    from ..operators.links import page_links
    o = _orders(spark, sf_dir, "o_orderkey", "o_custkey")
    return page_links(_announcements(o, "true"), scope="area").select("page_id", "position", "text", "url", "context")


@query
def link_pages(spark, sf_dir):
    """Two links per order (one with a date) joined to crawled pages;
    missing pages are failures, of two copies the first counts."""
    from ..operators.content import extract_links_pages
    o = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderdate")
    url = F.concat(F.lit(BASE), _k(), F.lit("/"))
    dated = o.select(F.col("o_orderkey").alias("page_id"), F.lit(1).alias("ordinal"), url.alias("url"),
                     F.col("o_orderdate").cast("timestamp_ntz").alias("publication_date"))
    plain = dated.withColumn("ordinal", F.lit(2)).withColumn("publication_date", F.lit(None).cast("timestamp_ntz"))
    out = extract_links_pages(dated.unionByName(plain), _announcements(o))
    return out.select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), "url", "title", "publication_date",
                      F.size("embedded_links").cast("bigint").alias("n_links"), "error_message", "error_type")


@query
def full_run(spark, sf_dir):
    """The whole run: listing links, month filter before extraction, pages,
    first-wins dedup; one row per URL with its outcome."""
    from ..operators.content import extract_links_pages
    from ..operators.dedup import first_per_key
    from ..operators.filters import month_filter_loose as mf
    from ..operators.listing import harvest_links
    o = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderdate")
    html = F.concat(F.lit('<script>{"data":{"items":[{"fields":{"itemTitle":"Order '), _k(),
                    F.lit('","itemLink":"/en/new/'), _k(), F.lit('/","itemMetadataDate":"'),
                    F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"}}]}}</script>'))
    listings = o.select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("url"), html.alias("html"))
    links, _ = harvest_links(listings, base=BASE)
    # few links are left, and they are read twice: for the wanted URLs and the join
    out = extract_links_pages(materialize(mf(links, "publication_date", MONTH)), _announcements(o))
    rows = first_per_key(out.select("url", "page_id", "ordinal", "title", "publication_date", "error_message"),
                         "url", ["page_id", "ordinal"])
    return rows.select("url", "title", "publication_date", "error_message")


# -- sinks, written and read back ---------------------------------------------------
def _order_extraction(spark, sf_dir, where="true"):
    """The announcement pages of orders, links included."""
    o = _orders(spark, sf_dir, "o_orderkey", "o_custkey").filter(where)
    return extract_content(_announcements(o, "true"))


def _order_results(spark, sf_dir):
    """(content, failures) of the announcement pages of orders: both are kept,
    so the extraction they are the halves of is written once."""
    return split_results(materialize(_order_extraction(spark, sf_dir)))


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def report_txt(spark, sf_dir):
    """K4, K2: the text report with its head, numbered announcements, links
    and failures, written as ordered parts and read back line by line."""
    from ..sinks.report import report_lines, write_report
    path = write_report(*_order_results(spark, sf_dir), _folder(spark, "report"), "txt", datetime(2026, 1, 1), execution_time=12.5)
    return report_lines(spark, path)


@query
def sink_json(spark, sf_dir):
    """K0, K1, K7: announcements as JSON records in the run's folder, read
    back with their links."""
    from ..sinks.writers import write_run
    path = write_run(*_order_results(spark, sf_dir), _folder(spark, "run"), datetime(2026, 1, 1))
    back = spark.read.json(f"{path}/announcements")
    return back.select("title", "url", "publication_date", "content_text", "extraction_timestamp",
                       F.array_join(F.transform("embedded_links", lambda x: F.concat(x["text"], F.lit(" "), x["url"], F.lit(" "), x["context"])), "; ").alias("links"))


@query
def sink_metadata(spark, sf_dir):
    """K2, K6: the summary and metadata rows that stand beside a run."""
    from ..sinks.writers import write_run
    path = write_run(*_order_results(spark, sf_dir), _folder(spark, "run"), datetime(2026, 1, 1), fmt="csv", timeout=30, max_retries=3,
                     execution_time=1.5, date_filter="2025-12")
    summary = spark.read.json(f"{path}/summary")
    return summary.crossJoin(spark.read.json(f"{path}/metadata")).select(
        "total_processed", "successful_extractions", "failed_extractions", "execution_time", "extraction_timestamp", "scraper_version",
        "output_format", "duplicate_handling", "timeout", "max_retries", "date_filter")


@query
def sink_partitions(spark, sf_dir):
    """K7: two runs as partitions; the second is written again with other
    rows, which replaces it alone; each run's rows, counted on read."""
    from ..sinks.report import read_runs, write_partition
    path, first, second = _folder(spark, "runs"), datetime(2026, 1, 1), datetime(2026, 2, 1)
    for run, where in ((first, "true"), (second, "o_orderkey % 2 = 0"), (second, "o_orderkey % 2 = 1")):
        write_partition(split_results(_order_extraction(spark, sf_dir, where))[0], path, run)
    return read_runs(spark, path).groupBy("run", "language").agg(
        F.count(F.lit(1)).alias("n"), F.min("title").alias("least_title"))


# -- dates --------------------------------------------------------------------------
# Forms of each order date rendered as text (Spark pattern, parses?).
DATE_FORMS = [
    ("iso_short", "yyyy-M-d", True), ("iso_t", "yyyy-MM-dd'T'HH:mm:ss", True),
    ("iso_z", "yyyy-MM-dd'T'HH:mm:ss'Z'", True), ("iso_ms_z", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", True),
    ("us_slash", "MM/dd/yyyy", True), ("us_dash", "M-d-yyyy", True), ("long", "MMMM d, yyyy", True),
    ("abbr", "MMM dd, yyyy", True), ("day_long", "d MMMM yyyy", True), ("day_abbr", "dd MMM yyyy", True),
    ("offset", "yyyy-MM-dd'T'HH:mm:ss.SSS'+08:00'", False), ("impossible", "yyyy-'02-30'", False),
]


@query
def parse_dates(spark, sf_dir):
    """Every order date rendered in twelve forms and parsed back."""
    from ..functions.dates import normalize_date_text, parse_normalized_date
    o = _orders(spark, sf_dir, "o_orderkey", "o_orderdate")
    forms = F.array(*[F.struct(F.lit(n).alias("form"), F.date_format("o_orderdate", f).alias("s"))
                      for n, f, _ in DATE_FORMS])
    x = o.select("o_orderkey", F.inline(forms))
    x = x.withColumn("s", F.when(F.col("form") == "abbr", F.upper("s")).otherwise(F.col("s")))
    x = x.withColumn("_v", normalize_date_text(F.col("s")))
    return x.select("o_orderkey", "form", "s", parse_normalized_date(F.col("_v")).alias("parsed"))


@query
def text_dates(spark, sf_dir):
    """Dates found in text; pattern order beats position; the month-name
    pattern never parses (quirk Q1)."""
    from ..functions.dates import dates_in_text
    o = _orders(spark, sf_dir, "o_orderkey", "o_orderdate")
    d = F.col("o_orderdate")
    texts = F.array(
        F.struct(F.lit("skip_bad").alias("variant"), F.concat(
            F.lit("on 13/45/"), F.date_format(d, "yyyy"), F.lit(" then "), F.date_format(d, "MM/dd/yyyy"),
            F.lit(" and "), F.date_format(d, "yyyy"), F.lit("-99-99")).alias("text")),
        F.struct(F.lit("order_wins").alias("variant"), F.concat(
            F.date_format(F.date_add(d, 1), "MM/dd/yyyy"), F.lit(" ... "),
            F.date_format(d, "yyyy-MM-dd")).alias("text")),
        F.struct(F.lit("dashes").alias("variant"), F.concat(
            F.lit("due "), F.date_format(d, "MM-dd-yyyy"), F.lit(".")).alias("text")),
        F.struct(F.lit("month_name").alias("variant"), F.concat(
            F.lit("since "), F.date_format(d, "MMMM d, yyyy")).alias("text")))
    x = o.select("o_orderkey", F.inline(texts))
    return x.select("o_orderkey", "variant", dates_in_text(F.col("text")).alias("found"))


@query
def date_cascade(spark, sf_dir):
    """E7-E10 (+E11 and the run-time fallback): announcement pages derived
    from orders, each carrying its date in one place."""
    o = _orders(spark, sf_dir, "o_orderkey", "o_orderdate")
    d = F.col("o_orderdate")
    head = F.concat(F.lit("<html><head><title>Order "), _k(), F.lit("</title>"))
    body = F.concat(F.lit("<body><article><h1>Order number "), _k(), F.lit("</h1>"))
    tail = F.lit("<p>Body text that is surely longer than fifty characters in total.</p></article></body></html>")
    variants = F.array(
        F.struct(F.lit("jsonld").alias("variant"), F.concat(
            head, F.lit('<script type="application/ld+json">{"datePublished":"bad","dateCreated":"'),
            F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}</script></head>'), body, tail).alias("html")),
        F.struct(F.lit("time").alias("variant"), F.concat(
            head, F.lit("</head>"), body, F.lit('<time datetime="'), F.date_format(d, "yyyy-MM-dd"),
            F.lit('">then</time>'), tail).alias("html")),
        F.struct(F.lit("selector").alias("variant"), F.concat(
            head, F.lit("</head>"), body, F.lit('<span class="post-date">'), F.date_format(d, "MMMM d, yyyy"),
            F.lit("</span>"), tail).alias("html")),
        F.struct(F.lit("text").alias("variant"), F.concat(
            head, F.lit("</head>"), body, F.lit("<p>Posted "), F.date_format(d, "MM/dd/yyyy"), F.lit("</p>"),
            tail).alias("html")),
        F.struct(F.lit("none").alias("variant"), F.concat(head, F.lit("</head>"), body, tail).alias("html")))
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.inline(variants)) \
        .withColumn("url", F.concat(F.lit(BASE), F.col("page_id").cast("string"), F.lit("/"), F.col("variant")))
    ex = extract_content(pages.select("page_id", "variant", "url", "html"))
    return ex.select("page_id", "variant", "publication_date")


@query
def jsonld_tolerant(spark, sf_dir):
    """Repeated keys and numbers that are none in JSON-LD; a date that is
    a number fails the page."""
    o = _orders(spark, sf_dir, "o_orderkey", "o_orderdate")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")

    def page(name, *json):
        return F.struct(F.lit(name).alias("variant"), F.concat(
            F.lit('<script type="application/ld+json">'), *json, F.lit("</script><article><h1>Order number "), _k(),
            F.lit("</h1><p>Body text that is surely longer than fifty characters in total.</p></article>")).alias("html"))
    variants = F.array(
        page("repeated", F.lit('{"datePublished":"1999-01-01","datePublished":"'), day, F.lit('"}')),
        page("nan", F.lit('{"rank":NaN,"dateCreated":"'), day, F.lit('"}')),
        page("number", F.lit('{"datePublished":Infinity,"dateCreated":"'), day, F.lit('"}')),
        page("unreadable", F.lit('{"rank":nan,"dateCreated":"'), day, F.lit('"}')))
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.inline(variants)).withColumn("url", F.lit(BASE))
    return extract_content(pages.select("page_id", "variant", "url", "html")).select("page_id", "variant", "publication_date", "error_message")


def _element(selector, inner):
    """Markup of an element that ``selector`` matches around ``inner``."""
    tag, kind, name = re.match(r"^([a-z0-9]*)([.#]?)([a-z-]*)", selector).groups()
    attrs = {".": f' class="x {name}"', "#": f' id="{name}"'}.get(kind, "")
    tag = tag or ("section" if "content" in name else "span")
    return F.concat(F.lit(f"<{tag}{attrs}{' datetime=soon' if 'datetime' in selector else ''}>"), inner, F.lit(f"</{tag}>"))


@query
def selector_wins(spark, sf_dir):
    """For every title, content and date selector a page on which
    it is the one that wins."""
    from ..operators.content import CONTENT_SELECTORS, DATE_SELECTORS, TITLE_SELECTORS
    o = _orders(spark, sf_dir, "o_orderkey", "o_orderdate")
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    title, text = F.concat(F.lit("Order number "), _k()), F.concat(F.lit("Order "), _k(), F.lit(" has a text that is longer than fifty characters."))
    outside = F.lit("<i>This text stands outside of the area and is a good deal longer than the text of the area itself is.</i>")

    def page(kind, selector, *parts):
        return F.struct(F.lit(f"{kind} {selector}").alias("variant"), F.concat(*parts).alias("html"))
    variants = F.array(
        *[page("title", x, F.lit("<h1>x</h1>") if x != "h1" else F.lit(""), _element(x, title), F.lit("<article>"), text, F.lit("</article>"))
          for x in TITLE_SELECTORS],
        *[page("content", x, F.lit("<h1>"), title, F.lit("</h1>"), outside, _element(x, text)) for x in CONTENT_SELECTORS],
        *[page("date", x, F.lit("<h1>"), title, F.lit("</h1><main>"), text, F.lit("</main>"), _element(x, day)) for x in DATE_SELECTORS])
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.inline(variants)).withColumn("url", F.lit(BASE))
    return extract_content(pages.select("page_id", "variant", "url", "html")).select(
        "page_id", "variant", "title", "content_text", "publication_date", "error_message")


@query
def largest_block(spark, sf_dir):
    """Content area by the largest text block alone (selectors off)."""
    ex = extract_content(read_pages(spark, sf_dir), use_selectors=False)
    content, _ = split_results(ex)
    return content.select("page_id", "content_text")


# -- streaming ------------------------------------------------------------------------
@query
def stream_dedup(spark, sf_dir):
    """The pages table (one file or a folder of files) read as a stream (available-now trigger), links
    extracted per micro-batch, first-seen URLs kept by the idempotent sink."""
    from ..streaming.stream import stream_link_dedup
    # a pattern, as a stream takes a single file only by one
    return stream_link_dedup(spark, f"{sf_dir.rstrip('/')}/pages.parque[t]", glob="*")


@query
def stream_dedup_batches(spark, sf_dir):
    """T3 over four micro-batches: a stream that is started again for each
    arrival of pages; all pages arrive, dealt by id."""
    from ..streaming.stream import stream_link_dedup
    arrivals, incoming, name = _folder(spark, "arrivals"), _folder(spark, "incoming"), uuid.uuid4().hex
    (read_pages(spark, sf_dir).withColumn("arrival", F.pmod("page_id", F.lit(4)))
     .write.partitionBy("arrival").parquet(arrivals))
    for i in range(4):
        spark.read.parquet(f"{arrivals}/arrival={i}").write.mode("append").parquet(incoming)
        out = stream_link_dedup(spark, incoming, name=name)
    return out


@query
def first_pages(spark, sf_dir):
    """D1 on a stored table of wide rows: the first page of each host, its
    html fetched once the ids have settled which it is."""
    from ..operators.dedup import handle_duplicates
    pages = read_pages(spark, sf_dir).withColumn("host", F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)", 1))
    rows = handle_duplicates(pages, "skip", key="host", order=["page_id"], late=True)
    return rows.select("host", "page_id", "url", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("html_md5"))

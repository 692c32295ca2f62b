"""Announcement pages -> ``content`` rows and ``failures`` rows.

One pass per page: the page is parsed once and asked for its fields where it
was parsed (``functions/page.py``); what it says meets given dates, errors and
the run time as Catalyst expressions.  Nothing shuffles; filters on the source
columns (``where``) reach the parquet scan, so filtered pages are never parsed.

Errors are data: a page whose title or text cannot be extracted becomes a
failure row with the message and type the reference reports.
"""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from ..functions.sqltext import F

from ..functions import page as P
from ..functions.dates import NTZ, ntz_lit
from .dedup import first_rows

# Selectors tried in order for the title, the content area and
# the publication date, and the JSON-LD date fields.
TITLE_SELECTORS = ["h1", ".announcement-title", ".post-title", ".article-title", "title"]
CONTENT_SELECTORS = ["article", ".announcement-content", ".post-content", ".article-content",
                     ".content", "main", "#content", ".main-content"]
DATE_SELECTORS = [".publication-date", ".post-date", ".article-date", ".date",
                  "time[datetime]", ".published"]
LD_DATE_FIELDS = ["datePublished", "dateCreated", "dateModified"]
MIN_TEXT = 50          # E5: characters that the text must exceed

# Messages and types of failure rows.
TITLE_ERROR = "Could not extract title from announcement page"
TEXT_ERROR = "Could not extract content text from announcement page"
PARSE_PREFIX = "Content parsing failed: "
PARSE_ERROR_TYPE = "ValueError"
MISSING_PAGE_ERROR = "No crawled page for URL"
MISSING_PAGE_TYPE = "PageNotFound"

# Fixed default for the fallback date and the extraction time.  The reference
# reads the clock; here the run timestamp is an argument so results repeat.
DEFAULT_RUN_TS = datetime(2026, 1, 1, 0, 0, 0)


# -- page driver (E1, E16) --------------------------------------------------------
FIELDS = ["title", "content_text", "embedded_links", "own_date", "ld_error", "parse_error"]

# What the worker reads off a page, as Spark and Arrow name it.
READ_FIELDS = {"titles": ("map<string,string>", pa.map_(pa.string(), pa.string())), "content_text": ("string", pa.string()),
               "embedded_links": P.LINKS, "own_date": (NTZ, pa.timestamp("us")), "ld_error": ("string", pa.string())}


def page_fields(pages: DataFrame, link_scope: str = "area", use_selectors: bool = True,
                month_names: bool = False) -> DataFrame:
    """``pages(url, html, ...)`` -> ``FIELDS`` beside the other columns: what a
    page says by itself, before a given date or the run time come in."""
    keep = [c for c in pages.columns if c != "html"]

    def ask(page: P.Page, url: str | None) -> tuple:
        area = P.content_area(page, CONTENT_SELECTORS if use_selectors else [])
        text = None if area is None else P.formatted_text(page, area)
        date, error = P.jsonld_date(page, LD_DATE_FIELDS)
        return (P.title_texts(page, TITLE_SELECTORS), text if text and len(text) > MIN_TEXT else None,
                None if area is None else P.embedded_links(page, area if link_scope == "area" else 0, url),
                date or P.time_element_date(page) or P.selector_date(page, DATE_SELECTORS) or P.text_date(page, month_names), error)
    return P.ask_pages(pages.select(*keep, "html"), ask, READ_FIELDS).select(*keep, _title().alias("title"), *FIELDS[1:])


def _title() -> Column:
    """The selectors in order; ``titles`` holds what they found."""
    return F.coalesce(*[F.try_element_at(F.col("titles"), F.lit(s)) for s in TITLE_SELECTORS])


def _outcome(fields: DataFrame, keep: list[str], given: Column, run: Column,
             missing: Column | None = None) -> DataFrame:
    """Dates and errors of rows that carry ``FIELDS``; ``missing`` marks rows
    that have no page at all."""
    error = (F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
             .when(F.col("title").isNull(), F.lit(TITLE_ERROR))
             .when(given.isNull() & F.col("ld_error").isNotNull(), F.col("ld_error"))
             .when(F.col("content_text").isNull(), F.lit(TEXT_ERROR)))
    message = F.when(error.isNotNull(), F.concat(F.lit(PARSE_PREFIX), error))
    kind = F.when(error.isNotNull(), F.lit(PARSE_ERROR_TYPE))
    date = F.coalesce(given, F.col("own_date"), run)
    if missing is not None:
        message = F.when(missing, F.lit(MISSING_PAGE_ERROR)).otherwise(message)
        kind = F.when(missing, F.lit(MISSING_PAGE_TYPE)).otherwise(kind)
        date = F.when(~missing, date)
    return fields.select(
        *keep, "title", date.alias("publication_date"), "content_text", "embedded_links",
        run.alias("extraction_timestamp"), message.alias("error_message"), kind.alias("error_type"), _fence())


def extract_content(pages: DataFrame, run_ts: datetime = DEFAULT_RUN_TS,
                    given_date: str | None = None, link_scope: str = "area",
                    use_selectors: bool = True, month_names: bool = False,
                    where: Column | None = None) -> DataFrame:
    """``pages(page_id, url, html[, given_date])`` -> one row per page with the
    content fields, ``error_message`` and ``error_type``.  ``content`` and
    ``failures`` are the two halves (see ``split_results``).  ``where`` is a
    predicate on the page columns applied before parsing (it reaches the
    parquet scan).  A page that cannot be parsed is a failure."""
    if where is not None:
        pages = pages.filter(where)
    keep = [c for c in pages.columns if c != "html"]
    given = F.col(given_date) if given_date else F.lit(None).cast(NTZ)
    fields = page_fields(pages, link_scope, use_selectors, month_names)
    return _outcome(fields, keep, given, ntz_lit(run_ts))


FENCE = "_fence"


def _fence() -> Column:
    """A column the optimizer pushes no filter past (it is not deterministic).
    Without it a filter on ``error_message`` would move below the projections
    and evaluate the whole extraction a second time; a reader that does not
    filter by it never computes it."""
    return F.rand(0).alias(FENCE)


def split_results(extracted: DataFrame):
    """(content, failures) of ``extract_content``'s output."""
    keep = [c for c in extracted.columns
            if c not in ("title", "publication_date", "content_text", "embedded_links",
                         "extraction_timestamp", "error_message", "error_type", FENCE)]
    content = extracted.filter(F.col("error_message").isNull() & (F.col(FENCE) >= 0)).select(
        *keep, "title", "publication_date", "content_text", "embedded_links",
        "extraction_timestamp")
    failures = extracted.filter(F.col("error_message").isNotNull() & (F.col(FENCE) >= 0)).select(
        *[c for c in keep if c != "url"], "url", "error_message", "error_type",
        F.col("extraction_timestamp").alias("timestamp"))
    return content, failures


def extract_links_pages(links: DataFrame, pages: DataFrame, run_ts: datetime = DEFAULT_RUN_TS,
                        **kw) -> DataFrame:
    """Announcement links with the content of their crawled pages.

    Of the pages of one URL the first (smallest page_id) counts, as a crawler
    fetches a link once; only pages that some link names are parsed, each
    once.  Which page is first is settled on ids and urls; the html is read
    for the pages that won.  Links without a page become failure rows.  A link's date is the
    given date of its page (E7).  The joins are shuffle joins on ``url``; a URL
    that very many links name is split by AQE's skew join."""
    wanted = links.select("url").distinct()
    first = first_rows(pages.select("page_id", "url", "html"), "url", ["page_id"], only=wanted)
    fields = page_fields(first.select("url", "html"), **kw).withColumn("_found", F.lit(True))
    joined = links.select("page_id", "ordinal", "url", F.col("publication_date").alias("_given")).join(fields, "url", "left")
    return _outcome(joined, ["url", "page_id", "ordinal"], F.col("_given"), ntz_lit(run_ts), F.col("_found").isNull())

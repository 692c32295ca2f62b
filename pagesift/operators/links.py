"""Links of crawled pages as rows (E13/E14 flat form, L11, L12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from ..functions.sqltext import F

from ..functions import page as P
from ..functions.urls import DEFAULT_DOMAIN, is_announcement_url
from .content import CONTENT_SELECTORS


def page_links(pages: DataFrame, scope: str = "document") -> DataFrame:
    """``pages(page_id, url, html)`` -> one row per embedded link:
    ``page_id, position (1-based), text, url, context``.

    ``scope='document'`` takes every ``a[href]`` of the page (quirk Q11);
    ``scope='area'`` only those of the content area, as E13 does."""
    def ask(page: P.Page, url: str | None) -> tuple:
        where = 0 if scope == "document" else P.content_area(page, CONTENT_SELECTORS)
        return (None if where is None else P.embedded_links(page, where, url),)
    links = P.ask_pages(pages.select("page_id", F.col("url").alias("page_url"), "html"), ask, {"links": P.LINKS}, "page_url")
    return links.select("page_id", "page_url", F.posexplode("links").alias("pos0", "link")) \
        .select("page_id", "page_url", (F.col("pos0") + 1).cast("bigint").alias("position"),
                F.col("link.text").alias("text"), F.col("link.url").alias("url"),
                F.col("link.context").alias("context"))


def screen_links(links: DataFrame, domain: str = DEFAULT_DOMAIN) -> DataFrame:
    """L12 as a column ``accepted`` on link rows."""
    return links.withColumn("accepted", is_announcement_url(F.col("url"), domain))

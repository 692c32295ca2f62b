"""Row renderers for the sinks (C1, C2, K1, K3 row, K4 block, K5 card).

Each announcement becomes one string column built with ``concat`` and array
lambdas; the sinks then write these rows in parallel with the text/CSV/JSON
writers.  No row is rendered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import iso_format, long_date, long_datetime, plain_datetime
from ..functions.text import let


def escape_html(c: Column) -> Column:
    """``& < > " '`` escaped (``&`` first); NULL or empty -> ''."""
    x = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def csv_guard(c: Column) -> Column:
    """Prefix ``'`` when the value starts with = + - @ tab or CR."""
    return let(c, lambda v: F.when(v.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), v)).otherwise(v))


def announcement_struct(prefix: str = "") -> Column:
    """K1: the nested record of one announcement (dates as ISO text)."""
    col = lambda n: F.col(prefix + n)
    return F.struct(
        col("title").alias("title"), col("url").alias("url"),
        iso_format(col("publication_date")).alias("publication_date"),
        col("content_text").alias("content_text"),
        F.coalesce(col("embedded_links"),
                   F.array().cast("array<struct<text:string,url:string,context:string>>")).alias("embedded_links"),
        iso_format(col("extraction_timestamp")).alias("extraction_timestamp"))


def csv_columns(include_metadata: bool = True) -> list[Column]:
    """K3: the six CSV columns (+ total_processed, execution_time)."""
    cols = [csv_guard(F.col("title")).alias("title"), F.col("url"),
            iso_format(F.col("publication_date")).alias("publication_date"),
            csv_guard(F.col("content_text")).alias("content_text"),
            F.size(F.coalesce(F.col("embedded_links"), F.array())).cast("bigint").alias("embedded_links_count"),
            iso_format(F.col("extraction_timestamp")).alias("extraction_timestamp")]
    if include_metadata:
        cols += [F.col("total_processed"), F.col("execution_time")]
    return cols


def txt_block(number: Column) -> Column:
    """K4: one numbered announcement block of the text report."""
    links = F.coalesce(F.col("embedded_links"),
                       F.array().cast("array<struct<text:string,url:string,context:string>>"))
    link_lines = F.array_join(F.transform(links, lambda l, i: F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". "), l["text"], F.lit(" -> "), l["url"], F.lit("\n"),
        F.when(F.coalesce(l["context"], F.lit("")) != "",
               F.concat(F.lit("     Context: "), l["context"], F.lit("\n"))).otherwise(F.lit("")))), "")
    return F.concat(
        F.lit("Announcement "), number.cast("string"), F.lit("\n"), F.lit("-" * 20 + "\n"),
        F.lit("Title: "), F.col("title"), F.lit("\n"),
        F.lit("URL: "), F.col("url"), F.lit("\n"),
        F.lit("Publication Date: "), plain_datetime(F.col("publication_date")), F.lit("\n"),
        F.lit("Extraction Time: "), plain_datetime(F.col("extraction_timestamp")), F.lit("\n"),
        F.lit("\nContent:\n"), F.col("content_text"), F.lit("\n"),
        F.when(F.size(links) > 0, F.concat(
            F.lit("\nEmbedded Links ("), F.size(links).cast("string"), F.lit("):\n"), link_lines))
        .otherwise(F.lit("")),
        F.lit("\n" + "=" * 60 + "\n\n"))


def html_card() -> Column:
    """K5: one escaped announcement card of the HTML report (the fixed page
    frame, style sheet and script are not built)."""
    links = F.coalesce(F.col("embedded_links"),
                       F.array().cast("array<struct<text:string,url:string,context:string>>"))
    items = F.array_join(F.transform(links, lambda l: F.concat(
        F.lit('\n                <div class="link-item">\n                    <div class="link-text">'),
        escape_html(l["text"]), F.lit('</div>\n                    <div><a href="'), escape_html(l["url"]),
        F.lit('" class="link-url" target="_blank">'), escape_html(l["url"]), F.lit("</a></div>\n"),
        F.when(F.coalesce(l["context"], F.lit("")) != "",
               F.concat(F.lit('                    <div class="link-context">'), escape_html(l["context"]),
                        F.lit("</div>\n"))).otherwise(F.lit("")),
        F.lit("                </div>\n"))), "")
    url = escape_html(F.col("url"))
    return F.concat(
        F.lit('\n    <div class="announcement" data-search="'),
        escape_html(F.concat(F.lower(F.col("title")), F.lit(" "), F.lower(F.col("content_text")))),
        F.lit('">\n        <div class="announcement-header">\n            <h3 class="announcement-title">'),
        escape_html(F.col("title")),
        F.lit('</h3>\n            <div class="announcement-meta">\n                <div><strong>URL:</strong> <a href="'),
        url, F.lit('" class="announcement-url" target="_blank">'), url,
        F.lit("</a></div>\n                <div><strong>Published:</strong> "), long_date(F.col("publication_date")),
        F.lit("</div>\n                <div><strong>Extracted:</strong> "), long_datetime(F.col("extraction_timestamp")),
        F.lit('</div>\n            </div>\n        </div>\n        <div class="announcement-content">\n'
              '            <div class="content-text">'),
        escape_html(F.col("content_text")), F.lit("</div>\n"),
        F.when(F.size(links) > 0, F.concat(
            F.lit('\n            <div class="embedded-links">\n                <h4>Embedded Links ('),
            F.size(links).cast("string"), F.lit(")</h4>\n"), items, F.lit("            </div>\n")))
        .otherwise(F.lit("")),
        F.lit("        </div>\n    </div>\n"))

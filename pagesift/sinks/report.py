"""Whole reports (K2, K4, K5) as ordered part files, and runs as partitions (K7).

A report is a DataFrame of pieces ``(section, n, value)``: a head, one piece per
announcement, one per failure, and the pieces between and after them.  It is
sorted by range on ``(section, n)`` and written by the parallel text writer, so
the part files joined in the order of their names are the report.  Numbers and
the commas of JSON come from the skew-safe positions, never from one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_format, plain_datetime
from ..operators.dedup import handle_duplicates
from ..operators.ranking import positions
from ..operators.render import announcement_struct, escape_html, html_card, txt_block
from ..session import materialize
from .writers import VERSION

REPORTS = ("json", "txt", "html")

# The markup and headings of the reports.
TXT_TITLE = "AWS Announcements Scraping Results\n" + "=" * 40 + "\n\n"
TXT_FAILURES = "Failed Extractions\n" + "=" * 20 + "\n\n"
HTML_HEAD = '<!DOCTYPE html>\n<html lang="en">\n<head>\n    <meta charset="UTF-8">\n</head>\n'
HTML_BODY = ('<body>\n    <div class="header">\n        <h1>AWS Announcements</h1>\n        <p>Scraping Results</p>\n    </div>\n')
HTML_STAT = ('            <div class="stat-item">\n                <div class="stat-value">{}</div>\n'
             '                <div class="stat-label">{}</div>\n            </div>\n')
HTML_META = ('            <div class="metadata-item">\n                <div class="metadata-label">{}</div>\n'
             '                <div class="metadata-value">{}</div>\n            </div>\n')
HTML_FAILURES = '        <div class="failed-extractions">\n            <h4>Failed Extractions ({})</h4>\n'
HTML_SEARCH = ('\n    <div class="search-box">\n        <input type="text" class="search-input" '
               'placeholder="Search announcements by title or content..." \n'
               '               onkeyup="searchAnnouncements(this.value)">\n    </div>\n')


def _fill(template: str, *values) -> str:
    for v in values:
        template = template.replace("{}", str(v), 1)
    return template


def _txt(run: dict) -> dict[int, str]:
    head = (f"{TXT_TITLE}Extraction Date: {run['run_ts']:%Y-%m-%d %H:%M:%S}\nTotal Processed: {run['total']}\n"
            f"Successful Extractions: {run['ok']}\nFailed Extractions: {run['bad']}\n"
            f"Execution Time: {run['execution_time']:.2f} seconds\nDuplicate Handling: {run['duplicate_handling']}\n\n")
    return {0: head if run["metadata"] else "", 2: TXT_FAILURES if run["metadata"] and run["bad"] else "", 4: ""}


def _html(run: dict) -> dict[int, str]:
    head, tail = HTML_HEAD + HTML_BODY, "\n</body>\n</html>\n"
    between = ""
    if run["metadata"]:
        stats = [(run["ok"], "Successful Extractions"), (run["total"], "Total Processed"), (run["bad"], "Failed Extractions"),
                 (f"{run['execution_time']:.1f}s", "Execution Time")]
        head += ('\n    <div class="summary">\n        <h2>Summary</h2>\n        <div class="stats">\n'
                 + "".join(_fill(HTML_STAT, *s) for s in stats) + "        </div>\n    </div>\n")
        grid = [("Extraction Timestamp", f"{run['run_ts']:%Y-%m-%d %H:%M:%S}"), ("Scraper Version", VERSION), ("Output Format", "html"),
                ("Duplicate Handling", run["duplicate_handling"])]
        given = [("HTTP Timeout", run["timeout"] and f"{run['timeout']}s"), ("Max Retries", run["max_retries"]), ("Date Filter", run["date_filter"])]
        between = ('\n    <div class="metadata">\n        <h3>Extraction Metadata</h3>\n        <div class="metadata-grid">\n'
                   + "".join(_fill(HTML_META, *g) for g in grid) + "".join("\n" + _fill(HTML_META, *g) for g in given if g[1]) + "        </div>\n")
        if run["bad"]:
            between += "\n" + _fill(HTML_FAILURES, run["bad"])
            tail = "        </div>\n" + "    </div>\n" + tail
        else:
            tail = "    </div>\n" + tail
    return {0: head + HTML_SEARCH, 2: between, 4: tail}


def _json(run: dict) -> dict[int, Column]:
    s = F.struct(*(F.lit(v).alias(k) for k, v in (
        ("total_processed", run["total"]), ("successful_extractions", run["ok"]), ("failed_extractions", run["bad"]),
        ("execution_time", float(run["execution_time"])))))
    m = F.struct(
        F.lit(run["run_ts"].isoformat()).alias("extraction_timestamp"), F.lit(VERSION).alias("scraper_version"), F.lit("json").alias("output_format"),
        F.lit(run["duplicate_handling"]).alias("duplicate_handling"),
        F.struct(*(F.lit(run[k]).cast(t).alias(k) for k, t in (("timeout", "int"), ("max_retries", "int"), ("date_filter", "string")))).alias("configuration"))
    between = F.concat(F.lit('],\n"summary": '), F.to_json(s))
    if run["metadata"]:
        between = F.concat(between, F.lit(',\n"metadata": '), F.to_json(m, {"ignoreNullFields": "false"}))
        if run["bad"]:
            between = F.concat(between, F.lit(',\n"failed_extractions": ['))
    return {0: F.lit('{"announcements": ['), 2: between, 4: F.lit("]}" if run["metadata"] and run["bad"] else "}")}


def _announcement(fmt: str) -> Column:
    if fmt == "txt":
        return txt_block(F.col("n"))
    if fmt == "html":
        return html_card()
    return F.concat(F.when(F.col("n") > 1, F.lit(",")).otherwise(F.lit("")), F.to_json(announcement_struct(), {"ignoreNullFields": "false"}))


def _failure(fmt: str) -> Column:
    time = plain_datetime(F.col("timestamp"))
    if fmt == "txt":
        return F.concat(F.lit("URL: "), F.col("url"), F.lit("\nError: "), F.col("error_message"), F.lit("\nType: "), F.col("error_type"),
                        F.lit("\nTime: "), time, F.lit("\n\n"))
    if fmt == "html":
        return F.concat(
            F.lit('\n            <div class="failed-item">\n                <div><strong>URL:</strong> '), escape_html(F.col("url")),
            F.lit("</div>\n                <div><strong>Error:</strong> "), escape_html(F.col("error_message")),
            F.lit("</div>\n                <div><strong>Type:</strong> "), F.col("error_type"),
            F.lit("</div>\n                <div><strong>Time:</strong> "), time, F.lit("</div>\n            </div>\n"))
    row = F.struct("url", "error_message", "error_type", iso_format(F.col("timestamp")).alias("timestamp"))
    return F.concat(F.when(F.col("n") > 1, F.lit(",")).otherwise(F.lit("")), F.to_json(row, {"ignoreNullFields": "false"}))


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    return positions(df.withColumn("_run", F.lit(1)), ["_run"], order[0], order[1:], "n")


def report(content: DataFrame, failures: DataFrame, fmt: str, run_ts: datetime, duplicate_handling: str = "skip",
           include_metadata: bool = True, execution_time: float = 0.0, total_processed: int | None = None,
           order: list[str] | None = None, seen: DataFrame | None = None, timeout: int | None = None,
           max_retries: int | None = None, date_filter: str | None = None) -> DataFrame:
    """The pieces of a report, ``(section, n, value)``; each value ends where
    its last line ends.  Duplicates are handled first; ``order`` is the order
    of announcements and failures, an integer column first."""
    if fmt not in REPORTS:
        raise ValueError(f"Unsupported report format: {fmt}")
    order = order or ["page_id"]
    content, failures = materialize(content), materialize(failures)
    bad = failures.count()
    total = content.count() + bad if total_processed is None else total_processed
    content = materialize(handle_duplicates(content, duplicate_handling, order=order, seen=seen))
    run = {"run_ts": run_ts, "total": total, "ok": content.count(), "bad": bad, "execution_time": execution_time,
           "duplicate_handling": duplicate_handling, "metadata": include_metadata, "timeout": timeout,
           "max_retries": max_retries, "date_filter": date_filter}
    fixed = {"txt": _txt, "html": _html, "json": _json}[fmt](run)
    one = content.sparkSession.range(1)
    pieces = _numbered(content, order).select(F.lit(1).alias("section"), "n", _announcement(fmt).alias("value"))
    if include_metadata:
        pieces = pieces.unionByName(_numbered(failures, order).select(F.lit(3).alias("section"), "n", _failure(fmt).alias("value")))
    for section, value in fixed.items():
        value = value if isinstance(value, Column) else F.lit(value)
        pieces = pieces.unionByName(one.select(F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("n"), value.alias("value")))
    # the text writer ends every row with a line break
    return pieces.filter(F.col("value") != "").withColumn("value", F.regexp_replace("value", "\n\\z", ""))


def write_report(content: DataFrame, failures: DataFrame, path: str, fmt: str, run_ts: datetime, **settings) -> str:
    """Write ``report`` as text files that, joined by name, are the report."""
    report(content, failures, fmt, run_ts, **settings).orderBy("section", "n").select("value").write.mode("overwrite").text(path)
    return path


PART_BYTES = 1 << 40      # more than a part file has


def report_lines(spark, path: str) -> DataFrame:
    """``(line_no, line)`` of a written report, its parts joined by name.  A
    part is read in the splits of the scan, never whole: lines follow each other
    as they are read in a split, splits by where they start."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        (F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint") * PART_BYTES
         + F.col("_metadata.file_block_start")).alias("split"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    return positions(lines.withColumn("_run", F.lit(1)), ["_run"], "split", ["pos"], "line_no").select("line_no", "line")


# -- runs as partitions -------------------------------------------------------------------
def write_partition(content: DataFrame, path: str, run_ts: datetime, language: str = "en") -> str:
    """One run's announcements under ``run=.../language=...``; writing the run
    again replaces its own partition and leaves all others alone."""
    rows = content.select(announcement_struct().alias("a")).select("a.*")
    rows = rows.withColumn("run", F.lit(run_ts.strftime("%Y%m%d_%H%M%S"))).withColumn("language", F.lit(language))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "language").parquet(path)
    return path


def read_runs(spark, path: str, run_ts: datetime | None = None, language: str | None = None) -> DataFrame:
    """The stored announcements; the run and the language prune partitions."""
    rows = spark.read.option("basePath", path).schema(
        spark.read.parquet(path).drop("run", "language").schema.add("run", "string").add("language", "string")).parquet(path)
    if run_ts is not None:
        rows = rows.filter(F.col("run") == run_ts.strftime("%Y%m%d_%H%M%S"))
    return rows if language is None else rows.filter(F.col("language") == language)

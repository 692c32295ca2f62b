"""Result writers (K0, K2, K3, K4, K5, K6, K7).

Every format is written by Spark's parallel writers, one part file per task;
nothing is collected on the driver.  The run summary and the metadata are
one-row tables written next to the rows.  A single-document export (one
JSON file holding everything) is deliberately not offered: it would pass the
whole result through one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_format, plain_datetime
from ..operators.dedup import handle_duplicates
from ..operators.ranking import positions
from ..operators.render import announcement_struct, csv_columns, escape_html, html_card, txt_block
from ..session import materialize

FORMATS = ("json", "csv", "txt", "html")
VERSION = "1.0.0"


def output_dir(base: str, run_ts: datetime, language: str = "en",
               template: str = "announcements_{timestamp}") -> str:
    """K7: ``<base>/<template with the run time>_<language>``."""
    return f"{base.rstrip('/')}/{template.format(timestamp=run_ts.strftime('%Y%m%d_%H%M%S'))}_{language}"


def write_run(content: DataFrame, failures: DataFrame, base: str, run_ts: datetime,
              language: str = "en", **settings) -> str:
    """``write_results`` into the run's own folder under ``base`` (K7)."""
    return write_results(content, failures, output_dir(base, run_ts, language), run_ts=run_ts, **settings)


def summary_row(spark, total_processed: DataFrame | int, content: DataFrame, failures: DataFrame,
                execution_time: float) -> DataFrame:
    """One-row summary (A1) from three counts."""
    total = (total_processed if isinstance(total_processed, DataFrame)
             else spark.range(1).select(F.lit(total_processed).cast("bigint").alias("total_processed")))
    ok = content.agg(F.count(F.lit(1)).alias("successful_extractions"))
    bad = failures.agg(F.count(F.lit(1)).alias("failed_extractions"))
    return total.crossJoin(ok).crossJoin(bad).withColumn("execution_time", F.lit(float(execution_time)))


def metadata_row(spark, run_ts: datetime, fmt: str, duplicate_handling: str,
                 timeout=None, max_retries=None, date_filter=None) -> DataFrame:
    """K6"""
    return spark.createDataFrame(
        [(run_ts.isoformat(), VERSION, fmt, duplicate_handling, timeout, max_retries, date_filter)],
        "extraction_timestamp string, scraper_version string, output_format string, "
        "duplicate_handling string, timeout int, max_retries int, date_filter string")


def write_results(content: DataFrame, failures: DataFrame, path: str, fmt: str = "json",
                  duplicate_handling: str = "skip", include_metadata: bool = True,
                  total_processed: DataFrame | int | None = None, execution_time: float = 0.0,
                  run_ts: datetime | None = None, seen: DataFrame | None = None,
                  order: list[str] | None = None, timeout: int | None = None,
                  max_retries: int | None = None, date_filter: str | None = None) -> str:
    """K0: apply the duplicate strategy and write ``content`` (and, with
    metadata, summary / metadata / failures) under ``path`` in ``fmt``.

    Both inputs are written once to the shared folder first, so the counts,
    the summary and the output do not extract the pages again.  The total
    (A1) counts what was processed, before duplicates are dropped."""
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported output format: {fmt}")
    spark = content.sparkSession
    run_ts = run_ts or datetime(2026, 1, 1)
    order = order or ["page_id"]
    content, failures = materialize(content), materialize(failures)
    if total_processed is None:
        total_processed = content.count() + failures.count()
    content = handle_duplicates(content, duplicate_handling, order=order, seen=seen)
    summary = summary_row(spark, total_processed, content, failures, execution_time)

    if fmt == "json":
        content.select(announcement_struct().alias("a")).select("a.*").write.mode("overwrite").json(
            f"{path}/announcements")
    elif fmt == "csv":
        rows = content.crossJoin(F.broadcast(summary.select("total_processed", "execution_time"))) \
            if include_metadata else content
        rows.select(*csv_columns(include_metadata)).write.mode("overwrite").csv(
            f"{path}/announcements", header=True, escape='"', emptyValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif fmt == "txt":
        numbered = positions(content.withColumn("_run", F.lit(1)), ["_run"], order[0], order[1:], "n")
        numbered.orderBy(*order).select(txt_block(F.col("n")).alias("value")) \
            .write.mode("overwrite").text(f"{path}/announcements")
    else:
        content.orderBy(*order).select(html_card().alias("value")).write.mode("overwrite").text(
            f"{path}/announcements")

    if include_metadata:
        summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
        metadata_row(spark, run_ts, fmt, duplicate_handling, timeout, max_retries, date_filter).coalesce(1).write.mode("overwrite").json(
            f"{path}/metadata")
        fails = failures.select(
            "url", "error_message", "error_type", iso_format(F.col("timestamp")).alias("timestamp"))
        if fmt == "txt":
            fails.select(F.concat(F.lit("URL: "), F.col("url"), F.lit("\nError: "), F.col("error_message"),
                                  F.lit("\nType: "), F.col("error_type"), F.lit("\nTime: "),
                                  plain_datetime(F.to_timestamp("timestamp")), F.lit("\n")).alias("value")) \
                .write.mode("overwrite").text(f"{path}/failed_extractions")
        elif fmt == "html":
            fails.select(F.concat(
                F.lit('\n            <div class="failed-item">\n                <div><strong>URL:</strong> '),
                escape_html(F.col("url")), F.lit("</div>\n                <div><strong>Error:</strong> "),
                escape_html(F.col("error_message")), F.lit("</div>\n                <div><strong>Type:</strong> "),
                F.col("error_type"), F.lit("</div>\n            </div>\n")).alias("value")) \
                .write.mode("overwrite").text(f"{path}/failed_extractions")
        else:
            fails.write.mode("overwrite").json(f"{path}/failed_extractions")
    return path

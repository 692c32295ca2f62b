"""Table sources: the crawled pages and the other parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table; naming columns prunes the scan to them."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


# Session setting: deal crawled pages over so many partitions after the read.
# Unset (the default) the scan's own splits are kept and nothing is shuffled;
# set it where the input is one small file of one row group.
PAGE_PARTITIONS = "pagesift.pages.partitions"


def read_pages(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """``pages(page_id, url, html)``; each row one crawled page.  ``partitions``
    (default: the session setting ``PAGE_PARTITIONS``) deals the rows out anew."""
    df = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    partitions = partitions or int(spark.conf.get(PAGE_PARTITIONS, "0"))
    return df.repartition(partitions) if partitions else df


def deal_rows(df: DataFrame) -> DataFrame:
    """Narrow rows that become pages, dealt over all cores.  A row of a few bytes
    turns into pages that take a thousand times as long to parse as it takes to
    read, so the scan's splits, which follow bytes and row groups, would leave most
    cores idle.  The session setting ``PAGE_PARTITIONS`` names another number."""
    spark = df.sparkSession
    partitions = int(spark.conf.get(PAGE_PARTITIONS, "0")) or max(LEAST_DEAL, 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(partitions)


LEAST_DEAL = 48        # executors may come after the plan is made

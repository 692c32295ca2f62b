"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# A key with more than 1/HOT_SHARE of all rows is "hot"; there are at most
# HOT_SHARE such keys whatever the data, so a table of one small row per hot
# key has a proven size bound and may be broadcast.
HOT_SHARE = 1000


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DROP_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, batch_rows: int | None = None, drop_shuffle: bool = False) -> DataFrame:
    """Write an intermediate that is read more than once as Parquet in the
    shared folder (``spark.checkpoint.dir``) and read it back: the lineage is
    cut, and a lost executor costs only the tasks that ran on it.
    ``batch_rows`` bounds the Arrow batches of this write, for wide rows;
    with ``drop_shuffle`` the shuffle files of this write go when it ends, not
    when the driver's garbage collection comes to them."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    settings = ({ARROW_ROWS: batch_rows} if batch_rows else {}) | ({DROP_SHUFFLE: True} if drop_shuffle else {})
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one parquet table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def hot_keys(keys: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``(key, n)`` of the keys that hold more than 1/HOT_SHARE of the rows of
    ``keys`` (at most HOT_SHARE rows).  Counted with map-side combine."""
    counts = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = keys.count() if total is None else total
    return counts.filter(F.col("n") * HOT_SHARE > total)


def lookup_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of ``left`` (any number of rows per key) to ``right`` (one
    small row per key) with no hot key in one task: rows of hot keys meet
    their right row by a broadcast of at most HOT_SHARE rows, all other rows
    by a shuffle in which no key has more than 1/HOT_SHARE of the rows.
    ``left`` should be staged: it is read for the counts and for either half."""
    hot = stage(hot_keys(left.select(key), key).select(key), "hot").withColumn("__hot", F.lit(True))
    marked = left.join(F.broadcast(hot), key, "left")
    few = right.join(F.broadcast(hot.select(key)), key, "left_semi")
    a = marked.filter(F.col("__hot")).drop("__hot").join(F.broadcast(few), key)
    b = marked.filter(F.col("__hot").isNull()).drop("__hot").join(right, key)
    return a.unionByName(b)


def slices(batches, column: str, max_bytes: int = 1 << 20):
    """Cut Arrow batches into pieces whose ``column`` (string or binary) holds
    about ``max_bytes`` each (one longer value stays whole), so a task's
    working set follows bytes, not rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        lengths = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i in range(n):
            size += int(lengths[i])
            if size >= max_bytes or i == n - 1:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0


def texts_of(batch, column: str = "text") -> list[str]:
    """The strings of a column, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or "" for x in col.to_pylist()]

"""Streams of crawled pages.

* T1: the extraction operators are row-local, so they run unchanged on a
  streaming DataFrame (append mode, no state).
* T2: first-seen deduplication across batches.  ``dropDuplicates(['url'])``
  keeps state for every URL ever seen (as the reference's set does);
  ``withWatermark`` + ``dropDuplicatesWithinWatermark`` bounds that state.
* T3: an idempotent sink via ``foreachBatch``: inside a batch the first row
  per URL wins (by the explicit order, not arrival), URLs stored by earlier
  batches are removed with the help of a store of keys alone, and the batch
  replaces only its own ``batch_id`` partition, so a replayed batch after a
  failure writes the same rows again instead of duplicating them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import first_per_key
from ..session import checkpoint_dir, materialize

PAGES_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()),
                             T.StructField("url", T.StringType()),
                             T.StructField("html", T.StringType())])


def read_page_stream(spark: SparkSession, directory: str, glob: str = "*.parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of crawled pages arriving in ``directory`` (T1 source); a
    pattern may stand for it."""
    r = spark.readStream.schema(PAGES_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def dedup_state(stream: DataFrame, key: str = "url", event_time: str | None = None,
                delay: str = "1 day") -> DataFrame:
    """T2 on a stream: exact (unbounded state) or watermark-bounded."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


FAN_IN = 8


def key_runs(n: int, fan_in: int = FAN_IN) -> list[tuple[int, int]]:
    """The runs (first batch, last batch) that hold the keys of the batches
    0 .. n - 1: at most ``fan_in - 1`` of each size 1, ``fan_in``, ...  They follow
    from ``n`` alone, so a replayed batch reads what it read the first time."""
    runs, at = [], 0
    while at < n:
        size = 1
        while at % (size * fan_in) == 0 and at + size * fan_in <= n:
            size *= fan_in
        runs.append((at, at + size - 1))
        at += size
    return runs


def merges(n: int, fan_in: int = FAN_IN) -> list[list[tuple[int, int]]]:
    """The groups of runs that become one run each once ``n`` batches are in,
    smallest first."""
    found, size = [], 1
    while n % (size * fan_in) == 0:
        start = n - size * fan_in
        found.append([(at, at + size - 1) for at in range(start, n, size)])
        size *= fan_in
    return found


class KeyStore:
    """Keys of earlier batches in runs, one folder each.  A batch adds a run;
    every ``fan_in`` runs of a size are merged into one, so a batch reads
    at most ``fan_in - 1`` runs of each size (a logarithm of the batches) and
    a key is rewritten once a size.  Runs are replaced as a whole, so a batch
    that fails anywhere can be replayed."""

    def __init__(self, spark: SparkSession, path: str, field: T.StructField, fan_in: int = FAN_IN):
        if fan_in < 2:
            raise ValueError("fan_in must be 2 or more")
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.schema = T.StructType([field])

    def folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]}"

    def before(self, batch_id: int) -> DataFrame | None:
        runs = key_runs(batch_id, self.fan_in)
        return self.read(runs) if runs else None

    def read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*map(self.folder, runs))

    def add(self, batch_id: int, keys: DataFrame):
        """Write the run of a batch, then the merges it completes."""
        keys.select(*self.schema.names).write.mode("overwrite").parquet(self.folder((batch_id, batch_id)))
        for group in merges(batch_id + 1, self.fan_in):
            # the exchange lets the many small files of the runs become few
            (self.read(group).repartition(*self.schema.names)
             .write.mode("overwrite").parquet(self.folder((group[0][0], group[-1][1]))))

    def retire(self, batch_id: int):
        """Delete the runs that the batch before ``batch_id`` has merged.  Once
        ``batch_id`` begins, the one before is committed and never replayed."""
        for group in merges(batch_id, self.fan_in) if batch_id else []:
            for run in group:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(run))
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def skip_sink(path: str, key: str = "url", order: list[str] | None = None, fan_in: int = FAN_IN):
    """A ``foreachBatch`` function writing first-seen rows to ``path/rows``.

    The keys stored so far lie apart from the rows, in ``path/keys``
    (``KeyStore``).  A batch scans that one narrow column and keeps of it what
    its own keys name; these are few, so the store is not shuffled while the
    batch's keys are small enough to be broadcast at run time.  ``path/rows`` is
    partitioned by ``batch_id`` and a replayed batch replaces its own
    partition, so it leaves the sink as it was.  The ids of the batches must
    follow one another from 0, as a stream's do."""
    order = order or ["page_id", "position"]

    def write(batch: DataFrame, batch_id: int):
        store = KeyStore(batch.sparkSession, f"{path}/keys", batch.schema[key], fan_in)
        store.retire(batch_id)
        firsts = first_per_key(batch, key, order)
        stored = store.before(batch_id)
        if stored is not None:
            firsts = materialize(firsts)       # read for its keys and for its rows
            known = stored.join(firsts.select(key), key, "left_semi")
            firsts = firsts.join(known, key, "left_anti")
        firsts = materialize(firsts.withColumn("batch_id", F.lit(batch_id).cast("bigint")))
        (firsts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(f"{path}/rows"))
        # keys last: a batch that fails between the two is replayed and writes both again
        store.add(batch_id, firsts)
    return write


def run_available(stream: DataFrame, sink_fn, name: str) -> str:
    """Run a ``foreachBatch`` stream over everything available now.  The
    stream's checkpoint lies in the shared folder under ``name``: started again
    with the same name, the stream goes on where it stopped."""
    spark = stream.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    q = (stream.writeStream.foreachBatch(sink_fn).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return ckpt


ROWS = "url string, page_id bigint, position bigint, title string, batch_id bigint"


def stream_link_dedup(spark: SparkSession, directory: str, glob: str = "*.parquet",
                      max_files_per_trigger: int | None = None, name: str | None = None) -> DataFrame:
    """T1 + T3: pages streamed from files -> links -> first-seen URLs.  Returns
    the sink as a batch DataFrame.  ``name`` identifies the stream and its
    sink; without one the run cannot be resumed."""
    from ..operators.links import page_links
    name = name or uuid.uuid4().hex
    pages = read_page_stream(spark, directory, glob, max_files_per_trigger)
    links = page_links(pages, scope="document").select(
        "page_id", "position",
        F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1).alias("url"),
        F.col("text").alias("title"))
    sink = f"{checkpoint_dir(spark).rstrip('/')}/sinks/{name}"
    run_available(links, skip_sink(sink), name)
    # a stream that had no page has written no row
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/rows")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(f"{sink}/rows")

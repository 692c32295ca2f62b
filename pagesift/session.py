"""Spark session set-up shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every query here depends on: naive timestamps are compared in UTC,
# AQE coalesces the many small shuffle partitions of small runs and splits
# skewed ones on big runs, and the web UI stays off (no server is opened).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


LOCAL = re.compile(r"local(\[.*\])?")       # one process; local-cluster[...] is not


def get_session(master: str | None = None, app: str = "pagesift",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if master and LOCAL.fullmatch(master):
        conf["spark.driver.memory"] = "8g"   # local mode: the driver JVM runs the tasks
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package: it goes to every executor as a
    zip (``addPyFile``), once per application, so a query runs from any
    working folder and on executors that have no copy of the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_pagesift_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="pagesift-zip-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(str(path))
    sc._pagesift_shipped = True
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` from the
    session.  Only a local master that names none (tests, a laptop) gets a
    scratch folder, recorded in the session so later calls agree; on a cluster
    a machine-local folder would lose data, so that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pagesift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df):
    """Cut the lineage of an expensive intermediate (parsed pages) that a
    query reads more than once: a reliable checkpoint in the shared folder,
    so later stages and retried tasks read it instead of parsing again.
    Never ``localCheckpoint``: executors may be lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

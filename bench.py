"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries",
"sf", ...}.  Each query is run to completion with a ``noop`` write (all rows
computed, nothing collected to the driver); one warm-up pass of a small
query first starts the Python workers so they are not charged to query 1.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagesift.plans import catalog  # noqa: E402
from pagesift.session import get_session  # noqa: E402
from pagesift.sources.tables import PAGE_PARTITIONS  # noqa: E402

HEADLINE = ["page_title", "page_content", "page_failures", "page_links", "dedup_skip",
            "dedup_version", "month_filter", "listing_json_links", "run_summary",
            "fetch_outcome", "html_cards", "category_counts", "parse_dates", "stream_dedup"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "8g"})
    spark.conf.set(PAGE_PARTITIONS, cpus)   # sf0.1 pages are one small file
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    names = [n for n in HEADLINE if n in catalog.QUERIES]
    # warm-up: start the Python workers and the JIT on the smallest data set
    smoke = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    for q in ("page_title", "month_filter"):
        catalog.QUERIES[q](spark, smoke).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    extract = times.get("page_content", 0) or 1e-9
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "cpus": int(cpus),
        "pages_per_sec_extraction": round(pages / extract, 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

import json
import os
import shutil
import subprocess
import sys

from conftest import SF
from pyspark.sql import functions as F

from pagesift.plans import catalog


def test_stream_equals_batch(spark):
    s = sorted(map(tuple, catalog.stream_dedup(spark, SF).select("url", "page_id", "position", "title").collect()))
    b = sorted(map(tuple, catalog.dedup_skip(spark, SF).select("url", "page_id", "position", "title").collect()))
    assert s == b and len(s) > 0


def test_write_results_all_formats(spark, tmp_path):
    from pagesift.operators.content import extract_content, split_results
    from pagesift.sinks.writers import write_results
    from pagesift.sources.tables import read_pages
    content, failures = split_results(extract_content(read_pages(spark, SF)))
    n = content.count()
    for fmt in ("json", "csv", "txt", "html"):
        out = write_results(content, failures, str(tmp_path / fmt), fmt=fmt, total_processed=50)
        parts = [f for f in os.listdir(f"{out}/announcements") if f.startswith("part-")]
        assert parts
        summ = [json.loads(line) for f in os.listdir(f"{out}/summary") if f.startswith("part-")
                for line in open(f"{out}/summary/{f}")]
        assert summ[0]["total_processed"] == 50 and summ[0]["successful_extractions"] == n
    back = spark.read.csv(str(tmp_path / "csv" / "announcements"), header=True, multiLine=True, escape='"')
    assert back.count() == n
    import pytest
    with pytest.raises(ValueError):
        write_results(content, failures, str(tmp_path / "x"), fmt="xml")


def page_files(spark, folder, n=3):
    """The smoke pages in ``n`` files, read one per micro-batch."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for i in range(n):
        pages.filter(F.col("page_id") % n == i).coalesce(1).write.parquet(f"{folder}/in{i}")
        part = next(f for f in os.listdir(f"{folder}/in{i}") if f.endswith(".parquet"))
        shutil.copy(f"{folder}/in{i}/{part}", f"{folder}/p{i}.parquet")


def test_stream_of_several_batches_resumes_and_replays(spark, tmp_path):
    from pagesift.streaming.stream import skip_sink, stream_link_dedup
    page_files(spark, str(tmp_path))
    name = f"t-{tmp_path.name}-{os.getpid()}"
    rows = stream_link_dedup(spark, str(tmp_path), max_files_per_trigger=1, name=name)
    got = rows.collect()
    assert rows.select("batch_id").distinct().count() == 3
    assert len({r.url for r in got}) == len(got) == catalog.dedup_skip(spark, SF).count()
    again = stream_link_dedup(spark, str(tmp_path), max_files_per_trigger=1, name=name)   # nothing new
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    sink = f"{tmp_path}/sink"
    write = skip_sink(sink)
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], "page_id long, position long, url string")
    write(df.filter("page_id = 1"), 0)
    write(df, 1)
    write(df.withColumn("url", F.concat("url", F.lit("x"))), 2)
    before = sorted(map(tuple, spark.read.parquet(f"{sink}/rows").collect()))
    write(df, 1)
    write(df.withColumn("url", F.concat("url", F.lit("x"))), 2)
    assert sorted(map(tuple, spark.read.parquet(f"{sink}/rows").collect())) == before
    assert sorted(r.url for r in spark.read.parquet(f"{sink}/rows").collect()) == ["a", "ax", "b", "bx"]


def test_runs_of_the_key_store():
    from pagesift.streaming.stream import key_runs, merges
    for fan_in in (2, 3, 8):
        there = set()
        for n in range(600):
            runs = key_runs(n, fan_in)
            assert [x for a, b in runs for x in range(a, b + 1)] == list(range(n)) and set(runs) <= there
            sizes = [b - a for a, b in runs]
            assert all(sizes.count(x) < fan_in for x in sizes)
            there.add((n, n))
            for group in merges(n + 1, fan_in):
                assert len(group) == fan_in and set(group) <= there
                there.add((group[0][0], group[-1][1]))


def test_many_batches_read_few_files_and_replay(spark, tmp_path):
    from pagesift.streaming.stream import KeyStore, skip_sink
    sink, seen, want = f"{tmp_path}/s", set(), {}
    write = skip_sink(sink, fan_in=3)
    field = spark.createDataFrame([], "url string").schema["url"]
    for b in range(21):
        rows = [(b, i, u) for i, u in enumerate([f"u{b}", f"u{b // 2}", "hub", f"n{b % 4}"])]
        df = spark.createDataFrame(rows, "page_id long, position long, url string").coalesce(1)
        write(df, b)
        if b % 5 == 2:
            write(df, b)             # the last batch may come again
        want[b] = sorted({u for *_, u in rows} - seen)
        seen |= {u for *_, u in rows}
        files = KeyStore(spark, f"{sink}/keys", field, 3).before(b + 1).inputFiles()
        assert len(files) <= 2 * 3 * 4           # runs of 1, 3 and 9 batches, two of each at most
    got = {}
    for r in spark.read.parquet(f"{sink}/rows").collect():
        got.setdefault(r.batch_id, []).append(r.url)
    assert {b: sorted(x) for b, x in got.items()} == {b: x for b, x in want.items() if x}
    kept = KeyStore(spark, f"{sink}/keys", field, 3).before(21)
    assert sorted(r.url for r in kept.collect()) == sorted(seen)
    left = {f for f in os.listdir(f"{sink}/keys") if f.startswith("run-")}
    assert len(left) <= 3 * 3 + 3                # merged runs are deleted


def test_content_on_a_stream_and_state(spark, tmp_path):
    from pagesift.operators.content import extract_content
    from pagesift.sources.tables import read_pages
    from pagesift.streaming.stream import dedup_state, read_page_stream, run_available
    page_files(spark, str(tmp_path), 2)
    found = []
    stream = extract_content(read_page_stream(spark, str(tmp_path), max_files_per_trigger=1)).select("page_id", "title")
    run_available(stream, lambda b, i: found.extend(map(tuple, b.collect())), f"c-{tmp_path.name}-{os.getpid()}")
    assert sorted(found) == sorted(map(tuple, extract_content(read_pages(spark, SF)).select("page_id", "title").collect()))
    for event_time in (None, "ts"):
        seen = []
        stream = read_page_stream(spark, str(tmp_path), max_files_per_trigger=1).select(
            F.pmod("page_id", F.lit(5)).alias("url"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
        run_available(dedup_state(stream, event_time=event_time), lambda b, i: seen.extend(r.url for r in b.collect()),
                      f"d{event_time}-{tmp_path.name}-{os.getpid()}")
        assert sorted(seen) == [0, 1, 2, 3, 4]


def test_totals_settings_and_folder_of_a_run(spark, tmp_path):
    from datetime import datetime

    from pagesift.sinks.writers import write_run
    content = spark.createDataFrame([(i, "u", f"title {i}", datetime(2025, 1, 1), "t" * 60, [], datetime(2026, 1, 1)) for i in range(3)],
                                    "page_id long, url string, title string, publication_date timestamp_ntz, content_text string, "
                                    "embedded_links array<struct<text:string,url:string,context:string>>, extraction_timestamp timestamp_ntz")
    failures = content.limit(0).selectExpr("url", "title error_message", "title error_type", "publication_date timestamp")
    out = write_run(content, failures, str(tmp_path), datetime(2026, 2, 3, 4, 5, 6), "zh", timeout=30, max_retries=3, date_filter="2025-01")
    assert out.endswith("announcements_20260203_040506_zh")
    row = spark.read.json(f"{out}/summary").first()
    assert (row.total_processed, row.successful_extractions) == (3, 1)
    meta = spark.read.json(f"{out}/metadata").first()
    assert (meta.timeout, meta.max_retries, meta.date_filter) == (30, 3, "2025-01")


def test_runs_from_another_folder(tmp_path):
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as E; from pyspark.sql import SparkSession;"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate();"
            f"print('ROWS', E.queries()['page_title'](s, '{SF}').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS " in said.stdout, said.stderr[-1500:]


def test_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "content_text" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_stream_dedup_reads_a_table_of_several_files(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.repartition(3).write.parquet(f"{tmp_path}/many/pages.parquet")
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    found, want = (sorted(map(tuple, catalog.stream_dedup(spark, d).select("url", "page_id", "position", "title").collect()))
                   for d in (f"{tmp_path}/many", SF))
    assert found == want and want
    assert catalog.stream_dedup(spark, f"{tmp_path}/none").collect() == []

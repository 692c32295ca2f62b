import json
import os
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagesift.operators.summary import CATEGORY_RULES, categorize, categorize_by
from pagesift.sinks.report import read_runs, report_lines, write_partition, write_report

RUN = datetime(2026, 1, 1, 8, 30)
LINK = "array<struct<text:string,url:string,context:string>>"
ROWS = [(3, "Third <b>", "http://x/3?a=1&b=2", datetime(2025, 12, 6), "Text\nof \"three\"", [("a", "http://l/1", "ctx & more"), ("b", "http://l/2", "")], RUN),
        (1, "=First", "http://x/1", datetime(2025, 1, 2, 3, 4, 5), "one", [], RUN),
        (2, "Second", "http://x/2", datetime(2025, 6, 7), "two\n", None, RUN),
        (4, "First again", "http://x/1", datetime(2025, 1, 2), "copy", [], RUN)]
BAD = [(9, "http://x/9?<", "no <title>", "ValueError", RUN), (8, "http://x/8", "gone", "PageNotFound", RUN)]


@pytest.fixture(scope="module")
def results(spark):
    content = spark.createDataFrame(ROWS, f"page_id long, title string, url string, publication_date timestamp_ntz, content_text string, embedded_links {LINK}, extraction_timestamp timestamp_ntz")
    failures = spark.createDataFrame(BAD, "page_id long, url string, error_message string, error_type string, timestamp timestamp_ntz")
    return content, failures


def joined(path):
    return "".join(open(f"{path}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(path)) if f.startswith("part-"))


def test_json_parts_are_one_document(spark, results, tmp_path):
    path = write_report(*results, str(tmp_path / "j"), "json", RUN, execution_time=2.25, timeout=30)
    doc = json.loads(joined(path))
    assert [a["title"] for a in doc["announcements"]] == ["=First", "Second", "Third <b>"]
    assert doc["announcements"][2]["embedded_links"][0] == {"text": "a", "url": "http://l/1", "context": "ctx & more"}
    assert doc["announcements"][1] == {"title": "Second", "url": "http://x/2", "publication_date": "2025-06-07T00:00:00", "content_text": "two\n",
                                       "embedded_links": [], "extraction_timestamp": "2026-01-01T08:30:00"}
    assert doc["summary"] == {"total_processed": 6, "successful_extractions": 3, "failed_extractions": 2, "execution_time": 2.25}
    assert doc["metadata"]["configuration"] == {"timeout": 30, "max_retries": None, "date_filter": None}
    assert [f["url"] for f in doc["failed_extractions"]] == ["http://x/8", "http://x/9?<"]
    none = results[1].filter("false")
    doc = json.loads(joined(write_report(results[0].filter("false"), none, str(tmp_path / "e"), "json", RUN)))
    assert doc["announcements"] == [] and "failed_extractions" not in doc
    doc = json.loads(joined(write_report(*results, str(tmp_path / "m"), "json", RUN, include_metadata=False, duplicate_handling="version")))
    assert set(doc) == {"announcements", "summary"} and len(doc["announcements"]) == 4


def test_txt_report_line_by_line(spark, results, tmp_path):
    path = write_report(*results, str(tmp_path / "t"), "txt", RUN, execution_time=1.0)
    text = joined(path)
    head, body = text.split("Announcement 1\n")
    assert head == ("AWS Announcements Scraping Results\n" + "=" * 40 + "\n\nExtraction Date: 2026-01-01 08:30:00\nTotal Processed: 6\n"
                    "Successful Extractions: 3\nFailed Extractions: 2\nExecution Time: 1.00 seconds\nDuplicate Handling: skip\n\n")
    third = body.split("Announcement 3\n")[1]
    assert third == ("-" * 20 + "\nTitle: Third <b>\nURL: http://x/3?a=1&b=2\nPublication Date: 2025-12-06 00:00:00\n"
                     "Extraction Time: 2026-01-01 08:30:00\n\nContent:\nText\nof \"three\"\n\nEmbedded Links (2):\n"
                     "  1. a -> http://l/1\n     Context: ctx & more\n  2. b -> http://l/2\n\n" + "=" * 60 + "\n\n"
                     "Failed Extractions\n" + "=" * 20 + "\n\nURL: http://x/8\nError: gone\nType: PageNotFound\nTime: 2026-01-01 08:30:00\n\n"
                     "URL: http://x/9?<\nError: no <title>\nType: ValueError\nTime: 2026-01-01 08:30:00\n\n")
    lines = report_lines(spark, path).orderBy("line_no").collect()
    assert [r.line for r in lines] == text[:-1].split("\n") and [r.line_no for r in lines] == list(range(1, len(lines) + 1))


def test_numbering_a_report_broadcasts_no_table_of_units_and_reads_no_part_whole(spark, tmp_path):
    from pagesift.operators.ranking import positions
    from pagesift.session import materialize
    units = materialize(spark.range(500).selectExpr("id AS page_id", "1 AS _run"))
    plan = positions(units, ["_run"], "page_id", [], "n")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2
    path, want = str(tmp_path / "parts"), [f"line {i}\r \x85\u2028" if i % 7 else "" for i in range(300)]
    os.mkdir(path)
    for k in range(3):
        with open(f"{path}/part-0000{k}-x.txt", "w", encoding="utf-8", newline="") as f:
            f.writelines(x + "\n" for x in want[100 * k:100 * k + 100])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        lines = report_lines(spark, path)
        assert "Generate" not in lines._jdf.queryExecution().executedPlan().toString()
        assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == list(enumerate(want, 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_html_report_sections(spark, results, tmp_path):
    text = joined(write_report(*results, str(tmp_path / "h"), "html", RUN, execution_time=1.26, max_retries=3, date_filter="2025-12"))
    order = ['class="header"', 'class="summary"', 'class="search-box"', "=First", "Second", "Third &lt;b&gt;", 'class="metadata"',
             "Failed Extractions (2)", "http://x/8", "http://x/9?&lt;", "</html>"]
    places = [text.index(x) for x in order]
    assert places == sorted(places)
    stats = re.findall(r'stat-value">(.*?)</div>\s*<div class="stat-label">(.*?)</div>', text)
    assert stats == [("3", "Successful Extractions"), ("6", "Total Processed"), ("2", "Failed Extractions"), ("1.3s", "Execution Time")]
    meta = re.findall(r'metadata-label">(.*?)</div>\s*<div class="metadata-value">(.*?)</div>', text)
    assert meta == [("Extraction Timestamp", "2026-01-01 08:30:00"), ("Scraper Version", "1.0.0"), ("Output Format", "html"),
                    ("Duplicate Handling", "skip"), ("Max Retries", "3"), ("Date Filter", "2025-12")]
    assert text.count("<div><strong>Time:</strong> 2026-01-01 08:30:00</div>") == 2
    assert '<div class="link-context">ctx &amp; more</div>' in text and text.count("link-context") == 1
    assert text.count("<div") == text.count("</div>")


def test_a_run_replaces_its_own_partition(spark, results, tmp_path):
    path, other = str(tmp_path / "runs"), datetime(2026, 2, 1)
    write_partition(results[0], path, RUN)
    write_partition(results[0], path, other)
    write_partition(results[0], path, other, language="zh")
    write_partition(results[0].filter("page_id < 3"), path, other)
    counts = {(r.run, r.language): r["count"] for r in read_runs(spark, path).groupBy("run", "language").count().collect()}
    assert counts == {("20260101_083000", "en"): 4, ("20260201_000000", "en"): 2, ("20260201_000000", "zh"): 4}
    one = read_runs(spark, path, other, "zh")
    assert one.count() == 4
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*run[^\]]*language", plan)


# -- the table of rules ---------------------------------------------------------------
RULES = "category string, keyword string, priority int"


def test_rule_table_equals_the_case_expression(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules = spark.createDataFrame(CATEGORY_RULES, RULES)
    for most in (1 << 20, 40):                       # one automaton, and several one after the other
        got = categorize_by(docs, rules, "text", most=most).select("doc_id", "category")
        want = docs.select("doc_id", categorize(F.col("text")).alias("category"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rules_nulls_ties_and_empty_keywords(spark):
    docs = spark.createDataFrame([(1, "A Cat and a Dog"), (2, None), (3, ""), (4, "bird")], "id long, text string")
    rules = [("K", "cat", 2), ("D", "dog", 2), ("D", "dog", 7), (None, "bird", 1), ("N", None, 1), ("X", "b", None)]
    got = categorize_by(docs, spark.createDataFrame(rules, RULES))
    assert got.columns == ["id", "text", "category"]
    assert {r.id: r.category for r in got.collect()} == {1: "K", 2: "Other", 3: "Other", 4: "Other"}
    got = categorize_by(docs, spark.createDataFrame(rules + [("E", "", 3)], RULES))
    assert {r.id: r.category for r in got.collect()} == {1: "K", 2: "Other", 3: "E", 4: "E"}
    assert {r.category for r in categorize_by(docs, spark.createDataFrame([], RULES)).collect()} == {"Other"}


def test_cost_does_not_grow_with_the_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")

    def seconds(n):
        rules = spark.range(n).selectExpr("concat('C', id) AS category", "concat('zz', id, 'q') AS keyword", "CAST(id AS INT) AS priority")
        t = time.time()
        assert categorize_by(docs, rules).filter("category = 'Other'").count() == 1000
        return time.time() - t
    seconds(10)
    few = min(seconds(10) for _ in range(2))
    assert min(seconds(10_000) for _ in range(2)) < 2 * few + 3

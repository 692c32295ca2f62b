from datetime import datetime

from pyspark.sql import functions as F

from pagesift.functions.dates import iso_format, long_date, long_datetime, plain_datetime
from pagesift.operators.render import csv_guard, escape_html


def test_fx11_escape_and_guard(spark):
    df = spark.createDataFrame([("<a href=\"x\">'&'</a>",), ("=1+1",), ("@x",), (" =x",), ("",), (None,)], "s string")
    r = df.select(escape_html(F.col("s")).alias("e"), csv_guard(F.col("s")).alias("g")).collect()
    assert r[0].e == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"
    assert [x.g for x in r[1:5]] == ["'=1+1", "'@x", " =x", ""]
    assert r[5].e == "" and "<" not in "".join(x.e for x in r)


def test_fx11_dates(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 2, 3, 4, 5),), (datetime(2025, 1, 2, 3, 4, 5, 500000),),
                                (datetime(2026, 1, 5, 1, 2, 3),)], "d timestamp_ntz")
    r = df.select(iso_format(F.col("d")), long_date(F.col("d")), long_datetime(F.col("d")),
                  plain_datetime(F.col("d"))).collect()
    assert r[0][0] == "2025-01-02T03:04:05" and r[1][0] == "2025-01-02T03:04:05.500000"
    assert tuple(r[2][1:]) == ("January 05, 2026", "January 05, 2026 at 01:02:03", "2026-01-05 01:02:03")

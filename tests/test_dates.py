from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagesift.functions.dates import dates_in_text, parse_date_string, parse_month
from pagesift.operators.filters import month_filter, month_filter_loose

FX7 = [("2025-1-5", datetime(2025, 1, 5)), ("2025-12-06T01:02:03Z", datetime(2025, 12, 6, 1, 2, 3)),
       ("2025-12-06T01:02:03.5Z", datetime(2025, 12, 6, 1, 2, 3, 500000)),
       ("2025-12-06T00:00:00.000+08:00", None), ("1/2/2025", datetime(2025, 1, 2)),
       ("1-2-2025", datetime(2025, 1, 2)), ("december  5, 2025", datetime(2025, 12, 5)),
       ("DEC 05, 2025", datetime(2025, 12, 5)), ("5 May 2025", datetime(2025, 5, 5)),
       ("2025-02-30", None), ("", None), ("x", None)]


def test_fx7_date_strings(spark):
    df = spark.createDataFrame([(s,) for s, _ in FX7], "s string")
    got = dict(df.select("s", parse_date_string(F.col("s")).alias("d")).collect())
    assert got == dict(FX7)


def test_fx8_dates_in_text(spark):
    rows = [("on 13/45/2025 then 01/02/2025 and 2024-99-99", datetime(2025, 1, 2)),
            ("01/02/2025 ... 2024-03-04", datetime(2024, 3, 4)), ("05-06-2025", datetime(2025, 5, 6)),
            ("December 5, 2025", None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert dict(df.select("t", dates_in_text(F.col("t")).alias("d")).collect()) == dict(rows)
    named = df.filter(F.col("t").startswith("Dec")).select(dates_in_text(F.col("t"), month_names=True)).first()[0]
    assert named == datetime(2025, 12, 5)


def test_fx14_month_filter(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 1),), (datetime(2026, 1, 31, 23, 59, 59, 999999),),
                                (datetime(2026, 2, 1),), (None,)], "d timestamp_ntz")
    assert month_filter(df, "d", "2026-01").count() == 2
    assert month_filter(df, "d", None).count() == 4
    for bad in ["2026-13", "1999-01", "2026-1", "2026-01-05", "2026-01\n"]:
        with pytest.raises(ValueError):
            parse_month(bad)
        assert month_filter(df, "d", bad, on_invalid="pass").count() == 4
    assert parse_month("2026-12") == (2026, 12)


def test_month_forms():
    assert parse_month("1999-01", year_bounds=False) == (1999, 1)
    assert parse_month("") is None
    with pytest.raises(ValueError):
        parse_month("", required=True)


def test_loose_month_filter(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 5),), (datetime(2024, 2, 5),), (None,)], "d timestamp_ntz")
    for month, rows in [("2024-1", 1), ("2024-13", 0), ("1999-01", 0), ("2024-02", 1), ("2024", 3), ("a-b", 3), ("2024-1-5", 3),
                        ("", 3), (None, 3), ("0-1", 0)]:
        assert month_filter_loose(df, "d", month).count() == rows, month


def test_month_bounds_pushed_to_parquet(spark):
    from conftest import SF
    from pagesift.plans import catalog
    plan = catalog.month_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_forms_against_strptime(spark):
    import random
    formats = ["%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%fZ", "%m/%d/%Y", "%m-%d-%Y",
               "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y"]
    rng = random.Random(0)

    def by_strptime(s):
        for f in formats:
            try:
                return datetime.strptime(s, f)
            except ValueError:
                pass
        return None
    names = ["January", "feb", "MAY", "Sept", "september", "Dec", "Marc", "jun"]
    texts = set()
    for _ in range(1500):
        y, m, d = rng.choice([0, 1, 999, 1999, 2024]), rng.randrange(0, 14), rng.randrange(0, 33)
        h, n, x = rng.randrange(0, 26), rng.randrange(0, 62), rng.randrange(0, 60)
        texts.add(rng.choice([
            f"{y:04}-{m}-{d}", f"{y:04}-{m:02}-{d:02}T{h}:{n:02}:{x:02}", f"{y:04}-{m:02}-{d:02}T{h:02}:{n:02}:{x}Z",
            f"{y:04}-{m:02}-{d:02}T{h:02}:{n:02}:{x:02}.{rng.randrange(0, 10 ** 7)}Z", f"{m}/{d:02}/{y:04}", f"{m:02}-{d}-{y:04}",
            f"{rng.choice(names)} {d}, {y:04}", f"{d} {rng.choice(names)} {y:04}", f"{y}-{m}", f"{y:04}-{m:02}-{d:02}Z",
            f"{y:04}-{m:02}-{d:02}T{h:02}:{n:02}:{x:02}+08:00", f"{rng.choice(names)} {d} {y:04}"]))
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "t string")
    for r in df.select("t", parse_date_string(F.col("t")).alias("d")).collect():
        assert r.d == by_strptime(r.t), r.t

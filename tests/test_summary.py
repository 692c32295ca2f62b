from pyspark.sql import functions as F

from pagesift.operators.filters import search
from pagesift.operators.summary import first_failures, normalize_language, one_decimal, progress_points, run_summary


def items(spark, n, bad):
    return spark.createDataFrame([("r", i, i not in bad) for i in range(1, n + 1)], "run_id string, ordinal long, ok boolean")


def test_fx13_progress_and_summary(spark):
    df = items(spark, 12, {3, 11})
    pts = [tuple(r) for r in progress_points(df).orderBy("item").collect()]
    assert pts == [("r", 10, 12, 83.3, 9, 1), ("r", 12, 12, 100.0, 10, 2)]
    s = run_summary(df).first()
    assert (s.success_rate, s.status) == (83.3, "partial")
    empty = spark.createDataFrame([("r", 1, True)], "run_id string, ordinal long, ok boolean").filter("false")
    assert run_summary(empty).count() == 0


def test_fx13_status_rate_and_first_failures(spark):
    df = items(spark, 6, set(range(1, 7)))
    s = run_summary(df).first()
    assert (s.success_rate, s.status) == (0.0, "failed")
    ff = first_failures(df.filter(~F.col("ok")).withColumn("url", F.col("ordinal").cast("string")))
    rows = ff.orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and rows[0].more == 1


def test_fx15_search(spark):
    df = spark.createDataFrame([("New S3 class", "text"), ("Other", "about s3"), ("None", "x")],
                               "title string, content_text string")
    assert [r.title for r in search(df, " S3 ").collect()] == ["New S3 class", "Other"]
    assert search(df, "").count() == 3
    assert [r.title for r in search(df, "class text").collect()] == ["New S3 class"]


def test_one_decimal_prints_like_the_exact_value(spark):
    pairs = [(k, n) for n in (1, 3, 7, 8, 16, 80, 400, 1000, 2000) for k in range(0, n + 1, max(1, n // 97))]
    df = spark.createDataFrame(pairs, "k long, n long").withColumn("x", F.col("k") * 100.0 / F.col("n"))
    for r in df.withColumn("r", one_decimal(F.col("x"))).collect():
        assert r.r == float(f"{r.k * 100.0 / r.n:.1f}"), (r.k, r.n)


def test_language_is_compared_exactly(spark):
    df = spark.createDataFrame([("zh",), ("chinese",), ("ZH",), (None,)], "lang string")
    assert [r[0] for r in df.select(normalize_language(F.col("lang"))).collect()] == ["zh", "zh", "en", "en"]


def test_language_share_character_by_character(spark):
    import random

    from pagesift.operators.summary import cjk_ratio
    rng = random.Random(2)
    texts = [None, "", "  ", "a b", "中", "　", "　中a", "\U00020000中", "ü ß"]
    texts += ["".join(rng.choice("a b\n　中文ü\U00020000一鿿ꀀ\x1c") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", cjk_ratio(F.col("text")).alias("x"))
    for r in df.collect():
        solid = [c for c in texts[r.i] or "" if not c.isspace()]
        assert r.x == (sum("一" <= c <= "鿿" for c in solid) / len(solid) if solid else 0.0)
    # one replacement for each run of other characters, not for each character
    assert "9FFF}]++" in df._jdf.queryExecution().toString()

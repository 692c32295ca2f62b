import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagesift.operators.dedup import dedup_batches, first_per_key, first_rows, handle_duplicates, winners
from pagesift.operators.ranking import positions

ROWS = [(1, 1, "u", "A"), (1, 2, "v", "B"), (2, 1, "u", "C"), (3, 1, "u", "D")]


def df_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, position long, url string, title string")


def titles(df):
    return [r.title for r in df.orderBy("page_id", "position").collect()]


def test_fx10_strategies(spark):
    df = df_of(spark, ROWS)
    assert titles(handle_duplicates(df, "skip")) == ["A", "B"]
    assert titles(handle_duplicates(df, "overwrite")) == ["A", "B", "C", "D"]
    assert titles(handle_duplicates(df, "version")) == ["A", "B", "C (v2)", "D (v3)"]
    second = df_of(spark, [(9, 1, "v", "E"), (9, 2, "w", "F")])
    assert titles(handle_duplicates(second, "skip", seen=df)) == ["F"]
    with pytest.raises(ValueError):
        handle_duplicates(df, "other")


def test_batches_equal_sequential_skip(spark):
    df = df_of(spark, ROWS + [(4, 1, "w", "E")]).withColumn("batch", F.when(F.col("page_id") <= 2, 1).otherwise(2))
    assert titles(dedup_batches(df, "batch")) == ["A", "B", "E"]


def test_positions_equal_row_number_under_skew(spark):
    # one hot key with most rows, several units, small bucket width
    rows = [(("hot" if i % 5 else f"k{i % 7}"), i // 3, i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, unit long, pos long")
    got = positions(df, ["key"], "unit", ["pos"], width=8)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("unit", "pos")))
    assert sorted(map(tuple, got.select("key", "unit", "pos", "rn").collect())) == \
        sorted(map(tuple, want.select("key", "unit", "pos", "rn").collect()))


def test_skip_is_partitioning_independent(spark):
    df = df_of(spark, ROWS * 3)
    a = sorted(map(tuple, handle_duplicates(df.repartition(1), "skip").collect()))
    b = sorted(map(tuple, handle_duplicates(df.repartition(7), "skip").collect()))
    assert a == b and len({r[0] for r in a}) == len(a)


def test_skip_plan_combines_map_side(spark):
    from conftest import SF
    from pagesift.plans import catalog
    plan = catalog.dedup_skip(spark, SF)._jdf.queryExecution().executedPlan().toString()
    # a partial aggregate below the shuffle: a hot URL is one row per task before it
    assert plan.count("HashAggregate") + plan.count("ObjectHashAggregate") + plan.count("SortAggregate") >= 2
    assert "partial_min" in plan


def test_late_rows_equal_the_rows_of_one_aggregate(spark):
    import random
    rng = random.Random(3)
    some = lambda *x: rng.choice([None, *x])
    rows = [(some(1, 2, 3, -4), some(1, 2), "hub" if i % 3 else some("u", "v", "w", ""), some("A", "B", "C")) for i in range(400)]
    df = df_of(spark, rows + [(-2 ** 63, 2 ** 63 - 1, "edge", "x"), (2 ** 63 - 1, -2 ** 63, "edge", "y")])
    for order in (["page_id", "position"], ["position"], ["position", "page_id"]):
        want = first_per_key(df, "url", order)
        got = first_rows(df.repartition(5), "url", order)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    asked = df_of(spark, [(0, 0, "hub", ""), (0, 0, "none", "")]).select("url")
    assert [r.url for r in first_rows(df, "url", ["page_id", "position"], asked).collect()] == ["hub"]
    assert first_rows(df.limit(0), "url", ["page_id"]).collect() == []
    assert titles(handle_duplicates(df_of(spark, ROWS * 2), "skip", late=True)) == ["A", "B"]
    with pytest.raises(ValueError):
        first_rows(df, "url", ["title"])


def test_late_rows_are_settled_on_narrow_columns(spark):
    from conftest import SF
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    plan = winners(pages, "url", ["page_id"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "html" not in plan
    plan = first_rows(pages, "url", ["page_id"])._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan

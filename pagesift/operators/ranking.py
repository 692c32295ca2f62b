"""Skew-safe positions within a group (the building block of D3 and A3).

``row_number() over (partition by key order by o)`` sends every row of a key
to one task; one URL or one run holding a third of all rows would then be a
third of the job on one core.  Here the position is a two-level prefix sum:

1. rows are first counted per ``(key, sub)`` where ``sub`` is a coarse,
   bounded unit of the order (a page, a file) - partial aggregation shrinks
   a hot key to one row per unit before anything is shuffled;
2. units are cut into buckets of ``width`` consecutive unit ids; bucket
   totals give each bucket's offset (a window over at most
   ``n_units / width`` rows per key), the units inside a bucket get their
   running sums (a window over at most ``width`` rows);
3. the position of a row = offset of its unit + its rank inside the unit
   (a window partitioned by ``(key, sub)``, bounded by one unit's rows).

Every window therefore sees a bounded group whatever the key distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 16


def unit_offsets(df: DataFrame, key: list[str], unit: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``(key..., unit, n, offset)``: rows per unit and rows of the same key in
    earlier units (``unit`` is an integer order)."""
    counts = df.groupBy(*key, unit).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_bucket", F.floor(F.col(unit) / F.lit(width)))
    buckets = counts.groupBy(*key, "_bucket").agg(F.sum("n").alias("_bn"))
    wb = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_boff", F.coalesce(F.sum("_bn").over(wb), F.lit(0)))
    wu = Window.partitionBy(*key, "_bucket").orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_uoff", F.coalesce(F.sum("n").over(wu), F.lit(0)))
    return (counts.join(buckets.select(*key, "_bucket", "_boff").hint("merge"), [*key, "_bucket"])
            .select(*key, unit, "n", (F.col("_boff") + F.col("_uoff")).alias("offset")))


def positions(df: DataFrame, key: list[str], unit: str, within: list[str],
              name: str = "rn", width: int = DEFAULT_WIDTH) -> DataFrame:
    """Adds ``name`` = 1-based position of each row among the rows of its key,
    ordered by ``(unit, *within)``; equals ``row_number()`` over that order.

    Both joins are sort-merge joins on keys that their inputs are dealt by
    already: there are up to as many units as rows, and the estimates of a
    checkpoint's size are no reason to broadcast them.

    The input is read twice, for the unit counts (two narrow columns, combined
    before the shuffle) and for the rows: an expensive input (page extraction)
    should be materialized first."""
    offs = unit_offsets(df, key, unit, width)
    w = Window.partitionBy(*key, unit).orderBy(*(within or [unit]))
    local = df.withColumn("_local", F.row_number().over(w))
    return (local.join(offs.select(*key, unit, "offset").hint("merge"), [*key, unit])
            .withColumn(name, (F.col("offset") + F.col("_local")).cast("bigint"))
            .drop("offset", "_local"))

"""Ranks of a column's values without sorting the column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Different values that a range is to hold, and the most ranges: their bounds are kept in the driver.
RANGE_VALUES, MOST_RANGES = 1_000_000, 512


def ranked(rows: DataFrame, value: Column, range_values: int = RANGE_VALUES) -> DataFrame:
    """v, c (copies), first, last (ranks of the first and last copy, from 1) and n (all rows) for each different value that is not null.

    Equal values are one row with their number. Quantiles of the different values cut them into ranges of about equal
    numbers, whatever their spread; ranges are sorted apart, and each one's ranks begin after the sum of those before.
    """
    values = rows.select(value.alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("c"))
    parts = min(MOST_RANGES, -(-values.count() // range_values))
    bounds = []
    if parts > 1:
        cuts = values.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 20 * MOST_RANGES)).first()[0]
        bounds = sorted(set(cuts))
    parted = values.withColumn("part", _range(F.col("v"), bounds))
    sums = parted.groupBy("part").agg(F.sum("c").alias("s"))  # a row for each range
    along = Window.orderBy("part")
    before = sums.select("part", (F.sum("s").over(along) - F.col("s")).alias("start"), F.sum("s").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    up = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("start") + F.sum("c").over(up)
    return parted.join(F.broadcast(before), "part").withColumn("last", last).select("v", "c", (F.col("last") - F.col("c") + 1).alias("first"), "last", "n")


def _range(v: Column, bounds: list) -> Column:
    """How many of the sorted bounds are less than v: a binary search as nested conditions."""
    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v <= F.lit(bounds[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))

    return within(0, len(bounds))

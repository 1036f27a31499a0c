"""Prefix sums over tables that grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring keys that one task sums up on each level.
WIDTH = 1024


def sums_before(sizes: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """sizes with `name`: the sum of n over all rows with a smaller key.

    key: distinct longs. Keys are summed up in three levels, so the one task that sees the whole order has one row for each
    WIDTH * WIDTH stretch of keys.
    """
    # Dealt once by stretches: the sums of stretches and the sums within them read the same shuffle. Left joins, since an inner
    # one would filter its sides, and shuffles with other filters below are other shuffles.
    cut = sizes.withColumns({"_near": F.floor(F.col(key) / WIDTH), "_far": F.floor(F.floor(F.col(key) / WIDTH) / WIDTH)}).repartition("_near")
    first = cut.groupBy("_near", "_far").agg(F.sum(n).alias("_sum")).repartition("_far")
    second = first.groupBy("_far").agg(F.sum("_sum").alias("_total"))
    top = second.select("_far", (F.sum("_total").over(Window.orderBy("_far")) - F.col("_total")).alias("_top"))
    middle = first.withColumn("_middle", F.sum("_sum").over(Window.partitionBy("_far").orderBy("_near")) - F.col("_sum"))
    middle = middle.join(top, "_far", "left").select("_near", (F.col("_middle") + F.col("_top")).alias("_base"))
    within = F.sum(n).over(Window.partitionBy("_near").orderBy(key)) - F.col(n)
    return cut.withColumn("_within", within).join(middle, "_near", "left").withColumn(name, (F.col("_within") + F.col("_base")).cast("long")).select(*sizes.columns, name)


def ranges_hold(points: DataFrame, at: str, ranges: DataFrame, width: int = 1 << 20, how: str = "inner") -> DataFrame:
    """points joined to the range (lo <= at < hi) that holds them: an equi-join on stretches of `width`, then the bounds.

    ranges: disjoint, with columns lo and hi; one has a row for each stretch that it touches.
    """
    spread = ranges.where("hi > lo").withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    cut = points.withColumn("_a", F.floor(F.col(at) / width))
    return cut.join(spread, (F.col("_a") == F.col("_b")) & (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi")), how).drop("_a", "_b", "lo", "hi")

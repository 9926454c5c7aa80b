"""Exact medians that no single task has to sort all values for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4_096


def median_by(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n and median of each group (nulls don't count).

    Values are counted in BUCKETS ranges between a group's ends; the one or two middle values lie in one or two ranges, and only
    the distinct values of those are put in order.
    """
    x = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = x.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    key = list(by) or ["_all"]
    if not by:
        x, ends = x.withColumn("_all", F.lit(0)), ends.withColumn("_all", F.lit(0))
    width = (F.col("_hi") - F.col("_lo")) / BUCKETS
    placed = x.join(F.broadcast(ends) if not by else ends, key).withColumn("_b", F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(BUCKETS - 1))).otherwise(0))
    order = Window.partitionBy(*key).orderBy("_b")
    sums = placed.groupBy(*key, "_b", "n").agg(F.count("*").alias("_k")).withColumn("_upto", F.sum("_k").over(order))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1  # ranks of the middle values
    middle = sums.where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_k") < high)).select(*key, "_b", (F.col("_upto") - F.col("_k")).alias("_before"))
    values = placed.join(middle, [*key, "_b"]).groupBy(*key, "_b", "_before", "n", "_v").agg(F.count("*").alias("_k"))
    inner = Window.partitionBy(*key, "_b").orderBy("_v")
    values = values.withColumn("_upto", F.col("_before") + F.sum("_k").over(inner)).where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_k") < high))
    return values.groupBy(*key, "n").agg(((F.min("_v") + F.max("_v")) / 2).alias("median")).select(*by, "n", "median")

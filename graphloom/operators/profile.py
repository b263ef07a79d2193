"""Length profiles, distributions and extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def length_profile(rows: DataFrame, by: list[str], value: str, cutoff: int) -> DataFrame:
    """Count, extremes, mean, percentiles (interpolated) and what lies over a cutoff."""
    over = F.count_if(F.col(value) > cutoff)
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"),
        F.percentile(value, 0.9).alias("p90"), F.percentile(value, 0.95).alias("p95"), F.percentile(value, 0.99).alias("p99"),
        F.max(value).alias("most"), over.alias("over"), (100 * over / F.count(value)).alias("over_pct"),
    )


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at n // 2 of the sorted values, and extremes and mean.

    Values are counted first, so a group travels as its distinct values, not as its rows.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(*by)
    df = c.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = F.floor(F.col("n") / 2) + 1
    return df.groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.min(F.when(F.col("upto") >= at, F.col(value))).alias("p50"), F.max(value).alias("most"), (F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("mean"))


def histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def shares(rows: DataFrame, within: str, key: str) -> DataFrame:
    """How often each key stands within a group, and its share of the group."""
    n = rows.groupBy(within, key).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(within)))


def longest(rows: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """The row with the largest value of each group; of equals the smallest key."""
    best = rows.groupBy(by).agg(F.max(F.struct(F.col(value), (-F.col(key)).alias("k"))).alias("b"))
    return best.select(by, F.col(f"b.{value}").alias(value), (-F.col("b.k")).alias(key))


def budget(rows: DataFrame, by: str, value: str, extra: int, multiple: int) -> DataFrame:
    """The most of any group, with room for extra, rounded up to a multiple."""
    per = rows.groupBy(by).agg(F.max(value).alias("most"))
    top = per.agg(F.max("most").alias("longest"))
    return top.select("longest", (F.ceil((F.col("longest") + extra) / multiple) * multiple).cast("long").alias("budget"))

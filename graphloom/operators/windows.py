"""Runs, gaps and offsets over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Contiguous runs of one value: (by, run, value, first, last, n)."""
    w = W.partitionBy(*by).orderBy(order)
    fresh = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    df = rows.withColumn("fresh_", fresh).withColumn("run", F.sum("fresh_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return df.groupBy(*by, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def islands(rows: DataFrame, by: str, pos: str) -> DataFrame:
    """Spans of consecutive positions."""
    df = rows.withColumn("island_", F.col(pos) - F.row_number().over(W.partitionBy(by).orderBy(pos)))
    return df.groupBy(by, "island_").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n")).drop("island_")


def offsets(rows: DataFrame, by: str, order: list[str], size: str) -> DataFrame:
    """Where each row's part begins when the parts of a group are laid end to end."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def shifted(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Each row with the next row's value: what a causal model is to predict there."""
    return rows.withColumn("target", F.lead(value).over(W.partitionBy(by).orderBy(*order)))


def first_of_sets(tokens, yes: list[int], no: list[int], p_yes, p_no):
    """P(yes) at the first token that is in either set: y / (y + n), null without one or without mass."""
    both = F.array(*[F.lit(x) for x in yes + no])
    at = F.array_min(F.filter(F.transform(tokens, lambda x, i: F.when(F.array_contains(both, x), i)), lambda i: i.isNotNull()))
    y, n = F.get(p_yes, at), F.get(p_no, at)
    return F.when(y + n > 0, y / (y + n))


def turn_problems(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Of each conversation: turns, whether a system turn comes late, roles that do not alternate, and whether it is well formed.

    An optional system turn leads; then user (or tool) and assistant turns alternate and end evenly.
    """
    w = W.partitionBy(conv).orderBy(turn)
    side = F.when(F.col(role).isin("user", "tool"), 0).when(F.col(role) == "assistant", 1)
    df = turns.withColumn("rn", F.row_number().over(w)).withColumn("side", side).withColumn("last_side", F.lag(side).over(w)).withColumn("last_role", F.lag(role).over(w))
    bad = F.when(F.col("last_role").isNull() | (F.col("last_role") == "system"), F.col("side") != 0).otherwise(F.col("side") == F.col("last_side"))
    per = df.groupBy(conv).agg(
        F.count("*").alias("turns"), F.count_if((F.col(role) == "system") & (F.col("rn") > 1)).alias("late_system"),
        F.count_if((F.col(role) != "system") & bad).alias("not_alternating"), F.count_if(F.col(role) != "system").alias("spoken"),
    )
    return per.select(conv, "turns", "late_system", "not_alternating", ((F.col("late_system") == 0) & (F.col("not_alternating") == 0) & (F.col("spoken") % 2 == 0) & (F.col("spoken") > 0)).alias("well_formed"))

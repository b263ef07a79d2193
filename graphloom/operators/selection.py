"""Audited joins and pooled counts of selection data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grouped_pairs(left: DataFrame, right: DataFrame, group: str, left_key: str, right_key: str, sums: list[Column], place: str = "i") -> DataFrame:
    """(group, units, first, *sums, contiguous, agrees) of rows joined by their numbers from 0.

    contiguous: the group's rows stand together; agrees: every row has its partner, with the same key. Rows of the right that have
    no partner make a group of their own, null, which does not agree.
    """
    both = left.join(right.select(place, *[c for c in right.columns if c != place and c not in left.columns]), place, "full")
    same = F.bool_and(F.col(left_key).eqNullSafe(F.col(right_key)))
    # Rows of a group come together before they are summed: a task then holds an entry for each group, not for nearly each row.
    per = both.repartition(group).groupBy(group).agg(F.count("*").alias("units"), F.min(place).alias("first"), F.max(place).alias("last"), *sums, same.alias("agrees"))
    return per.withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("units")).drop("last")


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with state: equal, differs (found with other values) or unknown (not found)."""
    other = known.select(*keys, F.struct(*values).alias("known_"))
    same = F.col("known_").eqNullSafe(F.struct(*values))
    state = F.when(F.col("known_").isNull(), "unknown").when(same, "equal").otherwise("differs")
    return rows.join(other, keys, "left").withColumn("state", state).drop("known_")


def reconciled(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """counts (source, n, ...), which fail at run time where their sums differ from a manifest's (source, rows)."""
    sums = counts.groupBy("source").agg(F.sum("n").alias("n_")).join(manifest.select("source", "rows"), "source", "full")
    bad = sums.where(~F.col("n_").eqNullSafe(F.col("rows"))).agg(F.count("*").alias("bad_"))
    return counts.crossJoin(F.broadcast(bad)).where((F.col("bad_") == 0) | F.raise_error(F.lit("counts and manifests differ")).cast("boolean")).drop("bad_")


def pooled_priors(counts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(label, unit_type, n, share within the label) over all sources; larger sources weigh more."""
    n = reconciled(counts, manifest).groupBy("label", "unit_type").agg(F.sum("n").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("label")))

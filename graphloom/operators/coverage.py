"""Whether two tables cover the same units of each group, by bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import number


def compare(left: DataFrame, right: DataFrame, group: str, unit: str) -> DataFrame:
    """(group, n_left, n_right, missing, extra, equal): distinct units on either side, those that only the left or only the right has, and whether there are none.

    Units are numbered, and each side sets a bit for each; bits are gathered in bitmaps of 32,768 units before the shuffle, so
    what travels and what a group needs is 4 KB for each such stretch of numbers, whatever the number of rows. Null units are not looked at; a null group is one like others.
    """
    pairs = [df.select(F.col(group).alias("g"), F.col(unit).alias("u")).where("u is not null") for df in (left, right)]
    # Units are numbered group by group, so that a group's bits lie close.
    numbers = number(pairs[0].union(pairs[1]).distinct().select(F.struct("g", "u").alias("key")), ["key"], "no")

    def bits(df: DataFrame, side: str) -> DataFrame:
        placed = df.select(F.struct("g", "u").alias("key")).join(numbers, "key").select(F.col("key.g").alias("g"), (F.col("no") + 1).alias("no"))
        return placed.groupBy("g", F.bitmap_bucket_number("no").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("bits")).withColumn("side", F.lit(side))

    both = bits(pairs[0], "left").unionByName(bits(pairs[1], "right"))
    count = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.bitmap_count("bits"))), F.lit(0))
    per = both.groupBy("g", "bucket").agg(count("left").alias("l"), count("right").alias("r"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("either"))
    out = per.groupBy("g").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.col("either") - F.col("r")).alias("missing"), F.sum(F.col("either") - F.col("l")).alias("extra"))
    return out.select(F.col("g").alias(group), "n_left", "n_right", "missing", "extra", ((F.col("missing") == 0) & (F.col("extra") == 0)).alias("equal"))


def require_equal(left: DataFrame, right: DataFrame, group: str, unit: str) -> DataFrame:
    """compare(), which fails at run time for a group that is not covered alike."""
    checked = compare(left, right, group, unit)
    message = F.concat(F.lit("coverage differs in "), F.coalesce(F.col(group).cast("string"), F.lit("null")))
    return checked.where(F.col("equal") | F.raise_error(message).cast("boolean"))

"""Greedy covering choices as a loop would make them, in distributed rounds.

A loop in which takers pick one after the other, each the best of what is not taken yet, has one outcome: the stable one of takers
that prefer as they pick and picked things that prefer the earlier taker. So the rounds need no order of
their own: each taker without a hold asks for the best thing that no earlier taker holds, each thing goes to the earliest
that asks, and who is displaced asks again. What an earlier taker holds leaves the table for all later ones at
once. The outcome does not depend on partitions, and no group is ever in one task: rounds are minima, summed before the
shuffle, and joins to the table of holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import staging
from .sampling import draw


def settle(edges: DataFrame, max_rounds: int = 1000, kept: bool = False) -> DataFrame:
    """(taker, thing) for every taker that gets something.

    edges: taker, turn (smaller: earlier; one for each taker), thing, wish (smaller: better; among a taker's rows no two alike). Any types
    that have an order. kept: edges are a table of staging.kept(), which is read as it is and stays. Equals the loop over takers by turn in which each takes the thing of its smallest wish that is not taken yet.
    """
    left = edges if kept else staging.kept(edges.select("taker", "turn", "thing", "wish"), "edges")
    holds = staging.kept(left.limit(0).select("thing", "taker", "turn"), "holds")
    for i in range(max_rounds):
        idle = left.join(holds.select("taker"), "taker", "left_anti")
        asks = idle.groupBy("taker").agg(F.min(F.struct("wish", "thing", "turn")).alias("b")).select("b.thing", "taker", "b.turn")
        after = holds.select("thing", "taker", "turn").unionByName(asks).groupBy("thing").agg(F.min(F.struct("turn", "taker")).alias("h"), F.count("*").alias("n"))
        now = staging.kept(after.select("thing", "h.taker", "h.turn", "n"), "holds")
        if now.agg(F.sum("n")).first()[0] == (before := holds.count()) or (before == 0 and now.limit(1).count() == 0):
            return now.select("taker", "thing")
        rest = left.join(now.select("thing", F.col("turn").alias("held")), "thing", "left").where("held is null or turn < held").drop("held")
        rest = staging.kept(rest, "edges")
        if i or not kept:
            staging.forget(left)
        staging.forget(holds)
        left, holds = rest, now
    raise RuntimeError(f"choices did not settle in {max_rounds} rounds")


def _drawn(seed: int, *keys: str) -> Column:
    """draw() as 16 bytes in place of 32 signs, in the same order."""
    return F.unhex(draw(seed, *keys))


def _whole(columns: list[str]) -> Column:
    return F.struct(*columns)


def frequencies(rows: DataFrame, example: list[str], unit: list[str]) -> DataFrame:
    """rows' distinct (example, unit) with f: how many examples have the unit."""
    distinct = rows.select(*example, *unit).distinct()
    return distinct.join(distinct.groupBy(*unit).agg(F.count("*").alias("f")), unit)


def choose(rows: DataFrame, example: list[str], unit: list[str], seed: int, turn: Column | None = None) -> DataFrame:
    """(example, unit, first): one unit for every example.

    Examples choose in the order of turn (else at random by seed; then by their columns). Each takes a unit that none before it took, where it has
    one, else one of all its units; the rarest of them, ties at random by seed. first: whether none before it took the unit. Nulls are values
    like others; repeated rows count once; no rows give none.
    """
    # A turn of random order follows from the example, so it is made after rows have moved.
    own = frequencies(rows, example, unit) if turn is None else frequencies(rows.withColumn("turn_", turn), [*example, "turn_"], unit)
    turn = F.struct((_drawn(seed, *example) if turn is None else F.col("turn_")).alias("t"), *[F.col(c).alias(f"e{i}") for i, c in enumerate(example)])
    edges = own.select(_whole(example).alias("taker"), turn.alias("turn"), _whole(unit).alias("thing"), F.struct("f", _drawn(seed, *example, *unit).alias("d"), *unit).alias("wish"))
    edges = staging.kept(edges, "choices")
    got = settle(edges, kept=True).withColumn("first", F.lit(True))
    best = edges.groupBy("taker").agg(F.min(F.struct("wish", "thing")).alias("b")).select("taker", F.col("b.thing").alias("any_"))
    out = best.join(got, "taker", "left").select("taker", F.coalesce("thing", "any_").alias("thing"), F.coalesce("first", F.lit(False)).alias("first"))
    return out.select("taker.*", "thing.*", "first")


def cover(rows: DataFrame, example: list[str], unit: list[str], seed: int) -> DataFrame:
    """(example, unit): an example of its own for each unit, as far as examples go.

    Units choose in the order of frequency, rarest first (then by their columns), each at random by seed among its examples that no unit
    before it took. A unit that finds none is left out: see uncovered().
    """
    own = frequencies(rows, example, unit)
    edges = own.select(_whole(unit).alias("taker"), F.struct("f", *unit).alias("turn"), _whole(example).alias("thing"), F.struct(_drawn(seed, *example, *unit).alias("d"), *example).alias("wish"))
    return settle(edges).select("thing.*", "taker.*")


def uncovered(rows: DataFrame, chosen: DataFrame, unit: list[str]) -> DataFrame:
    """Units of rows that chosen lacks."""
    keys = [F.struct(*unit).alias("u_")]
    return rows.select(*unit, *keys).distinct().join(chosen.select(*keys).distinct(), "u_", "left_anti").drop("u_")


def contrast_cover(rows: DataFrame, group: str, example: str, unit: str, label: str, pairs_per_group: int, seed: int) -> DataFrame:
    """(group, example, positive, negative): pairs of one positive and one negative unit of an example that has both.

    First every positive unit of a group gets an example of its own, rarest first; then random other examples follow until the group has
    pairs_per_group pairs, if there are so many. A group with more positive units than pairs keeps a pair for each. Examples then choose their negatives one after the other,
    covering ones first, then the rarest. Examples are told apart by group and example.
    """
    key, both = [group, example], rows.groupBy(group, example).agg(F.bool_or(F.col(label) == 1).alias("p"), F.bool_or(F.col(label) == 0).alias("n"))
    fit = staging.kept(rows.join(both.where("p and n").select(*key), key, "left_semi").select(group, example, unit, label), "fit")
    positive, negative = fit.where(F.col(label) == 1).select(*key, unit), fit.where(F.col(label) == 0).select(*key, unit)
    anchors = staging.kept(cover(positive.withColumn("g_", F.col(group)), key, ["g_", unit], seed).drop("g_"), "anchors")
    n = anchors.groupBy(group).agg(F.count("*").alias("n_"))
    others = positive.select(*key).distinct().join(anchors.select(*key), key, "left_anti").join(n, group, "left")
    order = F.row_number().over(W.partitionBy(group).orderBy(draw(seed, group, example), example))
    more = others.withColumn("r_", order).where(F.col("r_") <= F.lit(pairs_per_group) - F.coalesce("n_", F.lit(0))).select(*key)
    counted = frequencies(positive.withColumn("u_", F.struct(group, unit)), key, ["u_", unit])
    rarest = counted.join(more, key, "left_semi").groupBy(*key).agg(F.min(F.struct("f", draw(seed, *key, unit).alias("d"), unit)).alias("b")).select(*key, F.col(f"b.{unit}").alias("positive"), F.lit(1).alias("late"))
    taken = staging.kept(anchors.select(*key, F.col(unit).alias("positive"), F.lit(0).alias("late")).unionByName(rarest), "taken")
    options = negative.join(taken.select(*key, "late"), key).withColumn("g_", F.col(group))
    turn = F.struct("late", draw(seed + 1, *key).alias("d"))
    chosen = choose(options, key, ["g_", unit], seed, turn).select(*key, F.col(unit).alias("negative"))
    return taken.drop("late").join(chosen, key).select(*key, "positive", "negative")

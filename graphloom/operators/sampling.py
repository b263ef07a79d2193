"""Deterministic sampling, quotas, ranks and interleaving.

Random order is the order of md5 over a seed and a total key, so a draw depends on its own group
alone, and any engine repeats it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import staging


def draw(seed: int, *keys: str | Column) -> Column:
    """A text that orders rows at random but alike everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number from 0 up to 1, of 48 bits of the draw."""
    return F.conv(F.substring(draw(seed, *keys), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    names = [c for c in rows.columns if c not in keys]
    # A minimum of structs is summed before the shuffle; a window would move every row.
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in names if c not in order])).alias("r"))
    return least.select(*keys, *[F.col(f"r.{c}") for c in names if c in order], *[F.col(f"r.{c}") for c in names if c not in order])


def limit_per_group(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group, in order."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def largest_remainder(weights: DataFrame, group: str, key: str, weight: str, total: int) -> DataFrame:
    """total split over the keys of each group in proportion to weight; what is left goes to the largest fractions, ties to the key."""
    g = W.partitionBy(group)
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(g)
    df = weights.withColumn("exact", exact).withColumn("base", F.floor("exact").cast("long"))
    rank = F.row_number().over(g.orderBy((F.col("exact") - F.col("base")).desc(), key))
    left = F.lit(total) - F.sum("base").over(g)
    return df.select(group, key, weight, (F.col("base") + (rank <= left).cast("long")).alias("quota"))


def sample_negatives(rows: DataFrame, example: str, unit: str, label: str, ratio: float, seed: int) -> DataFrame:
    """All positives, and of each example's negatives up to round(positives * ratio), half to even."""
    positives = F.sum(F.col(label)).over(W.partitionBy(example))
    rank = F.row_number().over(W.partitionBy(example, label).orderBy(draw(seed, example, unit), unit))
    df = rows.withColumn("n_pos", positives).withColumn("rank_", rank)
    return df.where((F.col(label) == 1) | (F.col("rank_") <= F.bround(F.col("n_pos") * F.lit(ratio)))).drop("n_pos", "rank_")


def contrast_eligible(rows: DataFrame, example: str, label: str) -> DataFrame:
    """Examples that have both labels, with how many of each."""
    n = rows.groupBy(example).agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    return n.where("n_pos > 0 and n_neg > 0")


def contrast_pairs(rows: DataFrame, example: str, unit: str, label: str, order: list[Column]) -> DataFrame:
    """For each example with both labels its first positive and its first negative, in the given order."""
    one = lambda v: F.min(F.when(F.col(label) == v, F.struct(*order, F.col(unit).alias("u"))))
    both = rows.groupBy(example).agg(one(1).alias("p"), one(0).alias("n"))
    return both.where("p is not null and n is not null").select(example, F.col("p.u").alias("positive"), F.col("n.u").alias("negative"))


def balanced_sample(rows: DataFrame, example: str, key: str, label: str, target: int, seed: int) -> DataFrame:
    """target // 2 negatives, then positives of other examples up to target; one row for each example."""
    one = lambda v: first_per_key(rows.where(F.col(label) == v).withColumn("d", draw(seed, key)), [example], ["d", key])
    # A limit under an order keeps only its rows in every task.
    negative = one(0).orderBy("d", key).limit(target // 2)
    positive = one(1).join(negative.select(example), example, "left_anti").orderBy("d", key).limit(target - target // 2)
    return negative.select(key, example, label).unionByName(positive.select(key, example, label))


def number(rows: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """Rows numbered from 0 in a global order, without one task for all.

    Rows are sorted once, by ranges, and written with a number that holds their range and their place in it; the ranges' sizes, a row for
    each range, say where each begins. order must tell rows apart for the numbers to be the same on every run.
    """
    placed = staging.kept(rows.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), "numbered")
    ranged = placed.withColumn("range_", F.shiftrightunsigned("at_", 33)).withColumn("at_", F.col("at_").bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy("range_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("range_", F.coalesce(before, F.lit(0)).alias("before_"))
    # As many rows as there are ranges.
    return ranged.join(F.broadcast(starts), "range_").select(*rows.columns, (F.col("before_") + F.col("at_")).alias(name))


def at_share(rows: DataFrame, column: str, share: float):
    """The smallest value up to which at least that share of a column's values lie, nulls aside; None without values.

    Values are sorted, not counted in one map, so their number does not matter.
    """
    placed = number(rows.select(column).where(F.col(column).isNotNull()), [column])
    n = placed.count()
    return placed.where(F.col("i") == max(0, math.ceil(n * share) - 1)).first()[0] if n else None


def batches(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Rows of each key numbered into batches of size."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(rn / size).cast("long")).withColumn("slot", (rn % size).cast("long"))


def interleave(selectors: DataFrame, generators: DataFrame, key: str, batch: int) -> DataFrame:
    """Positions of equally many rows of two tasks in alternating blocks of half a batch."""
    h = batch // 2
    place = lambda df, task: df.select(key, F.lit(task).alias("task"), (F.floor(F.col("i") / h) * 2 * h + task * h + F.col("i") % h).cast("long").alias("sort_key"))
    both = place(selectors, 1).unionByName(place(generators, 0))
    return number(both, ["sort_key"], "position").select(key, "task", F.col("position").cast("long").alias("position"))


def interleave_all(selectors: DataFrame, generators: DataFrame, key: str, batch: int, n_selectors: int, n_generators: int) -> DataFrame:
    """Positions of all rows, without replacement: mixed batches while both last, then the surplus.

    selectors and generators are numbered from 0 in column i. More selectors than generators: mixed
    batches of half generators, half selectors, then the rest of each. Otherwise each chunk of
    selectors follows as many generators as fill its batch, and generators are left to the end.
    """
    h, i = batch // 2, F.col("i")
    if n_selectors > n_generators:
        mixed = n_generators // h
        s = F.when(i < mixed * h, F.floor(i / h) * batch + h + i % h).otherwise(mixed * batch + (n_generators - mixed * h) + i - mixed * h)
        g = F.when(i < mixed * h, F.floor(i / h) * batch + i % h).otherwise(mixed * batch + i - mixed * h)
    else:
        chunks = -(-n_selectors // h) if h else 0
        # Chunks but the last have h selectors and take h generators before them.
        last = n_selectors - (chunks - 1) * h if chunks else 0
        fill = [h] * max(0, chunks - 1) + ([batch - last] if chunks else [])
        used = min(n_generators, sum(fill))
        taken = min(h * max(0, chunks - 1), used)
        s = F.when(F.floor(i / h) < chunks - 1, F.floor(i / h) * batch + h + i % h).otherwise(F.lit(used + (chunks - 1) * h) + i % h)
        g = F.when(i < taken, F.floor(i / h) * batch + i % h).when(i < used, i + (chunks - 1) * h).otherwise(i + n_selectors)
    at = lambda df, task, p: df.select(key, F.lit(task).alias("task"), p.cast("long").alias("position"))
    return at(selectors, 1, s).unionByName(at(generators, 0, g))


def drawn_count(rows: DataFrame, key: str, weights: list[tuple[int, float]], seed: int) -> DataFrame:
    """A number for each row by inverse distribution over weighted values."""
    total, at = sum(w for _, w in weights), 0.0
    u = uniform(seed, key) * F.lit(float(total))
    expr = F.lit(weights[-1][0])
    bounds = []
    for value, w in weights:
        at += w
        bounds.append((value, at))
    for value, top in reversed(bounds[:-1]):
        expr = F.when(u < F.lit(float(top)), F.lit(value)).otherwise(expr)
    return rows.select(key, expr.cast("int").alias("drawn"))


def droppable(layout: DataFrame, position: str, paired: str, batch: int) -> DataFrame:
    """(batch): full batches of a layout that hold no row of a contrast pair. layout: positions from 0 without gaps, and whether a row is one of a pair."""
    full = layout.groupBy(F.floor(F.col(position) / batch).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.bool_or(F.coalesce(paired, F.lit(False))).alias("p"))
    return full.where((F.col("n") == batch) & ~F.col("p")).select("batch")


def dropped_batches(batches: int, replicas: int, epoch: int, first: int, count: int) -> set[int]:
    """Numbers of the batches left out in an epoch so that every rank gets as many: a window that moves on by epochs."""
    n = batches % replicas if replicas > 1 else 0
    if n and (first < 0 or first + count > batches or count < n):
        raise ValueError("too few batches may be dropped to give every rank as many")
    return {first + (epoch * n + i) % count for i in range(n)}


def shuffled_blocks(rows: DataFrame, order: str, batch: int, seed: int, replicas: int = 1, epoch: int = 0, first: int = 0, count: int = 0) -> DataFrame:
    """Batches of consecutive rows in random order: (order, batch, slot, position, rank).

    Batches move in blocks: of two where half a batch is odd, so that no pair of neighbouring rows is
    torn apart, else of one; an incomplete block stays last. Of several replicas batches go to each in
    turn, and first and count say which batches may be dropped to even them out. With one replica a
    short last batch follows at the end.
    """
    numbered = number(rows, [order]).withColumn("batch", F.floor(F.col("i") / batch).cast("long"))
    total = rows.count()
    full = total // batch
    gone = dropped_batches(full, replicas, epoch, first, count)
    kept = numbered.where(F.col("batch") < full)
    if gone:
        kept = kept.where(~F.col("batch").isin(*gone))
    place = F.col("batch") - sum(((F.col("batch") > g).cast("long") for g in gone), F.lit(0))
    unit = 2 if batch // 2 % 2 else 1
    left = full - len(gone)
    moved = kept.withColumn("at", place).withColumn("block", F.floor(F.col("at") / unit).cast("long"))
    # One row for each block.
    blocks = moved.where(F.col("block") < left // unit).select("block").distinct().withColumn("d", draw(seed + epoch, "block"))
    ranked = number(blocks, ["d", "block"], "rank_").select("block", "rank_")
    position = F.coalesce(F.col("rank_"), F.col("block")) * unit + F.col("at") % unit
    out = moved.join(ranked, "block", "left").select(order, "batch", (F.col("i") % batch).alias("slot"), position.cast("long").alias("position"))
    if replicas == 1 and total % batch:
        out = out.unionByName(numbered.where(F.col("batch") >= full).select(order, "batch", (F.col("i") % batch).alias("slot"), F.lit(full).cast("long").alias("position")))
    return out.withColumn("rank", F.col("position") % replicas)


def after_progress(rows: DataFrame, order: list[str], key: str, done: DataFrame) -> DataFrame:
    """rows beyond those that have a result; done must hold the keys of the first rows, no others."""
    marked = number(rows, order).join(done.select(key).distinct().withColumn("done_", F.lit(True)), key, "left")
    n = done.select(key).distinct().agg(F.count("*").alias("n_"))
    checked = marked.crossJoin(F.broadcast(n)).where((F.col("done_").isNotNull() == (F.col("i") < F.col("n_"))) | F.raise_error(F.lit("results are not those of the first rows")).cast("boolean"))
    return checked.where(F.col("i") >= F.col("n_")).select(*rows.columns)

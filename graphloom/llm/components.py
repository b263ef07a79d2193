"""Connected components of links that may outgrow one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def connected(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    links: rows of two longs, in any direction, repeats allowed; rows with a null or with a == b
    link nothing. Large-star and small-star rounds in turn: each hangs neighbours on the least node
    known, sums are made before the shuffle, and a node with very many links is split in the join.
    Each round is written to the shared folder. No links: an empty table. Raises when max_rounds
    rounds have not settled (the number of rounds grows with the logarithm of the longest path).
    """
    edges = scratch.keep(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = digest(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        wide = scratch.keep(large, "large")
        down = scratch.keep(wide.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = wide.join(down, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = scratch.keep(small.distinct(), "small")
        seen = digest(after)
        for old in (edges, least, wide, down):
            scratch.drop(old)
        edges = after
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))

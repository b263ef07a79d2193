"""Set operations and joins over the units (nodes and relations) of a property-graph schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_id(label: str | Column) -> Column:
    return F.concat(F.lit("node:"), F.col(label) if isinstance(label, str) else label)


def relation_id(source, type_, target) -> Column:
    return F.concat(F.lit("relation:"), F.concat_ws("|", source, type_, target))


def schema_units(nodes: Column, relations: Column) -> Column:
    """Nodes, then relations, as one array of (id, kind)."""
    return F.concat(
        F.transform(nodes, lambda n: F.struct(node_id(n.label).alias("id"), F.lit("node").alias("kind"))),
        F.transform(relations, lambda r: F.struct(relation_id(r.source, r.type, r.target).alias("id"), F.lit("relation").alias("kind"))),
    )


def close_selection(selected: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """Per key: selected relations bring the nodes at their ends.

    selected: key, kind, unit; relations: unit, source, target. Rows (key, kind, unit, closure): closure
    marks nodes that only a relation brought in.
    """
    chosen = selected.select(key, "kind", "unit").distinct()
    ends = chosen.where("kind = 'relation'").join(relations, "unit").select(key, F.explode(F.array("source", "target")).alias("unit"))
    both = chosen.select(key, "kind", "unit", F.lit(False).alias("closure")).unionByName(ends.select(key, F.lit("node").alias("kind"), "unit", F.lit(True).alias("closure")))
    return both.groupBy(key, "kind", "unit").agg(F.bool_and("closure").alias("closure"))


def complement(units: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Units not chosen."""
    return units.join(chosen, keys, "left_anti")


def match_relations(patterns: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations that a query pattern may mean.

    patterns: pattern, type (null: any), lefts, rights (arrays, empty: any), direction (out, in,
    undirected); relations: source, type, target. Typed patterns join by their type, untyped ones by
    the labels of an end that has some. A pattern without type and labels means every relation. Relations are those of one
    schema and go to where the patterns lie; patterns and what they mean are neither shuffled nor held.
    """

    def fits(a: str, b: str) -> Column:
        held = lambda side, c: (F.size(side) == 0) | F.array_contains(F.col(side), F.col(c))
        return held("lefts", a) & held("rights", b)

    ends = (
        ((F.col("direction") == "out") & fits("source", "target"))
        | ((F.col("direction") == "in") & fits("target", "source"))
        | ((F.col("direction") == "undirected") & (fits("source", "target") | fits("target", "source")))
    )
    rel = relations.select("source", F.col("type").alias("rel_type"), "target")
    pick = ["pattern", "source", "rel_type", "target"]
    out = patterns.where("type is not null").join(F.broadcast(rel), F.col("type") == F.col("rel_type")).where(ends).select(*pick)
    untyped = patterns.where("type is null")
    at = F.explode(F.array(F.struct(F.col("source").alias("label"), F.lit("source").alias("end")), F.struct(F.col("target").alias("label"), F.lit("target").alias("end"))))
    by_end = rel.select("*", at.alias("at")).select("source", "rel_type", "target", "at.*")
    for side, forward, chosen in (("lefts", "source", F.size("lefts") > 0), ("rights", "target", (F.size("lefts") == 0) & (F.size("rights") > 0))):
        back = "target" if forward == "source" else "source"
        sides = F.when(F.col("direction") == "out", F.array(F.lit(forward))).when(F.col("direction") == "in", F.array(F.lit(back))).otherwise(F.array(F.lit(forward), F.lit(back)))
        asked = untyped.where(chosen).withColumn("label", F.explode(F.array_distinct(side))).withColumn("end", F.explode(sides))
        # A relation from a label to itself, or between two of the labels, is met at both ends; it counts at its source.
        again = (F.col("end") == "target") & F.array_contains(sides, "source") & F.coalesce(F.array_contains(side, F.col("source")), F.lit(False))
        out = out.unionByName(asked.join(F.broadcast(by_end), ["label", "end"]).where(ends & ~again).select(*pick))
    return out.unionByName(untyped.where((F.size("lefts") == 0) & (F.size("rights") == 0)).join(F.broadcast(rel), F.lit(True)).select(*pick))


def similar_nodes(nodes: DataFrame, properties: DataFrame, least_shared: int = 2, least_jaccard: float = 0.5) -> DataFrame:
    """Pairs of nodes of one schema that share at least least_shared properties and that much of their union.

    Pairs come from shared properties, so nodes with nothing in common never meet.
    """
    held = nodes.join(properties, "node_id").select("schema_id", "node_id", "property").distinct()
    size = held.groupBy("schema_id", "node_id").agg(F.count("*").alias("n"))
    a = held.select("schema_id", F.col("node_id").alias("a"), "property")
    b = held.select("schema_id", F.col("node_id").alias("b"), "property")
    shared = a.join(b, ["schema_id", "property"]).where("a < b").groupBy("schema_id", "a", "b").agg(F.count("*").alias("shared"))
    side = lambda c: size.select("schema_id", F.col("node_id").alias(c), F.col("n").alias(f"n_{c}"))
    both = shared.join(side("a"), ["schema_id", "a"]).join(side("b"), ["schema_id", "b"])
    jaccard = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return both.withColumn("jaccard", jaccard).where((F.col("shared") >= least_shared) & (F.col("jaccard") >= least_jaccard)).select("schema_id", "a", "b", "shared", "jaccard")


def competing_relations(relations: DataFrame) -> DataFrame:
    """Pairs of relations with the same type or the same two ends in either order.

    Two equi-joins, by type and by unordered ends, in place of one theta join.
    """
    r = relations.withColumn("unit", F.concat_ws("|", "source", "type", "target")).withColumn("ends", F.concat_ws("~", F.least("source", "target"), F.greatest("source", "target")))
    found = None
    for by in ("type", "ends"):
        a, b = r.select(by, F.col("unit").alias("a")), r.select(by, F.col("unit").alias("b"))
        pairs = a.join(b, by).where("a < b").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def drop_selected(units: DataFrame, key: str, unit: str, ratio: float, seed: int) -> DataFrame:
    """A simulated miss: of a share of the keys with several units one unit is left out."""
    from .sampling import draw, uniform

    n = units.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(draw(seed, key, unit).alias("d"), F.col(unit).alias("u"))).alias("first"))
    hit = n.where((F.col("n") > 1) & (uniform(seed, key) < ratio)).select(key, F.col("first.u").alias(unit))
    return units.join(hit, [key, unit], "left_anti")


def subset(ids: Column, wanted: Column) -> Column:
    """The ids that are wanted, in their order."""
    return F.filter(ids, lambda x: F.array_contains(wanted, x))


def missed(units: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """(key, unit): what a selector is made to miss, for about a share of the keys.

    units: key, unit, kind, label (1: gold), source, target. A gold relation goes, with those of its ends in
    hand that no other relation needs; without gold relations a gold node goes that no relation needs.
    Nothing goes where nothing would be left.
    """
    from .sampling import draw, uniform

    held = units.groupBy(key, "unit", "kind").agg(F.max("label").alias("label"), F.min("source").alias("source"), F.min("target").alias("target"))
    ends = held.where("kind = 'relation'").select(key, F.col("unit").alias("by"), F.explode(F.array_distinct(F.array("source", "target"))).alias("unit"))
    needed = ends.groupBy(key, "unit").agg(F.count("*").alias("uses"), F.min("by").alias("by"))
    marked = held.join(needed, [key, "unit"], "left")
    gold, relation = F.col("label") == 1, F.col("kind") == "relation"
    drawn = F.struct(draw(seed, key, "unit").alias("d"), F.col("unit").alias("u"))
    per = marked.groupBy(key).agg(
        F.count("*").alias("n"), F.min(F.when(gold & relation, drawn)).alias("r"), F.min(F.when(gold & ~relation & F.col("uses").isNull(), drawn)).alias("f"),
    )
    picked = per.where(uniform(seed, key) < ratio).select(key, "n", F.coalesce("r.u", "f.u").alias("picked")).where("picked is not null")
    gone = marked.join(picked, key).where((F.col("unit") == F.col("picked")) | ((F.col("uses") == 1) & (F.col("by") == F.col("picked")) & ~relation))
    kept = gone.groupBy(key).agg(F.count("*").alias("m"), F.max("n").alias("n")).where("m < n").select(key)
    return gone.select(key, "unit").join(kept, key, "left_semi")


def augmentation_mode(rows: DataFrame, key: str, spare: str, gold: float, full: float, seed: int) -> DataFrame:
    """rows with mode: gold (nothing is added, also where there is nothing to add), full (everything) or noisy (some units)."""
    from .sampling import uniform

    u = uniform(seed, key)
    return rows.withColumn("mode", F.when((u < gold) | ~F.col(spare), "gold").when(u < gold + full, "full").otherwise("noisy"))

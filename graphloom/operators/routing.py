"""Filters, routes and audited joins between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def route(rows: DataFrame, strict: bool = True, question="question", cypher="cypher", n_units="n_units", complete="complete") -> DataFrame:
    """rows with a reason to reject them, the first that holds, or null."""
    reason = (
        F.when(blank(question) | blank(cypher), "missing_question_or_cypher")
        .when(F.col(n_units) == 0, "empty_normalized_schema")
        .when(F.col(n_units) == 1, "no_schema_units_resolved")
    )
    if strict:
        reason = reason.when(~F.col(complete), "incomplete_gold_subschema")
    return rows.withColumn("reason", reason)


def route_counts(routed: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each route, and of rows with issues, which are no route of their own."""
    return routed.groupBy(*by).agg(
        F.count("*").alias("examples"), F.count_if(F.col("reason").isNull()).alias("usable"),
        F.count_if(F.col("reason") == "missing_question_or_cypher").alias("missing_text"),
        F.count_if(F.col("reason") == "empty_normalized_schema").alias("empty_schema"),
        F.count_if(F.col("reason") == "no_schema_units_resolved").alias("unresolved"),
        F.count_if(F.col("reason") == "incomplete_gold_subschema").alias("incomplete"),
        F.count_if("has_issue").alias("issues"), F.sum(F.when(F.col("reason").isNull(), F.col("n_units"))).alias("units"),
    )


def inference_rows(routed: DataFrame) -> DataFrame:
    """Test examples that go to inference whatever their gold; gold columns only where it is whole."""
    usable = ~F.col("reason").isin("missing_question_or_cypher", "empty_normalized_schema") | F.col("reason").isNull()
    gold = (F.col("n_units") > 1) & F.col("complete")
    return routed.where((F.col("split") == "test") & usable).select("example_id", gold.alias("gold_available"), F.when(gold, F.col("n_units")).alias("gold_units"))


def label_text(label: Column) -> Column:
    """1 and 0 as YES and NO; anything else fails."""
    return F.when(label == 1, "YES").when(label == 0, "NO").otherwise(F.raise_error(F.concat(F.lit("not a label: "), label.cast("string"))))


def decide(valid: Column, said: Column, p: Column, threshold: float) -> Column:
    """INVALID unless valid; by p where there is one, else what was said."""
    return F.when(~valid, "INVALID").when(p.isNotNull(), F.when(p >= threshold, "YES").otherwise("NO")).otherwise(said)


def unit_type(type_: Column, kind: Column, unit: Column) -> Column:
    """The first of type, kind and the unit id's prefix that is there."""
    return F.coalesce(type_, kind, F.split_part(unit, F.lit(":"), F.lit(1)))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only, or more than once: (key, in_left, in_right)."""
    side = lambda df, n: df.select(key, F.lit(n).alias("s"))
    both = side(left, 1).unionByName(side(right, 2)).groupBy(key).agg(F.count_if(F.col("s") == 1).alias("in_left"), F.count_if(F.col("s") == 2).alias("in_right"))
    return both.where("in_left <> 1 or in_right <> 1")


def positional(left: DataFrame, right: DataFrame, pos: str, key: str) -> DataFrame:
    """Row k of one side with row k of the other, and whether their keys agree; a missing partner disagrees."""
    a, b = left.select(pos, F.col(key).alias("left_key")), right.select(pos, F.col(key).alias("right_key"))
    return a.join(b, pos, "full").select(pos, "left_key", "right_key", F.col("left_key").eqNullSafe(F.col("right_key")).alias("agrees"))


def zero_filled(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """How many rows each known key has, 0 included."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return keys.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, which fails at run time where the condition does not hold."""
    return df.where(F.coalesce(condition, F.lit(False)) | F.raise_error(F.lit(message)).cast("boolean"))


def captured(value: Column, failed: Column, message: Column) -> Column:
    """struct<value, error>: the value, or why there is none."""
    return F.struct(F.when(~failed, value.cast("double")).alias("value"), F.when(failed, message).alias("error"))


def executable(failed: Column) -> Column:
    return F.when(failed, 0.0).otherwise(1.0)


def of_graph(rows: DataFrame, graph: str | None, column: str = "graph") -> DataFrame:
    """Rows of one graph; an empty name asks for all."""
    return rows.where(F.col(column) == graph) if graph else rows

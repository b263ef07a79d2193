"""The corpus build as one chain, for streams and for tables: sources, schemas, routes, sinks.

Examples of all sources are joined to their schemas, routed, and written to six outputs. The steps are the same columns for a stream and
for a table: gold subsets, labels and the sample of negatives are worked out inside a row, so the only state of a stream
is that of repeated examples. Outputs are append logs, and a micro-batch is appended to each under its number: one that is run again after a
crash adds to those outputs that had not taken it, and to no other.

Examples: example_id, split, graph, schema_id, question, cypher, units (ids of the schema units that the query needs), complete (whether all its
patterns were mapped), issues (what was found amiss when the schema was normalized) and, for streams, arrived. Schemas: schema_id, units (ids in canonical order, nodes first).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sampling import draw
from ..sources import versions

CONTEXT = ["example_id", "source", "split", "graph", "schema_id", "question", "cypher"]
KEY = ["source", "split", "graph", "example_id"]

#: Outputs and their columns.
OUTPUTS = {
    "generation": "example_id string, source string, split string, graph string, schema_id string, question string, cypher string, nodes array<string>, relations array<string>",
    "selection": "example_id string, source string, split string, graph string, schema_id string, question string, unit_id string, unit_type string, label int",
    "rejected": "example_id string, source string, split string, graph string, schema_id string, question string, cypher string, reason string",
    "issues": "example_id string, source string, split string, graph string, schema_id string, issue string",
    "inference_generation": "example_id string, source string, split string, graph string, schema_id string, question string, cypher string, gold_available boolean, nodes array<string>, relations array<string>",
    "inference_selection": "example_id string, source string, split string, graph string, schema_id string, question string, unit_id string, unit_type string, label int",
}


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def union(sources: dict[str, DataFrame], delay: str | None = None) -> DataFrame:
    """Examples of several sources under their names. delay: the sources are streams, and an example may come again for that long; else they are tables.

    Of several rows of one source, split, graph and id one stays; they are to be alike.
    """
    named = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    if delay is None:
        return reduce(DataFrame.unionByName, named).dropDuplicates(KEY)
    return reduce(DataFrame.unionByName, [df.withWatermark("arrived", delay) for df in named]).dropDuplicatesWithinWatermark(KEY)


def routed(examples: DataFrame, schemas: DataFrame, strict: bool = True) -> DataFrame:
    """Examples with their schema's units, the gold ones of them in canonical order, and the reason to reject them, the first that holds, or null."""
    static = schemas.select("schema_id", F.col("units").alias("schema_units")).dropDuplicates(["schema_id"])
    none = F.array().cast("array<string>")
    rows = examples.join(static, "schema_id", "left").withColumn("schema_units", F.coalesce("schema_units", none))
    rows = rows.withColumn("gold", F.array_intersect("schema_units", F.coalesce("units", none)))
    whole = F.coalesce("complete", F.lit(False)) & (F.size("gold") == F.size(F.array_distinct(F.coalesce("units", none))))
    reason = F.when(_blank("question") | _blank("cypher"), "missing_question_or_cypher").when(F.size("schema_units") == 0, "empty_normalized_schema").when(F.size("gold") == 0, "no_schema_units_resolved")
    return rows.withColumn("whole", whole).withColumn("reason", reason.when(~whole, "incomplete_gold_subschema") if strict else reason)


def _of(kind: str) -> Column:
    return F.filter("gold", lambda u: F.startswith(u, F.lit(f"{kind}:")))


def _labelled(others: Column) -> Column:
    """(unit_id, unit_type, label) of the gold units and of others, each in canonical order. Sets are told apart by hashing: no unit is sought among all."""
    unit = lambda label: lambda u: F.struct(u.alias("unit_id"), F.split_part(u, F.lit(":"), F.lit(1)).alias("unit_type"), F.lit(label).alias("label"))
    return F.concat(F.transform("gold", unit(1)), F.transform(others, unit(0)))


def _units(negative_ratio: float | None, seed: int) -> tuple[Column, Column, Column]:
    """Units of a selection row, whether an example goes to inference, and its units there; labels there only where the gold ones are whole."""
    every = F.array_compact(F.array_except("schema_units", "gold"))
    others = every
    if negative_ratio is not None:
        drawn = F.array_sort(F.transform(every, lambda u: F.struct(draw(seed, *map(F.col, KEY), u).alias("d"), u.alias("u"))))
        others = F.transform(F.slice(drawn, F.lit(1), F.bround(F.size("gold") * F.lit(float(negative_ratio))).cast("int")), lambda x: x.u)
    test = (F.col("split") == "test") & ~(_blank("question") | _blank("cypher")) & (F.size("schema_units") > 0)
    told = F.transform(_labelled(every), lambda x: F.struct(x.unit_id.alias("unit_id"), x.unit_type.alias("unit_type"), F.when(_told(), x.label).alias("label")))
    return _labelled(others), test, told


def _told() -> Column:
    return (F.size("gold") > 0) & F.col("whole")


def outputs(rows: DataFrame, negative_ratio: float | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """The six outputs of routed examples.

    negative_ratio: of an example's units that are not gold at most so many for each gold one stay, rounded half to even, at random by seed; None: all.
    Test examples with question, query and schema go to inference whatever their gold; gold columns and labels only where it is whole.
    """
    usable, context = rows.where("reason is null"), [*KEY, "schema_id", "question"]
    selected, tested, told = _units(negative_ratio, seed)
    exploded = lambda df, units: df.select(*context, F.explode(units).alias("x")).select(*context, "x.*")
    test, gold = rows.where(tested), _told()
    made = {
        "generation": usable.select(*CONTEXT, _of("node").alias("nodes"), _of("relation").alias("relations")),
        "selection": exploded(usable, selected),
        "rejected": rows.where("reason is not null").select(*CONTEXT, "reason"),
        "issues": rows.select(*KEY, "schema_id", F.explode("issues").alias("issue")),
        "inference_generation": test.select(*CONTEXT, gold.alias("gold_available"), F.when(gold, _of("node")).alias("nodes"), F.when(gold, _of("relation")).alias("relations")),
        "inference_selection": exploded(test, told),
    }
    return {name: df.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in OUTPUTS[name].split(", ")]) for name, df in made.items()}


def build_table(sources: dict[str, DataFrame], schemas: DataFrame, strict: bool = True, negative_ratio: float | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """The outputs of whole tables."""
    return outputs(routed(union(sources), schemas, strict), negative_ratio, seed)


def build_stream(sources: dict[str, DataFrame], schemas: DataFrame, path: str, checkpoint: str, delay: str, strict: bool = True, negative_ratio: float | None = None, seed: int = 42) -> StreamingQuery:
    """The outputs of streams, as append logs path/<output>. Schemas are a table that each micro-batch is joined to as it then is."""
    rows = routed(union(sources, delay), schemas, strict)

    def write(batch: DataFrame, number: int) -> None:
        # The rows of a micro-batch are used six times.
        batch = batch.persist()
        try:
            for name, df in outputs(batch, negative_ratio, seed).items():
                versions.append(df, f"{path}/{name}", number)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(made: dict[str, DataFrame]) -> DataFrame:
    """(source, split, output, n, labelled): rows of each output, and how many of them have label 1, for the manifest."""
    label = lambda df: F.count_if(F.col("label") == 1) if "label" in df.columns else F.lit(None).cast("long")
    each = [df.groupBy("source", "split").agg(F.count("*").alias("n"), label(df).alias("labelled")).select("source", "split", F.lit(name).alias("output"), "n", "labelled") for name, df in made.items()]
    return reduce(DataFrame.unionByName, each)


def counted(rows: DataFrame, negative_ratio: float | None = None, seed: int = 42) -> DataFrame:
    """counts() of the outputs() of routed examples in one pass, by the sizes of what an example gives to each output."""
    selected, test, told = _units(negative_ratio, seed)
    usable, issues = F.col("reason").isNull(), F.coalesce(F.greatest(F.size("issues"), F.lit(0)), F.lit(0))
    one = lambda held: (F.lit(1), None, held)
    many = lambda units, held: (F.size(units), F.size(F.filter(units, lambda x: x.label == 1)), held)
    given = {"generation": one(usable), "selection": many(selected, usable), "rejected": one(~usable), "issues": (issues, None, F.lit(True)), "inference_generation": one(test), "inference_selection": many(told, test)}
    held = lambda c, of: F.when(of, c).otherwise(0).cast("long")
    each = [F.struct(F.lit(name).alias("output"), held(n, of).alias("n"), (F.lit(None).cast("long") if labelled is None else held(labelled, of)).alias("labelled")) for name, (n, labelled, of) in given.items()]
    sums = rows.select("source", "split", F.explode(F.array(*each)).alias("x")).select("source", "split", "x.*").groupBy("source", "split", "output")
    return sums.agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled")).where("n > 0")


def read_outputs(spark, path: str) -> dict[str, DataFrame]:
    """What build_stream() has committed."""
    return {name: versions.read_log(spark, f"{path}/{name}", schema).drop("batch") for name, schema in OUTPUTS.items()}

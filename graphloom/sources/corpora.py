"""Benchmark corpora in three layouts, read as one table of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_ordered

# Folders of the sources, the layout of their schemas, and the marks in prompt records.
SOURCES = {"cypherbench": ("Cypherbench", "entities"), "mind_the_query": ("Mind_the_query", "tables"), "neo4j_text2cypher": ("Neo4j_Text2Cypher", "text")}
QUESTION, SCHEMA, TASK = "QUESTION:\n", "\n\nSCHEMA:\n", "\n\nGenerate a Cypher query"
SPLITS = {"train": "train", "dev": "dev", "val": "dev", "test": "test"}


def split_candidates(source: str, split: str) -> list[str]:
    """File names that may hold a split of a source, in order of preference."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}: one of {', '.join(SPLITS)}")
    name = SPLITS[split]
    if source == "cypherbench":
        return [f"{name}.jsonl", f"{name}.json"]
    # The line files of the other sources lack what is needed to find a schema.
    return [f"{name}.json"] + (["train_val.json"] if (source, name) == ("mind_the_query", "train") else [])


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def split_path(spark: SparkSession, root: str, source: str, split: str) -> str:
    """The first file of a split that is there."""
    names = split_candidates(source, split)
    for name in names:
        if _exists(spark, path := f"{root.rstrip('/')}/{SOURCES[source][0]}/{name}"):
            return path
    raise FileNotFoundError(f"{root}/{SOURCES[source][0]}/{names[0]}")


def read_object(spark: SparkSession, path: str) -> DataFrame:
    """One row with the text of a file that holds one JSON object; anything else fails."""
    raw = spark.read.option("wholetext", True).text(path)
    ok = F.json_object_keys("value").isNotNull() & F.trim(F.col("value")).startswith("{")
    return raw.where(F.coalesce(ok, F.lit(False)) | F.raise_error(F.lit(f"{path}: not a JSON object")).cast("boolean"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON array with pos, their place in it."""
    raw = spark.read.option("wholetext", True).text(path)
    rows = F.from_json("value", f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    return raw.select(F.posexplode(rows).alias("pos", "r")).select(F.col("pos").cast("long").alias("pos"), "r.*")


def prompt_record(prompt: Column, response: Column) -> Column:
    """(question, schema text, query) of a record that holds its question and schema in one prompt; another prompt fails."""
    body = F.substr(prompt, F.lit(len(QUESTION) + 1))
    question = F.substring_index(body, SCHEMA, 1)
    rest = F.substr(body, F.length(question) + len(SCHEMA) + 1)
    cypher = F.get_json_object(response, "$.cypher")
    ok = prompt.startswith(QUESTION) & F.contains(body, F.lit(SCHEMA)) & cypher.isNotNull()
    made = F.struct(question.alias("question"), F.substring_index(rest, TASK, 1).alias("schema"), cypher.alias("cypher"))
    return F.when(F.coalesce(ok, F.lit(False)), made).otherwise(F.raise_error(F.lit("not a prompt record")).cast(made_type()))


def made_type() -> str:
    return "struct<question:string,schema:string,cypher:string>"


RECORD = "qid string, instance_id string, graph string, question string, nl_question string, gold_cypher string, schema string, user_prompt string, response string"


def examples(spark: SparkSession, root: str, source: str, split: str) -> DataFrame:
    """(pos, example_id, source, split, graph, question, cypher, kind, schema_text, schema_reference) of one split.

    kind and schema_text are what functions.schemas.normalize_distinct reads. Question and query are
    stripped. A graph that is missing or empty is called unknown. Ids of a source can repeat between
    graphs, so an example's id holds its source, split and graph.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}: one of {', '.join(SOURCES)}")
    folder, kind = SOURCES[source]
    path = split_path(spark, root, source, split)
    name = path.rpartition("/")[2]
    rows = read_ordered(spark, path, RECORD) if path.endswith(".jsonl") else read_array(spark, path, RECORD)
    named = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c)
    by_prompt = F.col("user_prompt").isNotNull() if source == "cypherbench" else F.lit(False)
    made = F.when(by_prompt, prompt_record(F.col("user_prompt"), F.col("response")))
    order = ("question", "nl_question") if source == "mind_the_query" else ("nl_question", "question")
    rows = rows.withColumn("p", made).withColumn("graph", F.when(by_prompt, named(F.get_json_object("p.schema", "$.name"))).otherwise(named(F.col("graph"))))
    place = F.concat(F.lit(f"{name}["), "pos", F.lit("]"))
    if source == "neo4j_text2cypher":
        rows = rows.withColumn("schema_text", F.coalesce("schema", F.lit(""))).withColumn("schema_reference", F.concat(place, F.lit(".schema")))
    else:
        suffix = "_schema.json" if source == "cypherbench" else ".json"
        file = F.concat(F.lit(f"{folder}/graphs/schemas/"), "graph", F.lit(suffix))
        rows = rows.withColumn("schema_reference", F.when(by_prompt, F.concat(place, F.lit(".user_prompt.SCHEMA"))).otherwise(file))
        files = f"{root.rstrip('/')}/{folder}/graphs/schemas"
        if _exists(spark, files):
            texts = spark.read.option("wholetext", True).text(files).select(F.concat(F.lit(f"{folder}/graphs/schemas/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("schema_reference"), F.col("value").alias("file_text"))
            rows = rows.join(texts, "schema_reference", "left")
        else:
            rows = rows.withColumn("file_text", F.lit(None).cast("string"))
        rows = rows.withColumn("schema_text", F.coalesce("p.schema", "file_text"))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return rows.select(
        "pos", F.concat_ws(":", F.lit(source), F.lit(split), "graph", F.coalesce("qid", "instance_id", F.col("pos").cast("string"))).alias("example_id"),
        F.lit(source).alias("source"), F.lit(split).alias("split"), "graph", strip(F.coalesce("p.question", *order, F.lit(""))).alias("question"),
        strip(F.coalesce("p.cypher", "gold_cypher", F.lit(""))).alias("cypher"), F.lit(kind).alias("kind"), "schema_text", "schema_reference",
    )

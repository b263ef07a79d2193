"""Sources: JSON records in lines or arrays, partitioned scores, and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import digests


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a .jsonl file (one object in each line) or a .json file (an array of objects); anything else fails."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.json(path) if path.endswith(".jsonl") else reader.option("multiLine", True).json(path)


def read_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with pos, the place of each line, blank ones aside; lines keep their order within a file."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return lines.select("pos", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("pos", "r.*")


def read_scores(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Records of all files that match, with the name of their folder as graph; empty files add nothing."""
    df = spark.read.schema(schema).json(pattern)
    return df.withColumn("graph", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).where(F.col("_metadata.file_size") > 0)


def unique_index(df: DataFrame, key: str) -> DataFrame:
    """df, which fails at run time if a key is missing or stands twice."""
    n = df.groupBy(key).agg(F.count("*").alias("n_")).where((F.col("n_") > 1) | F.col(key).isNull())
    bad = n.agg(F.count("*").alias("bad_"))
    return df.crossJoin(F.broadcast(bad)).where((F.col("bad_") == 0) | F.raise_error(F.lit(f"{key} is missing or repeated")).cast("boolean")).drop("bad_")


def fingerprint(spark: SparkSession, paths: list[str], settings: str) -> str:
    """A digest of files' names, sizes and bytes, and of settings."""
    return digests.fingerprint(digests.full(digests.listed(spark, paths)), settings)

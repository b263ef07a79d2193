"""Sinks: canonical JSON lines, routed tables, and documents that appear as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines with columns in order of name; null fields are left out. An existing path is refused unless overwrite."""
    df.select(*[f"`{c}`" for c in sorted(df.columns)]).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """A JSON document, written beside its place and then moved there, by the store's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    replace[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    # One step: a crash leaves the old document or the new one.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(part), fs.makeQualified(target), replace)


def manifest(counts: DataFrame, by: list[str]) -> dict:
    """Nested counts by the values of a few columns: a document, so of few rows."""
    rows = counts.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a manifest is a summary: more than 10,000 rows")
    return {"/".join(str(r[c]) for c in by): {c: r[c] for c in counts.columns if c not in by} for r in rows}


def skip_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def guard(spark: SparkSession, inputs: list[str], outputs: list[str], overwrite: bool = False) -> None:
    """Fails where an output is an input, or is there already and must not be overwritten."""
    whole = lambda p: _fs(spark, p)[0].makeQualified(_fs(spark, p)[1]).toString()
    if both := {whole(p) for p in inputs} & {whole(p) for p in outputs}:
        raise ValueError(f"outputs are inputs: {', '.join(sorted(both))}")
    there = [p for p in outputs if _fs(spark, p)[0].exists(_fs(spark, p)[1])]
    if there and not overwrite:
        raise FileExistsError(", ".join(there))


def free_path(spark: SparkSession, path: str, stamp: str) -> str:
    """path, or path with a time stamp where it holds something."""
    fs, p = _fs(spark, path)
    return f"{path}-{stamp}" if fs.exists(p) and len(fs.listStatus(p)) else path


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder as it is, without reading it as a table."""
    (fs, p), (other, q) = _fs(spark, source), _fs(spark, target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, False, spark.sparkContext._jsc.hadoopConfiguration())

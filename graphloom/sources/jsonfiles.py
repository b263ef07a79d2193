"""JSON files split among tasks: lines with their numbers, and arrays of objects that no task reads as a whole.

Both lean on Spark's text reader, which splits a file at any separator. An array is cut at each closing brace;
whether a cut lies in a text, and how deep, follows from the quotes and braces before it. Those are counted piece by piece, summed by
split of the file (a row for each split), and carried over, so a file of any size is read in parallel by any store that Spark reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import staging

_TEXTS = r'"(?:\\.|[^"\\])*(?:"|$)'


def _split_text(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(file, block, id, value): pieces between separators; id grows along a block of a file."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def _carried(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """rows with the sum of n over all rows before them in their file. rows: file, block, id. A window spans one split of a file, and sums of splits a row each."""
    within = F.sum(n).over(W.partitionBy("file", "block").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    sums = rows.groupBy("file", "block").agg(F.sum(n).alias("n_"))
    before = F.sum("n_").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select("file", "block", F.coalesce(before, F.lit(0)).alias("before_"))
    return rows.join(starts, ["file", "block"]).withColumn(name, F.col("before_") + F.coalesce(within, F.lit(0))).drop("before_")


def _first(rows: DataFrame, n: int) -> DataFrame:
    """At most the first n rows of every split: a task stops there."""

    def stop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[tuple, int] = {}
        for b in batches:
            keep = []
            for at, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                left[key] = left.get(key, n) - 1
                if left[key] >= 0:
                    keep.append(at)
            if keep:
                yield b.take(pa.array(keep))

    return rows.mapInArrow(stop, "file string, block long, id long, value string")


def numbered_lines(spark: SparkSession, path: str | list[str], max_rows: int | None = None) -> DataFrame:
    """(file, line, value): the lines of files, numbered from 1 in each; blank ones have a number, too, and are left out.

    max_rows: the first so many lines that are not blank of all files in order of name. Only as many pass on from each split of a file.
    """
    rows = staging.kept(_split_text(spark, path, "\n").select("file", "block", "id", F.trim("value").alias("value")) if max_rows is None else _head(spark, path, max_rows), "lines")
    lines = _carried(rows, F.lit(1), "line").select("file", (F.col("line") + 1).alias("line"), "value").where("value <> ''")
    return lines if max_rows is None else lines.orderBy("file", "line").limit(max_rows)


def _head(spark: SparkSession, path: str | list[str], n: int) -> DataFrame:
    if n < 1:
        raise ValueError("max_rows is positive")
    # Of blank lines as many as there are may stand before the n that count, so they are told apart first.
    text = _split_text(spark, path, "\n").select("file", "block", "id", F.trim("value").alias("value"))
    return text if spark.read.option("lineSep", "\n").text(path).where(F.trim("value") == "").limit(1).count() else _first(text, n)


def read_lines(spark: SparkSession, path: str | list[str], schema: str, max_rows: int | None = None) -> DataFrame:
    """(file, line, the schema's columns) of files with a JSON object in each line that is not blank. Any other line fails with its file and number."""
    lines = numbered_lines(spark, path, max_rows)
    return _parsed(lines, schema, F.concat("file", F.lit(":"), F.col("line").cast("string")), ["file", "line"])


def _parsed(rows: DataFrame, schema: str, place: Column, keep: list[str]) -> DataFrame:
    parsed = F.from_json("value", f"{schema}, `_bad` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.select(*keep, "value", parsed.alias("r"), place.alias("place"))
    # The parser stops at the end of an object and would not notice what stands behind it.
    alone = F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1
    sound = F.col("value").startswith("{") & F.col("r").isNotNull() & F.col("r._bad").isNull() & alone
    checked = rows.where(F.coalesce(sound, F.lit(False)) | F.raise_error(F.concat("place", F.lit(": not a JSON object of the schema"))).cast("boolean"))
    return checked.select(*keep, "r.*").drop("_bad")


def array_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, pos, value): the objects of files that hold one JSON array of objects each, as text, with their place from 0.

    Anything between or around the objects but brackets, commas and white space fails, and so does a file that ends within an object.
    """
    pieces = staging.kept(_split_text(spark, path, "}"), "pieces")
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '[^"]', ""))
    pieces = _carried(pieces, quotes, "quotes")
    inside = F.col("quotes") % 2 == 1
    bare = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), "value")).otherwise(F.col("value")), _TEXTS, "")
    ends_inside = (F.col("quotes") + quotes) % 2 == 1
    opened = F.length(F.regexp_replace(bare, r"[^{]", ""))
    # The last piece of a file has no brace behind it.
    last = F.lead("id").over(W.partitionBy("file", "block").orderBy("id")).isNull() & (F.col("block") == F.max("block").over(W.partitionBy("file")))
    pieces = staging.kept(pieces.select("file", "block", "id", "value", opened.alias("opened"), (~ends_inside & ~last).cast("int").alias("closed"), last.alias("last")), "pieces")
    pieces = _carried(pieces, F.col("opened") - F.col("closed"), "depth")
    after = F.col("depth") + F.col("opened") - F.col("closed")
    pieces = staging.kept(pieces.select("file", "block", "id", F.when(F.col("last"), F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("value"), "last", after.alias("after"), ((after == 0) & (F.col("closed") == 1)).cast("int").alias("done")), "pieces")
    pieces = _carried(pieces, F.col("done"), "pos")
    items = pieces.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("p"), F.max("done").alias("done"), F.max("last").alias("last"), F.min("after").alias("after"))
    text = F.array_join(F.transform("p", lambda x: x.value), "")
    lead = F.regexp_extract("text", r"(?s)^[^{]*", 0)
    items = items.select("file", "pos", "done", "last", text.alias("text")).withColumn("lead", lead)
    between = F.when(F.col("pos") == 0, F.lit(r"^\s*\[\s*$")).otherwise(F.lit(r"^\s*,\s*$"))
    tail = F.when(F.col("pos") == 0, F.lit(r"^\s*\[\s*\]\s*$")).otherwise(F.lit(r"^\s*\]\s*$"))
    sound = F.when(F.col("done") == 1, F.regexp(F.col("lead"), between) & ~F.col("last")).otherwise(F.regexp(F.col("text"), tail))
    checked = items.where(sound | F.raise_error(F.concat("file", F.lit("["), F.col("pos").cast("string"), F.lit("]: not an array of JSON objects"))).cast("boolean"))
    return checked.where("done = 1").select("file", "pos", F.substr("text", F.length("lead") + 1).alias("value"))


def read_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, pos, the schema's columns) of files with one JSON array of objects each. An object that does not fit the schema fails with its file and place."""
    return _parsed(array_items(spark, path), schema, F.concat("file", F.lit("["), F.col("pos").cast("string"), F.lit("]")), ["file", "pos"])

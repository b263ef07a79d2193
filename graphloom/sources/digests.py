"""Digests of files by ranges: no file is ever a value in a table, and a large one is read by many tasks.

Executors open files by their address through pyarrow's file systems, and fetch the ranges that they are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at either end that a sampled digest looks at, and of a range of a full one. Another value gives other digests.
SAMPLE, CHUNK = 1 << 16, 8 << 20


def _open(path: str):
    import pyarrow.fs
    from urllib.parse import unquote

    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file(unquote("/" + path.removeprefix("file:").lstrip("/")))
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, size) of the files there, but for empty ones, which Spark's readers leave out. Their bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))


def _digested(ranges: DataFrame) -> DataFrame:
    """ranges (path, size, part, spans array<struct<at, n>>) with the SHA-256 of the bytes of all spans one after the other, and how many were fetched."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            digests, fetched = [], []
            for path, spans in zip(pdf["path"], pdf["spans"]):
                h, n = hashlib.sha256(), 0
                with _open(path) as f:
                    for s in spans:
                        data = f.read_at(int(s["n"]), int(s["at"]))
                        h.update(data)
                        n += len(data)
                digests.append(h.hexdigest())
                fetched.append(n)
            yield pd.DataFrame({"path": pdf["path"], "size": pdf["size"], "part": pdf["part"], "digest": digests, "fetched": fetched})

    # Ranges of one file go to many tasks.
    return ranges.repartition("path", "part").mapInPandas(fetch, "path string, size long, part long, digest string, fetched long")


def _span(at: Column, n: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), n.cast("long").alias("n"))


def sampled(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(path, size, digest, fetched): the SHA-256 of a file's first ``sample`` bytes and, where it has more than those, of its last ones after them."""
    size, n = F.col("size"), F.lit(sample)
    head = F.array(_span(F.lit(0), F.least(size, n)))
    tail = F.array(_span(size - F.least(size, n), F.least(size, n)))
    spans = F.when(size > n, F.concat(head, tail)).otherwise(head)
    return _digested(files.select("path", "size", F.lit(0).cast("long").alias("part"), spans.alias("spans"))).drop("part")


def full(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, size, digest, fetched): a digest of all bytes: the SHA-256 of the SHA-256s of a file's ranges, in order."""
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / chunk) - 1, F.lit(0)).cast("long"))
    each = files.select("path", "size", F.explode(parts).alias("part"))
    at = F.col("part") * chunk
    got = _digested(each.select("path", "size", "part", F.array(_span(at, F.least(F.lit(chunk), F.col("size") - at))).alias("spans")))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x.digest), "\n")
    return got.groupBy("path", "size").agg(F.sha2(in_order, 256).alias("digest"), F.sum("fetched").alias("fetched"))


def fingerprint(digests: DataFrame, settings: str) -> str:
    """One digest of files by name, size and digest, in order of name, and of settings. Few files: their names and digests meet in one text."""
    name = F.element_at(F.split("path", "/"), -1)
    lines = digests.select(F.concat_ws("|", name, "size", "digest").alias("line")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("t"))
    return lines.select(F.sha2(F.concat("t", F.lit("\n" + settings)), 256)).first()[0]

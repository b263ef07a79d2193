"""Tables that cut lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SWEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a fresh one is set on a single machine; a cluster must name it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder; this application's places go when its driver ends."""
    own = f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}"
    if own not in _SWEPT:
        _SWEPT.add(own)
        atexit.register(_sweep, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again.

    A lost executor costs no recomputation of what stands above, and both sides of a later
    join start from a scan, so that Spark can split a skewed key there.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written, batches for Python hold at most 8 MB, whatever the length of a row's text."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "8m")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def drop(df: DataFrame) -> None:
    """Delete a table that keep() made, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _sweep(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)

"""Tables that cut lineage between the rounds of an iterative plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A local master without the setting gets one of its own; a cluster must name it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A path of this application's own in the shared folder. What an application wrote goes when its driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"{shared_folder(spark)}/graphloom/{app}"
        atexit.register(_remove, spark, _OWN[app])
    return f"{_OWN[app]}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor costs the reading only."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of kept() that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _remove(df.sparkSession, file.rpartition("/")[0])


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

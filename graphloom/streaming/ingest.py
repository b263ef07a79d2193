"""Incremental builds on Structured Streaming: stateless routing of new files, and an append that resumes exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import routing
from ..sources import versions


def read_examples(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New JSON-lines files under path, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def route_stream(examples: DataFrame, out: str, checkpoint: str, strict: bool = True) -> StreamingQuery:
    """Each example in a folder for its route (``reason``; usable: the default partition), every file once.

    The file sink commits a batch's files as a whole, and the checkpoint tells which batches are done.
    """
    routed = routing.route(examples, strict)
    return routed.writeStream.format("parquet").partitionBy("reason").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(stream: DataFrame, predict, out: str, checkpoint: str) -> StreamingQuery:
    """predict(batch) appended under out, a folder for each batch.

    A batch that is run again replaces its own folder, so a crash between the write and the
    checkpoint neither loses nor repeats a row.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        predict(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(stream: DataFrame, predict, path: str, checkpoint: str) -> StreamingQuery:
    """predict(batch) as batches of the append log under path: see sources.versions. A batch that is run again after its commit adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        versions.append(predict(batch), path, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

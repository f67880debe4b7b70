"""An event log that a stream appends to exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns that tell where a row came from: the stream's name and the number of its batch.
STREAM, BATCH = "stream_name", "batch_id"


def append_once(stream: DataFrame, path: str, checkpoint: str, *, name: str, fmt: str = "json", after=None) -> None:
    """Runs a stream over what is there and appends it to the log at path, each batch exactly once.

    A batch is written under its stream's name and its number, which a batch that is replayed after a
    failure has again: it takes the place of what it wrote before.  So a rerun with the same name and checkpoint
    adds nothing twice, whether the driver died before, while or after a batch was written.  Use another
    name with another checkpoint.  `after(batch id)` is called when a batch is written.
    """
    if "/" in name or "=" in name:
        raise ValueError("the name of a stream is a folder's")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path}/{STREAM}={name}/{BATCH}={batch_id}")
        if after:
            after(batch_id)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def log(spark: SparkSession, path: str, schema: str, *, fmt: str = "json") -> DataFrame:
    """The rows of a log, with stream_name and batch_id."""
    return spark.read.format(fmt).schema(f"{schema}, {STREAM} string, {BATCH} long").load(path)

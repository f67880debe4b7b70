"""The run log as a stream: replayed files, and the running best with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BEST = "run string, ord long, loss double, is_best boolean"


def events(spark: SparkSession, path: str, schema: str, *, fmt: str = "json", per_trigger: int = 1) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def _best(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("ord", kind="stable")
    best = state.get[0] if state.exists else float("inf")
    before = rows["loss"].cummin().shift(fill_value=best).clip(upper=best)
    state.update((min(best, rows["loss"].min()),))
    yield rows.assign(is_best=rows["loss"] < before)[["run", "ord", "loss", "is_best"]]


def running_best(stream: DataFrame) -> DataFrame:
    """run, ord, loss, is_best of a stream (run, ord, loss): one number of state for each run, kept across restarts."""
    return stream.groupBy("run").applyInPandasWithState(_best, BEST, "best double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, *, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events a window and type, with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def replay(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, to Parquet, exactly once across restarts with one checkpoint; then reads the result."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

"""Analytics of training logs: events (run, ord, type, step, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_so_far(events: DataFrame, run: str, order: str, loss: str) -> DataFrame:
    """Adds is_best: strictly below every earlier loss of the run."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.min(loss).over(w)
    return events.withColumn("is_best", before.isNull() | (F.col(loss) < before))


def cumulative(events: DataFrame, run: str, order: str, tokens: Column, seconds: Column | None = None) -> DataFrame:
    """Adds tokens_seen and, with seconds elapsed, tok_per_s."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = events.withColumn("tokens_seen", F.sum(tokens).over(w))
    return t if seconds is None else t.withColumn("tok_per_s", F.try_divide(F.col("tokens_seen"), seconds))


def scaling_table(events: DataFrame) -> DataFrame:
    """run, n_params (of the first meta), val_loss (of the last eval), best first by size; runs without either are left out."""
    t = events.groupBy("run").agg(
        F.expr("min_by(n_params, ord) FILTER (WHERE type = 'meta')").alias("n_params"),
        F.expr("max_by(val_loss, ord) FILTER (WHERE type = 'eval')").alias("val_loss"),
    )
    return t.where("n_params IS NOT NULL AND val_loss IS NOT NULL").orderBy("n_params", "val_loss", "run")


def curve(events: DataFrame, kind: str = "train", value: str = "loss") -> DataFrame:
    """run, step, value of the events of one kind; runs without such events don't appear."""
    return events.where(F.col("type") == kind).select("run", "step", F.col(value).alias("value"))


def every(step: Column, k: int, *, from_zero: bool) -> Column:
    return (step % k == 0) if from_zero else (step > 0) & (step % k == 0)


def mean_loss(events: DataFrame, run: str, loss: str) -> DataFrame:
    return events.groupBy(run).agg(F.avg(loss).alias("mean_loss"), F.count(loss).alias("n"))

"""The running best of events that arrive out of order: state, timers and a watermark.

A run's events wait in its state until the watermark has passed them, then they are judged in the order of
(time, ord): so what arrives late within the watermark's delay, in whatever trigger, gives the rows that a batch over
the whole log gives.  Events that are later still are dropped, as for any watermark.  An event over `idle` after the one before it in its run starts the run
anew, however the stream is cut into triggers; so a run that the watermark has left that far behind is forgotten,
state and all.

State is kept in RocksDB, one list and three numbers for each run, so it may exceed memory; a run has one timer for all the
events that wait in it.  TTL exists
for processing time only, so runs expire by event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BEST = "run string, ord long, ts timestamp, loss double, is_best boolean"
WAITING = "at long, ord long, loss double"


class Best(StatefulProcessor):
    """Rows (run, ord, at in milliseconds, loss) of one run; gives (run, ord, ts, loss, is_best)."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.best = handle.getValueState("best", "loss double, at long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        self.waiting.appendList([(int(a), int(o), float(x)) for a, o, x in zip(came["at"], came["ord"], came["loss"], strict=True)])
        self._wake(int(came["at"].min()))
        yield from ()

    def _wake(self, at: int) -> None:
        """A timer for the earliest event that waits: it fires in the trigger in which that event's own would, and all that the watermark has passed are judged then."""
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self.due.exists() and self.due.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.due.clear()
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        ready = [x for x in waiting if x[0] <= passed]
        if len(ready) < len(waiting):
            self._wake(waiting[len(ready)][0])
        best, last = self.best.get() if self.best.exists() else (float("inf"), None)
        if ready:
            if len(ready) < len(waiting):
                self.waiting.put(waiting[len(ready) :])
            else:
                self.waiting.clear()
            found = []
            for at, _, loss in ready:
                if last is not None and at - last > self.idle:
                    best = float("inf")
                found.append(loss < best)
                best, last = min(best, loss), at
            self.best.update((best, last))
            self.handle.registerTimer(last + self.idle + 1)
            ts = pd.to_datetime([x[0] for x in ready], unit="ms", utc=True)
            yield pd.DataFrame({"run": key[0], "ord": [x[1] for x in ready], "ts": ts, "loss": [x[2] for x in ready], "is_best": found})
        elif not waiting and last is not None and passed - last > self.idle:
            self.best.clear()

    def close(self) -> None:
        pass


def running_best(stream: DataFrame, *, delay: str = "10 minutes", idle: timedelta = timedelta(days=1)) -> DataFrame:
    """run, ord, ts, loss, is_best of a stream (run, ord, ts, loss), each event once the watermark has passed it.

    is_best: strictly below every earlier loss of the run.  Events without a run, time or loss are left out.
    The session keeps state in RocksDB from here on.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    t = stream.dropna(subset=["run", "ord", "ts", "loss"]).withWatermark("ts", delay)
    t = t.select("run", "ord", "ts", F.unix_millis("ts").alias("at"), F.col("loss").cast("double").alias("loss"))
    return t.groupBy("run").transformWithStateInPandas(Best(int(idle.total_seconds() * 1000)), BEST, "append", "EventTime")

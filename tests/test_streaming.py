"""Out-of-order events with state and timers, and the log that is appended to exactly once."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import runlog
from corpusloom.streaming import ordered, sink
from corpusloom.streaming import runlog as stream

SCHEMA = "run string, ord long, ts timestamp, loss double"
T0 = datetime(2026, 1, 1)


def files(spark, path, *triggers):
    for k, rows in enumerate(triggers):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{path}/{k:03d}")


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{path}/*")


def event(run, o, minutes, loss):
    return (run, o, T0 + timedelta(minutes=minutes), loss)


def test_out_of_order_over_triggers_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [event(run, i, i, round(rng.random(), 6)) for run in "abc" for i in range(40)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 8))  # late by less than the delay
    close = [event("z", 0, 10_000, 1.0)]
    files(spark, tmp_path / "in", mixed[:30], mixed[30:75], mixed[75:], close, [event("z", 1, 10_001, 1.0)])
    t = ordered.running_best(source(spark, str(tmp_path / "in")), delay="20 minutes")
    got = stream.replay(t, str(tmp_path / "out"), str(tmp_path / "mark")).where("run <> 'z'")
    batch = runlog.best_so_far(spark.createDataFrame(rows, SCHEMA), "run", "ord", "loss")
    assert sorted(map(tuple, got.select("run", "ord", "ts", "loss", "is_best").collect())) == sorted(map(tuple, batch.select("run", "ord", "ts", "loss", "is_best").collect()))


def test_a_restart_goes_on_with_the_state(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    runs = [[event("a", 2, 2, 4.0), event("a", 1, 1, 5.0)], [event("a", 3, 3, 4.5), event("a", 4, 4, 3.0)], [event("z", 0, 500, 1.0)], [event("z", 1, 501, 1.0)]]
    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{path}/{k}")
        got = stream.replay(ordered.running_best(source(spark, path), delay="1 minute"), out, mark)
    assert sorted((r.ord, r.is_best) for r in got.where("run = 'a'").collect()) == [(1, True), (2, True), (3, False), (4, True)]


def test_idle_runs_are_forgotten(spark, tmp_path):
    rows = [[event("a", 1, 0, 1.0), event("b", 1, 0, 1.0)], [event("b", 2, 50, 2.0)], [event("z", 0, 100, 1.0)], [event("b", 3, 110, 3.0), event("a", 2, 110, 2.0)], [event("z", 1, 400, 1.0)], [event("z", 2, 401, 1.0)]]
    files(spark, tmp_path / "in", *rows)
    t = ordered.running_best(source(spark, str(tmp_path / "in")), delay="1 minute", idle=timedelta(minutes=60))
    got = {(r.run, r.ord): r.is_best for r in stream.replay(t, str(tmp_path / "out"), str(tmp_path / "mark")).collect()}
    assert got[("a", 1)] and got[("b", 1)] and not got[("b", 2)]
    assert not got[("b", 3)]  # within an hour of its last event
    assert got[("a", 2)]  # a new life


def test_events_without_values_are_left_out(spark, tmp_path):
    rows = [event("a", 1, 1, None), event(None, 1, 1, 1.0), ("a", 2, None, 1.0), event("a", 3, 2, 2.0)]
    files(spark, tmp_path / "in", rows, [event("z", 0, 900, 1.0)], [event("z", 1, 901, 1.0)])
    got = stream.replay(ordered.running_best(source(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert [(r.run, r.ord) for r in got.where("run = 'a'").collect()] == [("a", 3)]


@pytest.mark.parametrize("fail", ["after", "while"])
def test_a_replayed_batch_is_appended_once(spark, tmp_path, fail):
    path, mark = str(tmp_path / "log"), str(tmp_path / "mark")
    rows = [[event("a", 10 * k + i, k, 1.0) for i in range(10)] for k in range(4)]
    files(spark, tmp_path / "in", *rows)

    def die(batch_id):
        if batch_id == 2:
            raise RuntimeError("the driver is gone")  # the batch is written, its number isn't in the checkpoint yet

    with pytest.raises(Exception, match="driver is gone"):
        sink.append_once(source(spark, str(tmp_path / "in")), path, mark, name="train", after=die)
    if fail == "while":  # half of it
        spark.createDataFrame(rows[2][:3], SCHEMA).write.mode("overwrite").json(f"{path}/stream_name=train/batch_id=2")
    sink.append_once(source(spark, str(tmp_path / "in")), path, mark, name="train")
    sink.append_once(source(spark, str(tmp_path / "in")), path, mark, name="train")
    got = sink.log(spark, path, SCHEMA)
    assert sorted(r.ord for r in got.collect()) == list(range(40))
    assert {r.batch_id for r in got.select("batch_id").distinct().collect()} == {0, 1, 2, 3}
    files(spark, tmp_path / "in", [], [], [], [], [event("a", 99, 9, 1.0)])
    sink.append_once(source(spark, str(tmp_path / "in")), path, mark, name="train")
    assert sink.log(spark, path, SCHEMA).where(F.col("ord") == 99).count() == 1


def test_streams_share_a_log(spark, tmp_path):
    files(spark, tmp_path / "in", [event("a", 1, 1, 1.0)])
    for name in ("x", "y"):
        sink.append_once(source(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / f"mark-{name}"), name=name)
    assert sorted(r.stream_name for r in sink.log(spark, str(tmp_path / "log"), SCHEMA).collect()) == ["x", "y"]
    with pytest.raises(ValueError):
        sink.append_once(source(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "m"), name="a/b")


def test_a_run_has_one_timer_for_all_its_events(monkeypatch):
    """A trigger costs a run a few calls of the state store, however many events wait in it."""

    class Value:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

        put = update
        clear = lambda self: self.update(None)
        appendList = lambda self, more: self.update((self.v or []) + more)

    class Handle:
        timers: set = set()
        registered = 0

        getListState = getValueState = lambda self, *a: Value()

        def registerTimer(self, at):
            self.registered += 1
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

    class Now:
        def __init__(self, at):
            self.at = at

        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.at

    handle, best, got = Handle(), ordered.Best(10**9), []
    best.init(handle)
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["at", "ord", "loss"])])
    for rows, mark in (([(at, at, -float(at)) for at in range(1000, 2000)], 1499), ([(1600, 7, 9.0), (1550, 8, 9.0)], 1550), ([], 5000)):
        if rows:
            list(best.handleInputRows(("a",), frame(rows), Now(0)))
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(at)
            got += [o for out in best.handleExpiredTimer(("a",), Now(mark), Now(at)) for o in out["ord"]]
    assert sorted(got) == sorted([*range(1000, 2000), 7, 8]) and handle.registered < 20

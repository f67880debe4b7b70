"""Completions through a journal: every key is asked for once, whatever fails."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import journal


def prompts(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("qid"), F.concat(F.lit("p"), "id").alias("prompt"))


def counting(folder, fail_at=None, no=()):
    """A provider that notes every prompt it is asked, and breaks down at one."""
    folder = str(folder)

    def ask(batch):
        import os
        import uuid

        if fail_at in batch:
            raise RuntimeError("the service is gone")
        for p in batch:
            with open(os.path.join(folder, f"{p}-{uuid.uuid4().hex}"), "w") as f:
                f.write(p)
        return [None if p in no else f"re {p}" for p in batch]

    return ask


def calls(folder):
    return sorted(f.split("-")[0] for f in os.listdir(folder))


def test_two_runs_ask_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    path, ask = str(tmp_path / "journal"), counting(tmp_path / "calls")
    df, asked = journal.complete(prompts(spark, 50), "qid", ask, path, batch=7)
    assert asked == 50 and df.count() == df.where("completion = concat('re ', prompt)").count() == 50
    df.collect()
    assert calls(tmp_path / "calls") == sorted(f"p{i}" for i in range(50))
    df, asked = journal.complete(prompts(spark, 80, 3), "qid", ask, path)
    assert asked == 30 and df.count() == 80
    assert calls(tmp_path / "calls") == sorted(f"p{i}" for i in range(80))


def test_a_run_that_fails_is_resumed(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    path = str(tmp_path / "journal")
    with pytest.raises(Exception, match="service is gone"):
        journal.complete(prompts(spark, 200), "qid", counting(tmp_path / "calls", fail_at="p77"), path, batch=1, parallel=2)
    before = len(calls(tmp_path / "calls"))
    df, asked = journal.complete(prompts(spark, 200), "qid", counting(tmp_path / "calls"), path, batch=1, parallel=2)
    assert df.where("completion = concat('re ', prompt)").count() == 200
    assert 0 < asked <= 200 - before + 2  # the journal has what was answered
    seen = calls(tmp_path / "calls")
    assert set(seen) == {f"p{i}" for i in range(200)} and len(seen) == before + asked
    assert len(seen) == 200  # nobody was asked twice


def test_an_attempt_skips_what_an_earlier_one_wrote(spark, tmp_path):
    """A task's second attempt, replayed by hand: the same run and partition."""
    (tmp_path / "calls").mkdir()
    path = str(tmp_path / "journal")
    rows = prompts(spark, 20, 1).select(F.col("qid").cast("string").alias("key"), F.md5("prompt").alias("digest"), F.lit(0).alias("k"), "prompt")
    first = journal._asking(counting(tmp_path / "calls", fail_at="p11"), path, "run", 1)
    with pytest.raises(Exception, match="service is gone"):
        rows.mapInArrow(first, "asked long").collect()
    second = journal._asking(counting(tmp_path / "calls"), path, "run", 1)
    assert rows.mapInArrow(second, "asked long").first().asked == 9
    assert calls(tmp_path / "calls") == sorted(f"p{i}" for i in range(20))


def test_changed_prompts_failures_and_repeats(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    path = str(tmp_path / "journal")
    df, asked = journal.complete(prompts(spark, 6), "qid", counting(tmp_path / "calls", no=("p2", "p3")), path, k=2)
    assert asked == 12 and df.where("completion IS NULL").count() == 4
    _, asked = journal.complete(prompts(spark, 6), "qid", counting(tmp_path / "calls"), path, k=2)
    assert asked == 0
    df, asked = journal.complete(prompts(spark, 6), "qid", counting(tmp_path / "calls"), path, k=2, retry_failed=True)
    assert asked == 4 and df.where("completion IS NULL").count() == 0
    changed = prompts(spark, 6).withColumn("prompt", F.when(F.col("qid") == 1, "new").otherwise(F.col("prompt")))
    twice = changed.union(changed).withColumn("k", F.lit("x")).withColumn("a.b", F.lit("y")).drop("k")
    df, asked = journal.complete(twice, "qid", counting(tmp_path / "calls"), path)
    assert asked == 1 and df.count() == 12 and {r.completion for r in df.where("qid = 1").collect()} == {"re new"}


def test_null_prompts_and_none_at_all(spark, tmp_path):
    path = str(tmp_path / "journal")
    rows = spark.createDataFrame([(None, None), (1, None), (2, "")], "qid long, prompt string")
    df, asked = journal.complete(rows, "qid", lambda b: [None if p is None else f"<{p}>" for p in b], path)
    assert asked == 3 and df.count() == 3
    df, asked = journal.complete(rows.limit(0), "qid", lambda b: b, str(tmp_path / "other"))
    assert asked == 0 and df.collect() == []

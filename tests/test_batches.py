"""Batches under a token budget."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chat


def rows(spark, sizes, parts=4):
    return spark.createDataFrame([(k, [1] * n) for k, n in enumerate(sizes)], "key long, ids array<int>").repartition(parts)


@pytest.mark.parametrize("step", [1, 16, 50])
def test_budget_padding_and_order(spark, step):
    rng = random.Random(step)
    sizes = [rng.choice([0, 1, 2, 3, 7, 30, 100, 255, 700]) + rng.randrange(3) for _ in range(1500)]
    df = rows(spark, sizes).withColumn("h", F.lit("x")).withColumn("width", F.lit("y"))
    t = chat.budget_batches(df, F.size("ids"), F.col("key"), 512, step=step)
    assert t.columns == ["key", "ids", "h", "width", "batch", "batch_order"]
    got = t.collect()
    assert sorted(r.key for r in got) == list(range(1500)) and {(r.h, r.width) for r in got} == {("x", "y")}
    batches = {}
    for r in got:
        batches.setdefault(r.batch, []).append(len(r.ids))
    for b in batches.values():
        assert len(b) == 1 or max(b) * len(b) <= 512
        assert max(b) - min(b) < max(step, 8)
    padding = sum(max(b) * len(b) - sum(b) for b in batches.values()) / sum(sizes)
    assert padding < 0.1
    full = {}
    for name, b in batches.items():
        full.setdefault(name.split("-")[0], []).append(len(b))
    for n in full.values():
        assert sum(x < max(n) for x in n) <= 1  # all batches of a width but one are full
    order = {r.batch: r.batch_order for r in got}
    assert len(set(order.values())) == len(order)
    by_order = [max(batches[b]) for b in sorted(order, key=order.get)]
    assert by_order != sorted(by_order)
    again = chat.budget_batches(df.repartition(7), F.size("ids"), F.col("key"), 512, step=step, digits=1)
    assert {(r.key, r.batch, r.batch_order) for r in again.collect()} == {(r.key, r.batch, r.batch_order) for r in got}


def test_one_width_that_holds_all_rows_is_many_tasks(spark):
    t = chat.budget_batches(spark.range(0, 200_000, 1, 8), F.col("id") % 3 + 97, F.col("id"), 1120)
    sizes = [r["count"] for r in t.groupBy("batch").count().collect()]
    assert sum(sizes) == 200_000 and set(sizes) == {10}  # one width, 112
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Window \[row_number\(\).*\], \[width#\d+L?, bin#\d+\]", plan)


def test_no_rows(spark):
    assert chat.budget_batches(rows(spark, [1]).limit(0), F.size("ids"), F.col("key"), 10).collect() == []


def test_padding_keeps_columns_of_any_names(spark):
    df = rows(spark, [2, 0, 5]).select("key", "ids", F.lit("x").alias("n"), F.lit("y").alias("__n"), F.lit(1).alias("batch"), F.lit("z").alias("row"))
    t = chat.pad_batches(df, "ids", "batch")
    assert t.columns == [*df.columns, "attention_mask"]
    assert sorted((r.key, r.ids, r.attention_mask, r.n, r["__n"], r.row) for r in t.collect()) == [(k, [1] * n + [0] * (5 - n), [1] * n + [0] * (5 - n), "x", "y", "z") for k, n in enumerate((2, 0, 5))]

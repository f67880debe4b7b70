"""Selection of any number of rows: by threshold, against a sort."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sample


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("k", [0, 1, 7, 300, 999, 1000, 1001, 1 << 40])
def test_simple_takes_the_least_hashes(spark, k):
    df = spark.range(1000)
    want = sorted(sorted(range(1000), key=lambda i: md5("42", i))[:k])
    assert ids(sample.simple(df, k, F.col("id"))) == want


def test_fewer_digits_mean_more_passes(spark, monkeypatch):
    monkeypatch.setattr(sample, "DIGITS", 1)
    want = sorted(sorted(range(3000), key=lambda i: md5("s", i))[:1234])
    assert ids(sample.simple(spark.range(3000), 1234, F.col("id"), seed="s")) == want


def test_two_million_rows_come_from_all_tasks(spark):
    df = spark.range(0, 2_000_000, 1, 16)
    got = sample.simple(df, 800_000, F.col("id"))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 800_000
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert got.agg(F.max(F.md5(F.concat_ws("|", F.lit("42"), "id")))).first()[0] < df.join(got, "id", "left_anti").agg(F.min(F.md5(F.concat_ws("|", F.lit("42"), "id")))).first()[0]


def test_rebalance_and_mix_in_of_many_rows(spark):
    df = spark.range(0, 200_000, 1, 8).withColumn("ood", F.col("id") % 11 == 0)
    got = sample.rebalance(df, "ood", 0.2, F.col("id"))
    yes = 200_000 // 11 + 1
    quota = int(yes * (1 - 0.2) / 0.2)
    assert got.where("ood").count() == yes and got.where("NOT ood").count() == quota
    want = sorted((i for i in range(200_000) if i % 11), key=lambda i: md5("42", i))[:quota]
    assert ids(got.where("NOT ood")) == sorted(want)
    assert got.rdd.getNumPartitions() == 8
    mixed = sample.mix_in(df.select("id"), spark.range(500_000, 900_000), 0.5, F.col("id"))
    assert ids(mixed) == [*range(200_000), *range(500_000, 600_000)]


def test_a_quota_over_two_to_the_31(spark):
    df = spark.range(100).withColumn("ood", F.col("id") < 3)
    assert sample.rebalance(df, "ood", 1e-10, F.col("id")).count() == 100
    assert sample.mix_in(spark.range(4), spark.range(50), 1e12, F.col("id")).count() == 54


@pytest.mark.parametrize("k", [1, 99, 100, 101, 250, 399])
def test_ties_and_repeated_rows_are_exact(spark, monkeypatch, k):
    monkeypatch.setattr(sample, "COPIES", 7)
    rows = [("a", i) for i in range(100)] + [("b", 1)] * 250 + [(None, i) for i in range(50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, v long").repartition(5)
    for got in (sample.simple(df, k, F.col("key")), sample.first(df, k, F.col("key"))):
        got = [tuple(r) for r in got.collect()]
        assert len(got) == k
        for r in set(got):
            assert got.count(r) <= rows.count(r)
    least = sorted(rows, key=lambda r: md5("42", r[0]) if r[0] is not None else md5("42"))[:k]
    assert sorted(r[0] or "" for r in least) == sorted(r.key or "" for r in sample.simple(df, k, F.col("key")).collect())
    in_order = sorted(r[0] or "" for r in rows)[:k]
    assert in_order == sorted(r.key or "" for r in sample.first(df, k, F.col("key")).collect())


@pytest.mark.parametrize("settled", [1, 10])
def test_first_rows_by_several_columns(spark, monkeypatch, settled):
    monkeypatch.setattr(sample, "SETTLED", settled)
    monkeypatch.setattr(sample, "PIVOTS", 5)
    rng = random.Random(settled)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["x", "y", None]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string, id long")
    plain = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))
    for k in (1, 33, 200, 399, 400, 500):
        got = sample.first(df, k, F.col("a"), F.col("b"), F.col("id")).collect()
        assert {r.id for r in got} == {r[2] for r in plain[:k]} and len(got) == min(k, 400)


def test_empty_and_clashing(spark):
    df = spark.range(0).withColumn("a.b", F.lit(1))
    assert sample.simple(df, 5, F.col("id")).collect() == []
    assert sample.first(df, 5, F.col("id")).collect() == []
    more = spark.range(40).withColumn("a.b", F.lit(1)).withColumn("h", F.lit("x")).withColumn("key", F.lit("y")).withColumn("k0", F.lit(2))
    assert sample.simple(more, 9, F.col("id")).columns == more.columns
    assert ids(sample.first(more, 9, F.col("id"))) == list(range(9))

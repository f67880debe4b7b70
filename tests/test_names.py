"""Helper columns never touch the user's, and numbering in many ranges."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import clean, expand, sample

NAMES = ("__rn", "__k0", "__h", "__bin", "__s", "__b", "__n", "__before", "__part", "__key", "__range", "m", "a.b", "__RN_")


def frame(spark, n=60):
    return spark.range(n).withColumn("g", F.col("id") % 4).select("id", "g", *(F.lit(x).alias(x) for x in NAMES))


def untouched(df, got):
    assert got.columns[: len(df.columns)] == df.columns
    rows = got.collect()
    assert all(r[x] == x for r in rows for x in NAMES)
    return rows


def test_columns_of_any_names_stay(spark):
    df = frame(spark)
    assert len(untouched(df, clean.first_wins(df, [F.col("g")], [F.col("id")]))) == 4
    assert len(untouched(df, clean.stratified_split(df, "g", F.col("id")))) == 60
    assert len(untouched(df, sample.head_per_group(df, "g", 3, F.col("id")))) == 12
    assert len(untouched(df, sample.stratified(df, "g", 8, F.col("id")))) == 8
    assert sorted(r["ord"] for r in untouched(df, expand.numbered(df, F.col("id")))) == list(range(60))


def test_numbers_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sample, "SETTLED", 100)
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), f"{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    t = expand.numbered(df, F.col("a"), F.col("b"), start=7, parts=12)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.a, r.b) for r in sorted(t.collect(), key=lambda r: r.ord)] == want
    assert sorted(r.ord for r in t.collect()) == list(range(7, 3007))
    assert expand.numbered(df.limit(0), F.col("a")).collect() == []

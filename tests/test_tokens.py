"""Windows of the packed stream, its sketch, and offsets beside columns of any names."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import tokens


def stream(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows, flat = [], []
    for k, n in enumerate(sizes):
        ids = [rng.randrange(1000) for _ in range(n)]
        rows.append((k, len(flat), ids))
        flat += ids
    return spark.createDataFrame(rows, "key long, start long, ids array<int>").repartition(3), flat


def test_windows_cross_documents(spark):
    df, flat = stream(spark, [5, 0, 1, 300, 2, 2, 2, 2, 40, 700, 0, 9])
    got = tokens.random_windows(df, "ids", 50, 400, width=64).collect()
    assert sorted(r.draw for r in got) == list(range(400))
    for r in got:
        assert 0 <= r.place < len(flat) - 51
        assert r.inputs == flat[r.place : r.place + 50] and r.targets == flat[r.place + 1 : r.place + 51]
    assert len({r.place for r in got}) > 200


def test_windows_stay_in_their_part(spark):
    df, flat = stream(spark, [100] * 20)
    got = tokens.random_windows(df, "ids", 10, 300, lo=1500, hi=1700, seed="7").collect()
    assert {r.place for r in got} <= set(range(1500, 1689)) and max(r.place for r in got) > 1650
    again = tokens.random_windows(df.repartition(5), "ids", 10, 300, lo=1500, hi=1700, seed="7", width=11)
    assert sorted(map(tuple, ((r.draw, r.place, tuple(r.inputs)) for r in again.collect()))) == sorted((r.draw, r.place, tuple(r.inputs)) for r in got)
    with pytest.raises(ValueError):
        tokens.random_windows(df, "ids", 10, 3, lo=1990)
    with pytest.raises(ValueError):
        tokens.random_windows(df.limit(0), "ids", 10, 3)


def test_no_token_is_exploded(spark):
    df, _ = stream(spark, [100] * 20)
    plan = tokens.random_windows(df, "ids", 10, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == 1 and "explode(sequence(" in plan  # rows to the blocks they touch


def test_the_mean_of_batches_means(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0)], "b int, loss double")
    assert tuple(tokens.estimate(df, F.col("loss"), F.col("b")).first()) == (6.0, 2)


@pytest.mark.parametrize("kinds", [50, 4000])
def test_the_sketch_is_near_the_exact_share(spark, kinds):
    rng = random.Random(kinds)
    rows, start = [], 0
    for _ in range(200):
        w = [str(rng.randrange(kinds)) for _ in range(rng.randrange(300))]
        rows.append((start, w))
        start += len(w)
    df = spark.createDataFrame(rows, "start long, w array<string>")
    for n in (1, 2, 3):
        exact = tokens.corpus_distinct_n(df, "w", n, block=64).first().distinct_n
        got = tokens.corpus_distinct_n_sketch(df, "w", n, block=64).first()
        assert abs(got.distinct_n - exact) <= 4 * got.error * exact
    assert tokens.corpus_distinct_n_sketch(df.limit(0), "w", 2).first().distinct_n == 0.0


def test_sketches_can_be_united(spark):
    df, _ = stream(spark, [200] * 10)
    parts = [tokens.corpus_distinct_n_sketch(df.where(c), "ids", 1) for c in ("key < 5", "key >= 5")]
    both = parts[0].union(parts[1]).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).first().n
    exact = df.select(F.explode("ids").alias("x")).distinct().count()
    assert abs(both - exact) <= 0.05 * exact


def test_offsets_carry_columns_of_any_names(spark):
    names = ("part", "within", "of", "base", "size", "row", "__part", "__in", "__of", "__base", "__size", "a.b")
    df = spark.range(100).select("id", *(F.lit(n).alias(n) for n in names))
    got = tokens.with_offsets(df, F.lit(2), "id", parts=7)
    assert got.columns == [*df.columns, "start"]
    for r in got.collect():
        assert r.start == 2 * r.id and all(r[n] == n for n in names)


def test_long_hashes(spark):
    got = [r.h for r in spark.range(100).select(T.hash_long("s", F.col("id")).alias("h")).collect()]
    assert len(set(got)) == 100 and all(0 <= h < 1 << 60 for h in got) and max(got) > 1 << 58


def test_a_task_encodes_few_texts_at_once(spark, monkeypatch):
    """Memory of a task doesn't grow with the rows of an Arrow batch."""
    import json

    import pandas as pd
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    got, most = [], []

    class Counted:
        from_str = staticmethod(lambda text: Counted())

        def encode_batch_fast(self, texts, **how):
            most.append(len(texts))
            return tok.encode_batch_fast(texts, **how)

    monkeypatch.setattr("tokenizers.Tokenizer", Counted)
    monkeypatch.setattr(tokens.F, "pandas_udf", lambda kind: lambda f: got.append(f) or (lambda c: c))
    tokens.bpe_encode(spark.range(1).withColumn("text", F.lit("a")), json.dumps({}))
    texts = ["a b " * (k % 5) for k in range(1000)] + [None]
    out = pd.concat(list(got[0](iter([pd.Series(texts)]))))
    assert [list(x) for x in out] == [[0, 1] * (k % 5) for k in range(1000)] + [[]] and max(most) <= tokens.AT_ONCE

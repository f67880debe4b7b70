"""Lazy first rows, and files merged in one scan."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, writers


def test_first_rows_read_no_more_files_than_needed(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).withColumn("text", F.concat(F.lit("t"), "id"))
    df.repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(path)
    given = len(spark.read.parquet(path).inputFiles())
    for n in (1, 30, 399, 1000):
        got = readers.first_stories(spark, path, n)
        assert sorted(r.id for r in got.collect()) == list(range(n))
        assert got.columns == ["id", "text"]
        if n < 400:
            assert len(got.inputFiles()) < given / 2
    assert readers.first_stories(spark, path, 0).collect() == []
    with pytest.raises(ValueError, match="fewer"):
        readers.first_stories(spark, path, 1001)


def test_row_counts_come_from_the_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    plan = spark.read.parquet(path).groupBy("_metadata.file_path").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_files_with_differing_columns(spark, tmp_path):
    (tmp_path / "one file.v2.jsonl").write_text('{"q": "a", "source": "s"}\n\n{"q": "b", "other": 1}\n')
    (tmp_path / "two.jsonl").write_text('{"a": "x"}\n')
    writers.jsonl(spark.createDataFrame([("c", "ä")], "q string, a string").repartition(2), str(tmp_path / "three.jsonl"))
    paths = [str(tmp_path / n) for n in ("one file.v2.jsonl", "two.jsonl", "three.jsonl")]
    t = readers.extra_files(spark, paths, "q string, a string, source string")
    assert sorted(((r.origin, r.q, r.a, r.source) for r in t.collect()), key=repr) == sorted([("one file.v2", "a", None, "s"), ("one file.v2", "b", None, None), ("two", None, "x", None), ("three", "c", "ä", None)], key=repr)
    assert t._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    base = spark.createDataFrame([("z", "seed", 5)], "q string, origin string, extra int")
    both = readers.with_extras(base, paths, "q string, a string, source string")
    assert both.count() == 5 and both.where("origin = 'seed'").first().extra == 5
    assert readers.with_extras(base, []).collect() == base.collect()

"""The data source of flat token files: ranges of bytes, commits, aborts."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, token_source, writers


def frame(spark, n, per_row=10):
    return spark.range(0, n, 1, 4).select(F.col("id").alias("block_id"), F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda i: (F.col("id") * per_row + i).cast("int")).alias("ids"))


def stream(df):
    return [x for r in df.orderBy("place").collect() for x in r.ids]


def test_round_trip_in_stretches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.token_file(frame(spark, 500), path) == 5000
    df = token_source.read(spark, path, block=7, stretch=64)
    rows = df.orderBy("place").collect()
    assert [x for r in rows for x in r.ids] == list(range(5000))
    assert all(len(r.ids) <= 7 for r in rows) and rows[0].start == 0
    assert df.rdd.getNumPartitions() >= 5000 * 2 // 64  # a partition for each range of bytes
    raw = b"".join((tmp_path / "t" / f["name"]).read_bytes() for f in token_source.manifest(path)["files"])
    assert raw == np.arange(5000, dtype="<u2").tobytes()


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    for mode in ("append", "append", "overwrite", "append"):
        token_source.write(frame(spark, 3).select("ids").coalesce(1), path, mode=mode, dtype="<u4")
    m = token_source.manifest(path)
    assert (m["dtype"], m["tokens"], len(m["files"])) == ("<u4", 60, 2)
    assert sorted(f for f in os.listdir(path) if f.endswith(".bin")) == sorted(f["name"] for f in m["files"])
    assert stream(readers.token_file(spark, path, 100)) == [*range(30), *range(30)]


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = frame(spark, 400).withColumn("ids", F.when(F.col("block_id") == 399, F.array(F.lit(70000))).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="fit"):
        token_source.write(bad.select("ids"), path)
    assert not [f for f in os.listdir(path) if not f.startswith(".")]
    with pytest.raises(Exception, match="no token files"):
        readers.token_file(spark, path, 10).collect()
    writers.token_file(frame(spark, 5), path)
    with pytest.raises(Exception, match="fit"):  # what was there stays
        token_source.write(bad.select("ids"), path)
    assert stream(readers.token_file(spark, path, 10)) == list(range(50))
    assert token_source.manifest(path)["tokens"] == 50


def test_drafts_of_a_dead_job_are_not_read(spark, tmp_path):
    path = tmp_path / "t"
    writers.token_file(frame(spark, 5), str(path))
    (path / "_drafts-x").mkdir()
    (path / "_drafts-x" / "0-1").write_bytes(b"\1\0")
    (path / "part-99999-x.bin").write_bytes(b"\1\0")  # moved, but its manifest wasn't written
    assert stream(readers.token_file(spark, str(path), 10)) == list(range(50))


def test_files_made_elsewhere(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.bin").write_bytes(np.arange(k * 10, k * 10 + 10, dtype="<u4").tobytes())
    assert stream(readers.token_file(spark, str(tmp_path), 4, dtype="<u4")) == list(range(30))
    assert stream(readers.token_file(spark, str(tmp_path / "f1.bin"), 4, dtype="<u4")) == list(range(10, 20))


def test_no_ids(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.token_file(frame(spark, 5).limit(0), path) == 0
    assert readers.token_file(spark, path, 10).collect() == []
    more = frame(spark, 5).withColumn("x", F.lit(1)).withColumn("a.b", F.lit("y"))
    token_source.write(more, path)
    assert sorted(stream(readers.token_file(spark, path, 10))) == list(range(50))


def test_a_file_shorter_than_its_manifest_is_an_error(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.token_file(frame(spark, 5).coalesce(1), path)
    (name,) = {f["name"] for f in token_source.manifest(path)["files"]}
    with open(f"{path}/{name}", "r+b") as f:
        f.truncate(51)
    with pytest.raises(Exception, match="shorter"):
        readers.token_file(spark, path, 10).collect()
    assert json.loads((tmp_path / "t" / token_source.MANIFEST).read_text())["tokens"] == 50

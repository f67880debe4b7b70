"""Readers of JSONL samples, run logs, sidecars and token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.expand import QA, union_all
from corpusloom.sources import token_source

EVENT = "type string, step int, loss double, lr double, tok_per_s double, train_loss double, val_loss double, text string, n_params bigint, config map<string,string>"


def jsonl(spark: SparkSession, path: str | Sequence[str], schema: str = QA) -> DataFrame:
    """Rows of JSONL paths; blank lines are skipped, anything unparsable is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def first_rows(rows: DataFrame, limit: int, order: str) -> DataFrame:
    """The first `limit` rows by order; the limit is tested after a row is taken, so 0 still gives one."""
    return rows.orderBy(order).limit(max(limit, 1))


def first_stories(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n rows of a Parquet path, in the order of files' names and of rows within them; an error where there are fewer.

    Files' row counts come from their footers, since no column is read; only files that hold some of the rows are
    scanned, and the last of them is cut by its rows' numbers.
    """
    counts = spark.read.parquet(path).groupBy("_metadata.file_path").count().orderBy("file_path").collect()
    chosen, before = [], 0
    for r in counts:
        if before >= n:
            break
        chosen.append((r.file_path, n - before))
        before += r["count"]
    if before < n:
        raise ValueError(f"the source has fewer than {n} rows")
    schema = spark.read.parquet(path).schema
    if not chosen:
        return spark.createDataFrame([], schema)
    last, left = chosen[-1]
    return spark.read.schema(schema).parquet(*(f for f, _ in chosen)).where((F.col("_metadata.file_path") != last) | (F.col("_metadata.row_index") < left))


def parquet_sample(spark: SparkSession, path: str, n: int) -> DataFrame:
    """At most n rows of a corpus: a limit that stops the scan."""
    return spark.read.parquet(path).limit(n)


def extra_files(spark: SparkSession, paths: Sequence[str], schema: str = QA) -> DataFrame:
    """Rows of all JSONL paths in one scan, each with origin, the stem of its file or, for a folder of part files, of the folder.

    schema: all columns that any of them has; those that a file lacks are null there, those that it has beside them are left out.
    """
    t = jsonl(spark, list(paths), schema).select("*", F.col("_metadata.file_path").alias("origin"))
    name = T.base_name(F.col("origin"))
    of = F.when(name.startswith("part-"), T.parent_name(F.col("origin"))).otherwise(name)
    return t.withColumn("origin", F.url_decode(F.regexp_replace(of, r"\.[^.]*$", "")))


def with_extras(samples: DataFrame, paths: Sequence[str], schema: str = QA) -> DataFrame:
    """samples and further files, each counted under its stem (origin)."""
    return union_all([samples, extra_files(samples.sparkSession, paths, schema)]) if paths else samples


def run_logs(spark: SparkSession, glob: str, schema: str = EVENT) -> DataFrame:
    """Events of all logs that match, with run (the parent folder's name), path, and ord within the file."""
    t = spark.read.schema(schema).json(glob).select("*", "_metadata.file_path", "_metadata.file_block_start")
    return t.withColumns({"run": T.parent_name(F.col("file_path")), "ord": F.monotonically_increasing_id()}).drop("file_block_start").withColumnRenamed("file_path", "path")


def sidecar(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object spread over lines; a missing file is an error."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def token_file(spark: SparkSession, path: str, block: int, *, dtype: str | None = None) -> DataFrame:
    """path, start, place, ids of flat binary token files: `block` ids a row, each task reading its own bytes alone.

    dtype: of an id; where there is no manifest that says it, two bytes.
    """
    return token_source.read(spark, path, block=block, **({"dtype": dtype} if dtype else {}))


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)

"""Completions that survive: a journal of answered prompts in shared storage.

Each answer is written by the task that got it, in files of some FLUSH answers, so neither a
task that fails nor a job that does loses more than that.  A run asks only for what the journal lacks, a task that is
tried again only for what its earlier attempts haven't written, and the result is read from the journal:
using it twice asks nobody.

An entry is (key, digest of the prompt, k): a prompt that has changed is a new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.generators import Provider
from corpusloom.sources.token_source import local_uri

ENTRY = "key string, digest string, k int, completion string"
FLUSH = 1024


def entries(spark: SparkSession, path: str) -> DataFrame:
    """key, digest, k, completion of all that has been answered; none where there is no journal yet."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(local_uri(path))
    found = system.get_file_info(folder).type == fs.FileType.Directory
    if not found:
        return spark.createDataFrame([], ENTRY)
    t = spark.read.schema(ENTRY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    return t.groupBy("key", "digest", "k").agg(F.max("completion").alias("completion"))


def _asking(provider: Provider, path: str, run: str, batch: int):
    """The job of a task: asks for its rows (key, digest, k, prompt) and writes the answers; gives their number."""
    schema = pa.schema([("key", pa.string()), ("digest", pa.string()), ("k", pa.int32()), ("completion", pa.string())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(local_uri(path))
        folder = f"{root.rstrip('/')}/{run}/{task.partitionId()}"
        system.create_dir(folder, recursive=True)
        earlier = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".parquet")]
        done = {tuple(r.values()) for f in earlier for r in pq.read_table(f, filesystem=system, columns=["key", "digest", "k"]).to_pylist()}
        waiting: list[tuple] = []
        asked = files = 0

        def flush() -> None:
            nonlocal files
            if waiting:
                table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)
                draft = f"{folder}/_draft-{task.taskAttemptId()}"
                pq.write_table(table, draft, filesystem=system)
                system.move(draft, f"{folder}/{task.taskAttemptId()}-{files}.parquet")
                files += 1
                waiting.clear()

        try:
            for b in batches:
                rows = [r for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[:3] not in done]
                for lo in range(0, len(rows), batch):
                    part = rows[lo : lo + batch]
                    answers = provider([r[3] for r in part])
                    waiting += [(*r[:3], a) for r, a in zip(part, answers, strict=True)]
                    asked += len(part)
                    if len(waiting) >= FLUSH:
                        flush()
        finally:
            flush()
        yield pa.RecordBatch.from_pydict({"asked": pa.array([asked], pa.int64())})

    return ask


def complete(prompts: DataFrame, key: str, provider: Provider, path: str, *, k: int = 1, batch: int = 64, parallel: int | None = None, retry_failed: bool = False) -> tuple[DataFrame, int]:
    """(prompts with k and completion, number of prompts asked for): k rows for each of prompts (prompt, and a column `key` that tells them apart).

    Completions that failed are null; they are asked for again with retry_failed.  At most `parallel` tasks ask at a time.
    Rows with one key and prompt are asked for once.
    """
    spark = prompts.sparkSession
    digest = F.md5(F.coalesce("prompt", F.lit("")))
    t = prompts.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), digest.alias("digest"), "prompt")
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    entry = ["key", "digest", "k"]
    known = entries(spark, path)
    pending = t.select(*entry, "prompt").join(known.where("completion IS NOT NULL") if retry_failed else known, entry, "left_anti").dropDuplicates(entry)
    pending = pending.repartition(parallel, *entry) if parallel else pending.repartition(*entry)
    asked = pending.mapInArrow(_asking(provider, path, uuid.uuid4().hex, batch), "asked long").agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
    return t.join(entries(spark, path), entry, "left").select("row.*", "k", "completion"), asked

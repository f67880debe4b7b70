"""Writers of JSONL, JSON documents, reports, logs and token blocks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import token_source


def jsonl(rows: DataFrame, path: str, *, by: str | None = None) -> None:
    """JSONL, UTF-8 unescaped, null fields left out; one folder for each value of `by`."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def text_file(spark: SparkSession, text: str, path: str) -> None:
    """One UTF-8 file wherever Spark writes."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def document(row: DataFrame, path: str) -> None:
    """A one-row frame as an indented JSON object."""
    r = row.limit(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
    text_file(row.sparkSession, json.dumps(json.loads(r.j) if r else {}, ensure_ascii=False, indent=2), path)


def markdown(spark: SparkSession, text: str, path: str) -> None:
    text_file(spark, text + "\n", path)


def table_text(rows: DataFrame, columns: dict[str, int]) -> DataFrame:
    """line: the columns as strings, padded to their widths."""
    return rows.select(F.concat_ws(" ", *(F.rpad(F.col(c).cast("string"), n, " ") for c, n in columns.items())).alias("line"))


def token_blocks(blocks: DataFrame, path: str) -> None:
    """(block_id, ids) as Parquet, one range of ids to a file."""
    blocks.repartitionByRange("block_id").sortWithinPartitions("block_id").write.mode("overwrite").parquet(path)


def token_file(blocks: DataFrame, path: str, dtype: str = "<u2") -> int:
    """(block_id, ids) as flat binary files, one after the other the stream, behind a manifest.  Returns the tokens written."""
    token_source.write(blocks.repartitionByRange("block_id").sortWithinPartitions("block_id").select("ids"), path, dtype=dtype)
    return token_source.manifest(path)["tokens"]

"""From raw documents to token files: five stages, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the
columns of `documents`.  `run` writes each stage's result to shared storage and reads it
back, so that a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from corpusloom.llm.common import materialize, shared_dir, small_batches, table, temporary


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score the threshold or more go; `labels` teach the network."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link to each other, the one with the smallest doc_id stays."""
    return ngram_join.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of `benchmark` are cut out; documents of which they are more than half go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says, in whole copies."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files; doc_id, start, n_tokens and ids_crc32 as read back from them."""
    path = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(docs, path, token_files.default_tokenizer())
    return token_files.read_digests(spark, path)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: A trained network and an entropy coder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  When a stage ends, what it wrote for itself and the documents that it was given are deleted; the token files stay."""
    docs = table(spark, sf_dir, "documents")
    with temporary(spark) as clear:
        for name, stage in STAGES[:-1]:
            with small_batches(spark):
                docs = materialize(stage(spark, docs, sf_dir), name)
            clear()
        return STAGES[-1][1](spark, docs, sf_dir)

"""The pipeline's stages, one after the other, against brute force on what each was given."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from corpusloom.llm import mixing, token_files, toxicity
from corpusloom.llm.common import materialize, shared_dir

from .cases import PROSE, docs, odd_texts
from .test_decontaminate import brute as brute_hits
from .test_ngram_join import brute as brute_links

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in cp.STAGES[:-1]:
        out = materialize(stage(spark, tables[-1], SF), name)
        assert out.columns == docs.columns
        tables.append(out)
    rows = [t.collect() for t in tables]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    want = [r for r in rows[0] if toxicity.score_texts(model, [(r.text or "").encode()])[0] < toxicity.THRESHOLD]
    assert Counter(want) == Counter(rows[1])
    first = {i for i, _, c in brute_links([(r.doc_id, r.text) for r in rows[1]]) if i == c}
    assert {r.doc_id for r in rows[2]} == first
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {r.doc_id: brute_hits(r.text, items) for r in rows[2]}
    assert {r.doc_id for r in rows[3]} == {i for i, h in hits.items() if 2 * h[1] <= h[0]}
    before = {r.doc_id: r.text for r in rows[2]}
    for r in rows[3]:
        assert (r.text == before[r.doc_id]) == (not hits[r.doc_id][4]) and r.n_chars == len(r.text)
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(tables[3]).collect()}
    assert Counter(r.doc_id for r in rows[4]) == +Counter(copies)
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    ids = [(r.doc_id, np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4")) for r in rows[4]]
    got = cp.STAGES[-1][1](spark, tables[4], SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    shared = shared_dir(spark)
    before = set(os.listdir(shared))
    assert cp.run(spark, SF).count() == len(got)
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and next(iter(left)).startswith("token-files-")  # nothing else stays


NAMES = ("row", "copy", "n", "of", "rate", "spans", "items", "key", "salt", "component", "least", "__text", "__spans", "__n", "__of", "score", "size", "source_size", "bucket", "data", "a.b", "c0", "c1", "row.text", "TEXT", "Doc_Id")


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_take_odd_rows_and_clashing_names(spark, name, stage):
    rows = [*odd_texts(), (4, PROSE), (50, "long " * 30_000)]
    d = docs(spark, rows)
    d = d.select("*", *(F.lit(f"own {c}").alias(c) for c in NAMES))
    for given in (d, d.limit(0), docs(spark, [(1, None)])):
        out = stage(spark, given, SF)
        got = out.collect()
        if name == "token_files":
            assert len(got) == given.count()
            continue
        assert out.columns == given.columns
        if given is d:
            assert got and all(r[d.columns.index(c)] == f"own {c}" for r in got for c in NAMES)
            assert {r[0] for r in got} <= {i for i, _ in rows}
        elif given.count() == 0:
            assert got == []

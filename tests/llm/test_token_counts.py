"""Operator 13 against the library."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpusloom.llm import token_counts as C
from tests.llm.cases import docs, odd_texts

LETTERS = " ▁\n\t abcdeéüΩ漢字😀１ ​ﬁ<s>/the.,09\x00﻿̀-_"


@pytest.fixture(scope="module")
def model():
    with open(C.default_model(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_random_texts(model, library):
    c, rng = C.TokenCounter(model), random.Random(5)
    for _ in range(5000):
        t = "".join(rng.choices(LETTERS, k=rng.randrange(50)))
        assert c.count(t) == len(library.encode(t)), t


def test_marks_are_text(model, library):
    c = C.TokenCounter(model)
    for t in ("<s> </s> <unk>", "<0x41><0xFF>", "<|endoftext|>", " <s>", "</s></s>", "▁▁", " ", "퟿", "\x00"):
        assert c.count(t) == len(library.encode(t)), t


def test_initial_symbols_minus_merges(model):
    c = C.TokenCounter(model)
    assert c.merged("▁the") == 1  # four symbols, three merges
    assert c.merged("▁") == 1
    assert c.merged("Ａ") == 3 and c.merged("\n") == 1  # bytes, which never merge
    assert c.count("") == 0


def test_long_texts_in_parts(model, library, monkeypatch):
    rng = random.Random(9)
    texts = ["a" * 20000, "x y" * 9000, " " * 20000, "".join(rng.choices("abcdefghij", k=20000)), " ".join("".join(rng.choices("thein", k=rng.randrange(9))) for _ in range(9000))]
    monkeypatch.setattr(C, "AT_ONCE", 1000)
    c = C.TokenCounter(model)
    for t in texts:
        assert len(list(c.parts(t))) >= 1 and "".join(c.parts(t)) == t
        assert c.count(t) == len(library.encode(t))


def test_memory_of_counts_is_bounded(model, library, monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 50)
    c, rng = C.TokenCounter(model), random.Random(2)
    for _ in range(200):
        t = " ".join("".join(rng.choices("abcdefg", k=rng.randrange(1, 100))) for _ in range(20))
        assert c.count(t) == len(library.encode(t))
        assert len(c.known) <= 50 and len(c.known.older) <= 50
        assert max(map(len, c.known), default=0) <= C.LONGEST


def test_every_row(spark, library):
    texts = [*odd_texts(), (4, "repeated id"), (4, "repeated id"), (50, "word " * 5000)]
    d = docs(spark, texts).withColumn("a.b", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("over_limit", F.lit(0))
    got = C.count_tokens(d, C.default_model(), limit=1000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 1000) for i, t in texts]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert C.count_tokens(docs(spark, []), C.default_model()).collect() == []


def test_the_query_over_its_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = C.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)

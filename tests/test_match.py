"""Keywords in texts: the automaton and the join of grams against each other and plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import match

TEXTS = [(1, "the price of tea"), (2, None), (3, ""), (4, "a 😀b漢字c and thethethe"), (5, "xyz" * 50), (6, "product 0012 and product 001"), (7, "the price of tea")]
WORDS = ["tea", "the", "he", "", "漢字", "😀b", "product 0012", "product 001", "xyzxyzxyzx", "nothing of it", "price of tea", None, "tea", "e"]


def both(rows, words, key="id"):
    for held in (1 << 30, 0):
        yield {r[key]: r.found for r in match.found(rows, "text", key, words, "w", held=held).collect()}


def test_both_ways_find_the_same(spark):
    rows = spark.createDataFrame(TEXTS, "id long, text string").withColumn("found", F.lit("x")).drop("found").withColumn("a.b", F.lit(1))
    words = spark.createDataFrame([(w,) for w in WORDS], "w string")
    want = {i: sorted({w for w in WORDS if w is not None and w in t}) if t is not None else [] for i, t in TEXTS}
    for got in both(rows, words):
        assert got == want
    assert match.found(rows, "text", "id", words, "w", held=0).columns == ["id", "text", "a.b", "found"]


@pytest.mark.parametrize("words", [[], [""], ["abc"]])
def test_few_keywords(spark, words):
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    for got in both(rows, spark.createDataFrame([(w,) for w in words], "w string")):
        assert got == {i: [w for w in words if t is not None and w in t] for i, t in TEXTS}
    for got in both(rows.limit(0), spark.createDataFrame([("a",)], "w string")):
        assert got == {}


def test_a_hundred_thousand_names(spark):
    rng = random.Random(8)
    words = [f"item {rng.randrange(10**7)}" for _ in range(60_000)] + ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 12))) for _ in range(40_000)]
    texts = []
    for i in range(150):
        t = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(rng.randrange(300)))
        texts.append((i, t + " ".join(rng.choices(words, k=i % 4))))
    rows, table = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "w string")
    first, second = both(rows, table)
    assert first == second
    known = set(words)
    for i, t in texts[:40]:
        assert first[i] == sorted({t[a : a + n] for n in range(3, 14) for a in range(len(t)) if t[a : a + n] in known})


def test_a_gram_that_all_share_is_dealt(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("the same words "), F.col("id")).alias("text"))
    words = spark.createDataFrame([("the same words",), ("same words 29",)], "w string")
    got = {r.id: r.found for r in match.found(rows, "text", "id", words, "w", held=0).collect()}
    assert all(got[i] == (["same words 29"] if str(i).startswith("29") else []) + ["the same words"] for i in range(300))


def test_grams_that_are_no_keywords_are_not_shuffled(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choices("abcdefgh é😀", k=2000)) + ("the keyword" if i % 2 else "")) for i in range(50)] + [(50, ""), (51, "keyword"), (52, "k")]
    t = spark.createDataFrame(texts, "key long, text string")
    sieve = match._sieve(spark.createDataFrame([("keyword",), ("😀é",)], "gram string"))
    got = match._held(t, [2, 7], sieve)
    want = {(i, w) for i, x in texts for w in ("keyword", "😀é") if w in x}
    rows = {(r.key, r.gram) for r in got.collect()}
    assert want <= rows and len(rows - want) < 50 and got.count() == len(rows)


def test_a_chunk_of_texts_meets_a_gram_once(spark):
    t = spark.range(500).select((F.col("id") % 2).alias("key"), F.concat(F.lit("another keyword "), F.col("id")).alias("text"))
    sieve = match._sieve(spark.createDataFrame([("keyword",), ("another",)], "gram string"))
    assert sorted((r.key, r.gram) for r in match._held(t, [7], sieve).collect()) == [(k, w) for k in (0, 1) for w in ("another", "keyword")]


def test_many_chunks_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(match, "CHUNK", 100)
    rng = random.Random(5)
    texts = [(i if i else None, "".join(rng.choices("ab é😀", k=rng.randrange(60))) if i % 9 else None) for i in range(1, 80)] + [(None, "abab and é")]
    words = ["".join(rng.choices("ab é😀", k=rng.randrange(1, 14))) for _ in range(300)] + ["and"]
    rows = spark.createDataFrame(texts, "id long, text string").withColumn("for", F.make_interval(days=F.lit(2)))
    keywords = spark.createDataFrame([(w,) for w in words], "w string")
    want = {i: sorted({w for w in words if t is not None and w in t}) for i, t in texts}
    for t in (rows, rows.drop("for").select("text", "id")):
        got = match.found(t, "text", "id", keywords, "w", held=0)
        assert got.columns == [*t.columns, "found"] and got.count() == len(texts)
        assert {r.id: r.found for r in got.select("id", "found").collect()} == want


def test_words_across_what_is_looked_at_at_once(monkeypatch):
    monkeypatch.setattr(match, "AT_ONCE", 64)
    monkeypatch.setattr(match, "HASHED", 16)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abc\0é", k=k)) for k in (0, 1, 500, 7, 0, 90, 15, 16, 17, 64)]
    words = sorted({"".join(rng.choices("abc\0é", k=rng.randrange(1, 12))) for _ in range(200)} | {texts[2][40:300], texts[5], texts[2] + "x"})
    begin = [rng.randrange(max(1, len(w) - 7)) for w in words]
    everything = np.full(1 << 17, 255, np.uint8)
    held = match._Words([(w, w[b : b + 8]) for w, b in zip(words, begin, strict=True)], everything, 20)
    got = set()
    for first, _, _, codes in match._blocks(texts):
        row = first + np.cumsum(codes == match.BORDER)
        got.update((int(r), words[w]) for at, which in held.found(codes) for r, w in zip(row[at], which, strict=True))
    assert got == {(i, w) for i, t in enumerate(texts) for w in words if w in t}


def test_grams_of_one_hash_are_all_kept(monkeypatch):
    """Keywords are compared by characters, whatever the hashes say."""
    monkeypatch.setattr(match, "MIX", np.uint32(0))
    words, text = ["hat", "the", "tea"], "the tea"
    held = match._Words([(w, w) for w in words], np.full(1 << 17, 255, np.uint8), 20)
    assert {sorted(words)[w] for _, _, _, codes in match._blocks([text]) for _, which in held.found(codes) for w in which} == {"the", "tea"}

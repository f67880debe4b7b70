"""Operator 9 against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join as nj
from corpusloom.llm.components import components

from .cases import PROSE, docs, odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """doc_id -> (n_shingles, component_id), rows with one doc_id being one document."""
    sets, parent = [], {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {k: k for k in range(len(sets))}
    for x, (i, s) in enumerate(sets):
        for y, (j, u) in enumerate(sets[:x]):
            if (i == j and i is not None) or s and u and 100 * len(s & u) >= 75 * len(s | u):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    out = []
    for x, (i, s) in enumerate(sets):
        ids = [sets[y][0] for y in range(len(sets)) if find(y) == find(x) and sets[y][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=str)


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        k = rnd.randrange(len(w))
        w[k : k + rnd.randrange(2)] = [rnd.choice(words), f"new{rnd.randrange(99)}"][: rnd.randrange(3)]
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_chains_and_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 7)
    monkeypatch.setattr(nj, "BUCKET", 500)
    monkeypatch.setattr(nj, "HOT_LOCAL", 6)
    rnd = random.Random(seed)
    vocab = [f"v{k}" for k in range(400)]
    passage = " ".join(rnd.choices(vocab, k=60))
    rows = []
    for _ in range(12):
        base = rnd.choices(vocab, k=rnd.choice([4, 6, 9, 20, 80, 200]))
        rows += [edited(rnd, base, rnd.choice([0, 0, 1, 2, 5, 9])) for _ in range(rnd.choice([1, 2, 9, 25]))]
        chain = list(base)
        for _ in range(6):  # each similar to the last, the ends not
            chain = chain + rnd.choices(vocab, k=max(1, len(chain) // 7))
            chain = chain[max(1, len(chain) // 9) :]
            rows.append(" ".join(chain))
    rows += [passage + " " + " ".join(rnd.choices(vocab, k=rnd.choice([5, 20, 60]))) for _ in range(30)]
    rnd.shuffle(rows)
    rows = list(enumerate(rows, 100))
    got = sorted((tuple(r) for r in nj.near_duplicates(docs(spark, rows).repartition(5)).drop("key").collect()), key=str)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_odd_rows(spark):
    rows = odd_texts() + [(4, PROSE), (50, "other words entirely"), (50, PROSE + " tail"), (51, "OTHER\twords\nentirely"), (None, "nobody has this one"), (None, "Nobody has this one"), (-1, "one"), (60, "Ä B"), (61, "ä b")]
    d = docs(spark, rows).withColumn("n", F.lit("x")).withColumn("key", F.lit(1))
    got = sorted((tuple(r) for r in nj.near_duplicates(d).drop("key").collect()), key=str)
    assert got == brute(rows)
    kept = nj.deduplicate(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, _, c in brute(rows) if i == c and i is not None}
    assert nj.near_duplicates(d.limit(0)).count() == 0


def test_prefixes_of_similar_sets_meet():
    rnd = np.random.default_rng(0)
    for n in [1, 2, 3, 4, 5, 7, 8, 11, 13, 30, 100]:
        for _ in range(30):
            x = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
            take, add = rnd.integers(0, n - nj.up(n) + 1), rnd.integers(0, n // 3 + 1)
            y = np.unique(np.r_[rnd.permutation(x)[take:], rnd.integers(0, 1 << 62, add).astype(np.uint64)])
            both = len(np.intersect1d(x, y))
            if 100 * both < 75 * (len(x) + len(y) - both):
                continue
            hot = np.sort(rnd.permutation(np.union1d(x, y))[: rnd.integers(0, n + 1)])
            for o in nj.ORDERS:
                common = len(np.intersect1d(nj.prefix(x, o, hot), nj.prefix(y, o, hot)))
                assert common >= max(nj.needed(len(x)), nj.needed(len(y))) >= 1


def test_needed_of_a_column(spark):
    df = spark.range(0, 3000).select("id", nj.needed_of(F.col("id")).alias("x"))
    assert all(r.x == nj.needed(r.id) for r in df.collect())


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

"""Operator 7: the chain against enumeration, and held-out accuracy."""

import itertools
import time

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import line_quality as lq

from .cases import PROSE, docs, odd_texts


def test_marginals_are_those_of_all_labellings():
    rnd = np.random.default_rng(0)
    text = np.repeat([0, 1, 2, 5], [1, 4, 2, 6])
    u, trans = rnd.normal(0, 2, len(text)), rnd.normal(0, 1, (2, 2))
    p, pairs, z = lq.marginals(u, text, trans)
    want_pairs = np.zeros((2, 2))
    for c, log in zip(np.unique(text), z, strict=True):
        at = np.flatnonzero(text == c)
        labellings = list(itertools.product([0, 1], repeat=len(at)))
        score = np.array([sum(u[i] * v for i, v in zip(at, ys, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(ys)) for ys in labellings])
        share = np.exp(score - score.max())
        share /= share.sum()
        assert np.isclose(log, np.log(np.exp(score).sum()))
        for k, i in enumerate(at):
            assert np.isclose(p[i], sum(s for s, ys in zip(share, labellings, strict=True) if ys[k]))
        for s, ys in zip(share, labellings, strict=True):
            for a, b in itertools.pairwise(ys):
                want_pairs[a, b] += s
    assert np.allclose(pairs, want_pairs)


def test_gradient():
    lines = lq.Lines([b"a b c\n\nHELLO!! X\nnt nt nt nt", "Öl | x | y\n".encode(), b"", b"one\ntwo\nthree three\none"])
    rnd = np.random.default_rng(1)
    x = lines.features()
    y, w, t = rnd.integers(0, 2, len(x)), rnd.normal(0, 0.5, x.shape[1]), rnd.normal(0, 0.5, (2, 2))
    base, gw, gt = lq.likelihood(w, t, x, lines.text, y)
    for k in range(len(w)):
        up = w.copy()
        up[k] += 1e-5
        assert np.isclose(gw[k], (lq.likelihood(up, t, x, lines.text, y)[0] - base) / 1e-5, atol=1e-3)
    up = t.copy()
    up[0, 1] += 1e-5
    assert np.isclose(gt[0, 1], (lq.likelihood(w, up, x, lines.text, y)[0] - base) / 1e-5, atol=1e-3)


def test_line_features():
    lines = lq.Lines([b"AB cd!\nAB cd!\nx x x x", b"", b"y\n", "ö".encode()])
    assert lines.text.tolist() == [0, 0, 0, 2, 3] and lines.size.tolist() == [6, 6, 7, 1, 2]
    assert lines.own[:, 12].tolist() == [0, 1, 0, 0, 0]  # repeats of earlier lines
    assert lines.own[2, 10] == 0.75 and lines.own[2, 11] == 0.25


def test_texts_of_many_lines_are_learnt_from():
    good = [f"{PROSE} {k}\n" * 2 + "a calm line.\n" * 200 for k in range(12)]
    bad = [f"### $$$ {k}\n" * 2 + "BUY!! | NOW\n" * 200 for k in range(12)]
    short = [PROSE, "### $$$ x"]
    model = lq.fit([*good, *bad, *short], [1] * 12 + [0] * 12 + [0, 1], rounds=30)
    scores = lq.score_texts(model, [good[0].encode(), bad[0].encode()])
    assert scores[0] > 0.5 > scores[1]


def test_lines_may_be_of_another_kind_than_their_document():
    good, bad = "a calm river runs by the old trees.", "$$$ BUY!! NOW | ###"
    texts = [f"{good}\n" * 2 + f"{bad}\n" * 10 for _ in range(20)] + [f"{good}\n" * 8 + bad for _ in range(20)] + [f"{good}\n{good} {k}" for k in range(20)]
    y = [0] * 20 + [1] * 40
    model = lq.fit(texts, y)
    lines = lq.Lines([texts[0].encode(), texts[20].encode()])
    p, _, _ = lq.marginals(lines.features() @ model["w"] + model["b"][0], lines.text, model["trans"])
    assert p[0] > 0.5 > p[2:12].max() and p[12:20].min() > 0.5 > p[20]
    scores = lq.score_texts(model, [t.encode() for t in texts])
    assert scores[:20].max() < 0.3 < scores[20:].min()


def test_relabelling_leaves_each_document_its_kind():
    y, text = np.array([0, 0, 0, 1, 1, 1, 0]), np.array([0, 0, 0, 1, 1, 1, 2])
    p, size = np.array([0.99, 0.9, 0.95, 0.05, 0.5, 0.99, 0.99]), np.array([4.0, 9, 4, 1, 5, 5, 3])
    assert lq.relabelled(p, y, text, size).tolist() == [1, 0, 1, 0, 1, 1, 0]


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = lq.query(spark, "/root/testdata/sf0.1")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert out.count() == 10000 and len(rows) > 600
    assert sum(r.predicted != r.quality for r in rows) < 0.01 * len(rows)


def test_odd_rows(spark):
    d = docs(spark, odd_texts() + [(4, PROSE)]).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 0), (8, None), (None, 1), (11, 0), (11, 1), (99, 1)], "doc_id long, quality int")
    rows = lq.scored(d, lq.train(d, labels)).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in lq.scored(d, lq.train(d, labels.limit(0))).collect()} == {0.0}
    assert lq.scored(d.limit(0), lq.train(d.limit(0), labels)).count() == 0


def test_long_chains_are_those_advanced_line_by_line(monkeypatch):
    rnd = np.random.default_rng(5)
    text = np.repeat(np.arange(6), [1, 7, 300, 64, 65, 2])
    u, trans = rnd.normal(0, 5, len(text)), rnd.normal(0, 1.5, (2, 2))
    whole = lq.marginals(u, text, trans)
    for n in (1, 2, 8, 64):
        monkeypatch.setattr(lq, "SEGMENT", n)
        for a, b in zip(lq.marginals(u, text, trans), whole, strict=True):
            assert np.allclose(a, b, atol=1e-9)


def test_one_word_a_line_takes_no_step_for_each():
    m = {"w": np.linspace(-1, 1, 3 * lq.OWN + 3), "b": np.zeros(1), "trans": np.array([[1.0, -1], [-1, 1]]), "platt": np.array([1.0, 0.0])}
    began = time.process_time()
    lq.score_texts(m, [b"word\n" * 800_000])
    assert time.process_time() - began < 12  # 4 MB; with a step a line it took 32 s

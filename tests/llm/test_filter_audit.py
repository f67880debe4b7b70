"""Operator 12 against a plain replay of every order."""

import itertools
import random

import pyarrow as pa
import duckdb
from pyspark.sql import functions as F

from corpusloom.llm import filter_audit as A
from tests.llm.cases import docs, odd_texts

BLANKS = " \t\n\x0b\x0c\r"
LABELS = "doc_id long, quality int, toxic int"


def words(t):
    for b in BLANKS:
        t = t.replace(b, " ")
    return [w for w in t.split(" ") if w]


def replay(rows, labels):
    """Each order step by step over rows (doc_id, text, lang)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    marked = {k: {i for i, q, x in labels if i is not None and (q if k == "good" else x) == 1} for k in ("good", "toxic")}
    parts = {}
    for i, t, lang in rows:
        t, w = t or "", words(t or "")
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i,
        }
        parts.setdefault(lang or "", []).append(({k for k, v in fails.items() if v}, i in marked["good"], i in marked["toxic"]))
    out = []
    for part, ds in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = ds
            for step, f in enumerate(order, 1):
                hit, stay = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                shapley[f] += len(hit)
                steps.append((f, (part, "".join(order), step, len(stay), len(hit), sum(f in d[0] for d in ds) - len(hit), sum(d[0] == {f} for d in ds), sum(d[1] for d in hit), sum(d[2] for d in hit))))
                left = stay
        out += [(*r, shapley[f]) for f, r in steps]
    return sorted(out)


COLS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def case():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    texts = list(odd_texts())
    for i in range(20, 80):
        n = rng.choice([0, 5, 99, 100, 101, 300])
        t = " ".join(rng.choices(vocab[: rng.choice([5, 60, 400])], k=n)) + rng.choice(["", "", " #", "\n|"])
        texts.append((i, t.upper() if rng.random() < 0.2 else t))
    texts += [(200 + k, texts[-k][1]) for k in range(1, 20)]  # copies
    texts += [(205, texts[30][1]), (None, texts[20][1]), (None, texts[20][1]), (30, None)]  # repeated and null ids
    texts += [texts[25], texts[25], texts[26]]  # repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 240, 2)] + [(None, 1, 1), (999, 1, 1), (30, 1, 0), (30, 0, 1)]
    return texts, labels


def test_every_order_and_step(spark):
    texts, labels = case()
    d = docs(spark, texts)
    rows = [(r.doc_id, r.text, r.lang) for r in d.collect()]
    lab = spark.createDataFrame(labels, LABELS)
    want = replay(rows, labels)
    assert len(want) == 2 * 600
    assert got(A.audit(d, lab)) == want
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows]), "lang": pa.array([r[2] for r in rows])}))
    con.register("labels", pa.table({n: pa.array([r[k] for r in labels], pa.int64()) for k, n in enumerate(("doc_id", "quality", "toxic"))}))
    res = con.execute(A.SQL)
    at = [[x[0] for x in res.description].index(c) for c in COLS]
    assert sorted(tuple(r[k] for k in at) for r in res.fetchall()) == want


def test_clashing_columns_change_nothing(spark):
    texts, labels = case()
    d, lab = docs(spark, texts), spark.createDataFrame(labels, LABELS)
    want = got(A.audit(d, lab))
    for name in ("h", "t", "part", "word", "pos", "first", "copies", "good", "a.b", "no_id"):
        d, lab = d.withColumn(name, F.lit("x")), lab.withColumn(name, F.lit("y"))
    assert got(A.audit(d, lab)) == want


def test_empty_tables(spark):
    texts, labels = case()
    none, lab = docs(spark, []), spark.createDataFrame(labels, LABELS)
    assert got(A.audit(none, lab)) == []
    d = docs(spark, texts)
    unlabelled = got(A.audit(d, lab.limit(0)))
    assert unlabelled == [(*r[:7], 0, 0, r[9]) for r in got(A.audit(d, lab))]


def test_one_long_text(spark):
    n = 400_000
    d = docs(spark, [(1, " ".join(f"w{k}" for k in range(n))), (2, "w " * n)])
    rows = {r.part: r for r in A.audit(d, spark.createDataFrame([], LABELS)).where("filter_order = 'BACDE' AND step = 1").collect()}
    assert (rows["en"].kept, rows["en"].removed) == (1, 1)

"""Operator 11 against every sequence of edits of small conversations, and against its SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import conversation_repair as C

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
BLANKS = " \t\n\x0b\x0c\r"


def fault_of(rows, k):
    role, text = rows[k]
    if not text.strip(BLANKS):
        return "blank"
    if (role, text) in rows[:k]:
        return "duplicate"
    return None if text.rstrip(BLANKS)[-1] in ".!?" else "truncated"


def brute(rows):
    """(cost, audit, repaired) over all edits with at most two inserts at a place."""
    marks = [fault_of(rows, k) for k in range(len(rows))]
    inserts = [(2 * n, "I" * n, list(x)) for n in range(3) for x in itertools.product([("user", ""), ("assistant", "")], repeat=n)]
    options = []
    for (role, text), mark in zip(rows, marks, strict=True):
        more = 1 if mark == "truncated" else 0
        one = [(3, "D", [])]
        if mark in (None, "truncated"):
            one += [(more, "K", [(role, text)]), *((2 + more, "R", [(r, text)]) for r in ("user", "assistant"))]
        options += [inserts, one]
    options.append(inserts)
    best = None
    for way in itertools.product(*options):
        cost, audit = sum(x[0] for x in way), "".join(x[1] for x in way)
        if best is not None and (cost, audit) >= best[:2]:
            continue
        out = [r for x in way for r in x[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
            best = (cost, audit, out)
    return best


def frame(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def sql(rows):
    con = duckdb.connect()
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    conversations = pa.table({n: pa.array(list(c), t) for n, c, t in zip(("conv_id", "turn", "role", "text"), cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)})
    con.register("conversations", conversations)
    res = con.execute(C.SQL)
    names = [d[0] for d in res.description]
    return sorted((tuple(dict(zip(names, r, strict=True)).items()) for r in res.fetchall()), key=repr)


def queried(spark, rows, tmp_path, name="c"):
    frame(spark, rows).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    return [r.asDict() for r in C.query(spark, f"{tmp_path}/{name}").collect()]


def same_as_sql(spark, rows, tmp_path, name="c"):
    got, want = queried(spark, rows, tmp_path, name), sql(rows)
    assert sorted((sorted(r.items()) for r in got), key=repr) == sorted((sorted(r) for r in want), key=repr)
    return {r["conv_id"]: r for r in got}


def test_least_edits_of_small_conversations(spark):
    rng = random.Random(7)
    texts = ["Yes.", "No", "", " \n", "Go on!", "Hm \t"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", ""]
    given = {c: [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 4))] for c in range(120)}
    given |= {1000 + k: [(r, f"{i}.") for i, r in enumerate(x)] for k, x in enumerate(itertools.product(["user", "assistant", "system"], repeat=3))}
    rows = [(c, i, r, t) for c, x in given.items() for i, (r, t) in enumerate(x)]
    got = {r.conv_id: r for r in C.repair(frame(spark, rows)).collect()}
    assert set(got) == set(given)
    for c, x in given.items():
        cost, audit, out = brute(x)
        r = got[c]
        assert (r.cost, r.audit, [tuple(p) for p in r.repaired]) == (cost, audit, out), (c, x)
        marks = [fault_of(x, k) for k in range(len(x))]
        assert (r.blank, r.duplicate, r.truncated) == tuple(marks.count(m) for m in ("blank", "duplicate", "truncated"))
        assert r.illegal == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(x))


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    rows = [
        (None, None, None, None), (None, 3, "user", "Hello."), (1, None, "user", "A."), (1, None, "assistant", "B."), (1, 2, "user", "Same."), (1, 2, "user", "Same."), (1, 2, "assistant", "Same."),
        (2, 5, None, "x"), (2, -3, "user", None), (2, 10, "assistant", "Ω ünï 😀?"), (3, None, "assistant", "Only"), (4, 0, "", "No role."), (5, 9, "User", "Capital."),
        *((6, k, "user", "Again.") for k in range(9)),
    ]
    rows += [(100 + k, k % 3, r, t) for k, (r, t) in enumerate(itertools.product(["user", "assistant", "system", None], ["Fine.", "Cut", "", None, "Why?!", "a.b\n"]))]
    got = same_as_sql(spark, rows, tmp_path)
    assert set(got) == {r[0] for r in rows}


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(8)]
    want = {k: 0 for k in range(5)}
    for c, t, _, _ in rows:
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        if k in want:
            want[k] += 1
    d = C.damage(frame(spark, rows)).collect()
    assert sum(r.gone for r in d) == want[0] > 0
    assert sum(r.text == "" for r in d) == want[1] > 0
    assert sum(r.text == "One Two Three" for r in d) == want[2] > 0
    assert len(d) == len(rows) + want[3] > len(rows)
    assert sum(r.role == "user" for r in d) == want[4] > 0


def test_conversations_that_vanish(spark, tmp_path):
    lost = [(c, t) for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:5]
    got = queried(spark, [(c, t, "user", "Gone.") for c, t in lost], tmp_path)
    assert {r["conv_id"] for r in got} == {c for c, _ in lost}
    for r in got:
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (0, 0, 0, 0, 0, 0, "")
        assert r["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_an_empty_table(spark):
    assert C.repair(frame(spark, [])).collect() == []


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_of_a_fold_change_nothing(spark, monkeypatch, block):
    rng = random.Random(block)
    rows = [(c, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B", "", f"{i}!"])) for c in range(25) for i in range(rng.randrange(1, 24))]
    cols = ["conv_id", "cost", "audit", "repaired"]
    want = sorted(C.repair(frame(spark, rows)).select(cols).collect())
    monkeypatch.setattr(C, "BLOCK", block)
    assert sorted(C.repair(frame(spark, rows)).select(cols).collect()) == want


def test_a_long_conversation(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["A.", f"{i}.", f"{i}", ""])) for i in range(1500)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(1000)]
    same_as_sql(spark, rows, tmp_path)


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C")]
    plain = C.repair(frame(spark, rows)).collect()
    more = frame(spark, rows)
    for name in ("gone", "pos", "fault", "turns", "a.b", "copy", "initial", "audit"):
        more = more.withColumn(name, F.lit("x"))
    assert C.repair(more).collect() == plain
    assert sorted(map(tuple, C.damage(more).collect())) == sorted(map(tuple, C.damage(frame(spark, rows)).collect()))

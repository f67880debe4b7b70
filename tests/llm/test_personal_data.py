"""Operator 6: the patterns as written, the chain against enumeration, and what the field adds."""

import hashlib
import itertools
import re
import time
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import personal_data as pd_

from .cases import PROSE, docs, odd_texts

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def literal(t):
    n = lambda s: sum(c in "0123456789" for c in s)
    out = [(*m.span(), "email") for m in EMAIL.finditer(t)]
    out += [(*m.span(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(t) if 14 <= n(m[0]) <= 19 and pd_.luhn(re.sub("[^0-9]", "", m[0]))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(t) if 10 <= n(m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], ("email", "ip", "card", "phone").index(s[2])))


@given(st.text(alphabet="a@.1-+ ()_é2", max_size=60))
@settings(max_examples=800, deadline=None)
def test_patterns_are_the_literal_ones(t):
    assert pd_.base_spans(t) == literal(t)


def test_patterns_on_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert pd_.base_spans(r.text) == literal(r.text)


def test_long_runs_take_no_square_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "1." * 100_000, "+1 " * 60_000):
        pd_.base_spans(t)


def test_chain_and_viterbi():
    rnd = np.random.default_rng(0)
    e, size, trans = rnd.normal(0, 1, (3, 4, 3)), np.array([4, 1, 3]), rnd.normal(0, 1, (3, 3))
    p, pairs, z = pd_.chain(e, size, trans)
    best, want = pd_.viterbi(e, size, trans), np.zeros((3, 3))
    for i, n in enumerate(size):
        ways = list(itertools.product(range(3), repeat=int(n)))
        s = np.array([sum(e[i, t, y] for t, y in enumerate(ys)) + sum(trans[a, b] for a, b in itertools.pairwise(ys)) for ys in ways])
        q = np.exp(s - np.log(np.exp(s).sum()))
        assert np.isclose(z[i], np.log(np.exp(s).sum()))
        assert tuple(best[i, :n]) == ways[int(s.argmax())]
        for t in range(n):
            assert np.allclose(p[i, t], [sum(q[k] for k, ys in enumerate(ways) if ys[t] == y) for y in range(3)])
        for k, ys in enumerate(ways):
            for a, b in itertools.pairwise(ys):
                want[a, b] += q[k]
    assert np.allclose(pairs, want)


def test_the_field_finds_its_table_and_more():
    model = pd_.fit()
    texts, marks = pd_.read_table()
    base = [pd_.base_spans(t) for t in texts]
    more = pd_.added_spans(model, texts, base)
    for t, m, b, a in zip(texts, marks, base, more, strict=True):
        assert {s for s in a} <= set(m), t
        assert {s for s in m if s[2] in ("email", "ip", "phone")} <= set(a) | set(b), t
    new = "Please phone (305) 555-0188 or mail bob at example dot org, order 12345 of 2021."
    got = {new[a:z] for a, z, _ in pd_.added_spans(model, [new], [[]])[0]}
    assert got == {"(305) 555-0188", "bob at example dot org"}
    plain = "In 2019 some 120 of 340 met at 5, see 3.1.2 and pages 10-12; it cost 1,200.50 then. " + PROSE
    assert pd_.added_spans(model, [plain], [[]]) == [[]]


def test_the_field_finds_secrets_and_mistyped_cards():
    t = 'He said token = "5be1c07f2296d83a44e0f1b7390ac6d8812f9be0" is it; then 6011 or 4485275742308328 came, and sha 7d3f only.'
    got = {(t[a:z], k) for a, z, k in pd_.added_spans(pd_.fit(), [t], [pd_.base_spans(t)])[0]}
    assert ("5be1c07f2296d83a44e0f1b7390ac6d8812f9be0", "secret") in got
    assert not any(k == "secret" for x, k in got if len(x) < 16)


def test_the_field_adds_spans_to_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pd_.find(rows).collect()
    text = {r.doc_id: r.text for r in rows.collect()}
    added = Counter()
    for r in found:
        base = {f"{k}:{a}:{z}" for a, z, k in pd_.base_spans(text[r.doc_id])}
        for s in set(r.spans.split(",")) - base - {""}:
            added[s.split(":")[0]] += 1
    tokens = sum(len(re.findall(r'token = "[0-9a-f]{40}"', t, re.I)) for t in text.values())
    assert tokens > 5 and added["secret"] >= 0.9 * tokens


def test_texts_of_one_long_zone():
    model = pd_.fit()
    phone = "call (305) 555-0188 now "
    numbers = " ".join(str(k * 7919 % 100_000) for k in range(30_000))
    for t in ("1" * 5000 + ".1.1.1", "1.1.1." + "0" * 6000 + "7", "9" * 1_000_000, numbers + " " + phone + numbers):
        base = pd_.base_spans(t)
        more = pd_.added_spans(model, [t], [base])[0]
        if phone in t:
            assert "(305) 555-0188" in {t[a:z] for a, z, _ in more}
    assert [s[2] for s in pd_.base_spans("1.1.1." + "0" * 6000 + "7")] == ["ip"]


def test_windows_label_as_the_whole_does(monkeypatch):
    model = pd_.fit()
    t = " ".join(f"{k} of {k * 31} went, call (305) 555-{1000 + k} now;" for k in range(60))
    whole = pd_.added_spans(model, [t], [[]])
    monkeypatch.setattr(pd_, "WINDOW", 10**6)
    assert pd_.added_spans(model, [t], [[]]) == whole and len(whole[0]) >= 55


def test_rows(spark):
    rows = odd_texts() + [(4, PROSE), (70, "é a.b@c.de, +1 (555) 010-2030; 10.0.0.1 4111 1111 1111 1111 300.1.1.1")]
    d = docs(spark, rows).withColumn("spans", F.lit(1))
    got = pd_.find(d).collect()
    assert len(got) == len(rows)
    for r, (_, t) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.base_sha256)), sorted(rows, key=lambda r: (str(r[0]), hashlib.sha256(pd_.joined(literal(r[1] or "")).encode()).hexdigest())), strict=True):
        base = literal(t or "")
        assert r.base_sha256 == hashlib.sha256(pd_.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in pd_.KINDS]
        assert set(pd_.joined(base).split(",")) <= set(r.spans.split(",")) or not base
    assert pd_.find(d.limit(0)).count() == 0
    assert pd_.redact("x a@b.c y", [(2, 7, "email")]) == "x [email] y"


def test_dense_texts_hash_each_kind_of_token_once():
    model = pd_.fit()
    t = "12 a1b2 3.4, call 55 x@ 2024-01-02 (7) ok9 id=88; " * 20_000
    began = time.process_time()
    pd_.added_spans(model, [t], [pd_.base_spans(t)])
    assert time.process_time() - began < 8  # 1 MB; with a hash for each feature of a token it took 10 s and more

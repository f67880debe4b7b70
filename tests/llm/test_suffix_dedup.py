"""Operator 1 against a set of all strings of earlier documents."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import suffix_dedup as sd
from corpusloom.llm.hashing import PRIME, PRIME_BASE, prefix_hashes, prime_hashes

from .cases import PROSE, docs, odd_texts


def brute(rows, length=50):
    seen: dict[bytes, float] = {}
    rank = [float("inf") if i is None else i for i, _ in rows]
    raws = [(t or "").encode() for _, t in rows]
    for r, b in zip(rank, raws, strict=True):
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            seen[w] = min(r, seen.get(w, r))
    out = []
    for (i, _), r, b in zip(rows, rank, raws, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < r:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@given(st.lists(st.integers(0, 2), min_size=30, max_size=300), st.integers(2, 12))
@settings(max_examples=60, deadline=None)
def test_suffix_sort_orders_suffixes(letters, limit):
    data = np.array(letters + [0] * 12, np.uint8)
    starts = np.arange(len(letters) - limit + 1)
    if not len(starts):
        return
    key = starts % 2
    order = sd.suffix_sort(data, prefix_hashes(data), starts, key, max(8, limit))
    limit = max(8, limit)
    want = sorted(starts.tolist(), key=lambda s: (s % 2, bytes(data[s : s + limit]), s))
    assert [(s % 2, bytes(data[s : s + limit])) for s in starts[order].tolist()] == [(s % 2, bytes(data[s : s + limit])) for s in want]
    doc = (starts * 7) % 5
    got = sd.repeated(data, starts, key, doc, limit)
    for s in starts:
        same = [d for t, d in zip(starts, doc, strict=True) if t % 2 == s % 2 and bytes(data[t : t + limit]) == bytes(data[s : s + limit])]
        assert got[s] == (doc[s] > min(same))


@pytest.mark.parametrize("seed", [0, 1])
def test_copies_passages_and_edges(spark, seed, monkeypatch):
    monkeypatch.setattr(sd, "STRETCH", 2000)
    monkeypatch.setattr(sd, "PIECE", 300)
    monkeypatch.setattr(sd, "FREQUENT", 3 if seed else 2000)
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randrange(1, 6)))
    base = [" ".join(word() for _ in range(rnd.choice([3, 12, 60, 200]))) for _ in range(12)]
    line = " ".join(word() for _ in range(18))[:55]
    rows = []
    for _ in range(60):
        t = rnd.choice(base)
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(t))
            t = t[:k] + rnd.choice(["", "x", line, rnd.choice(base)[:70]]) + t[k + rnd.randrange(3) :]
        rows.append(t)
    rows += ["ab " * 200, "ab " * 90 + "c", "z" * 49, "z" * 50, "z" * 130]
    rows = [(rnd.randrange(1000), t) for t in rows]
    got = sorted((tuple(r) for r in sd.digest(docs(spark, rows).repartition(4)).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = odd_texts() + [(4, PROSE), (4, PROSE + PROSE), (-5, PROSE[:70]), (None, PROSE[:60])]
    d = docs(spark, rows).withColumn("rid", F.lit(1)).withColumn("found", F.lit("x"))
    assert sorted((tuple(r) for r in sd.digest(d).collect()), key=str) == brute(rows)
    assert {r.doc_id for r in sd.remove_repeats(d).collect()} == {i for i, _ in rows}
    assert sd.digest(d.limit(0)).count() == 0


@given(st.binary(min_size=1, max_size=200), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_prime_hashes_do_not_depend_on_the_place(raw, shift):
    data = np.frombuffer(b"q" * shift + raw + b"z", np.uint8)
    want = sum((c + 1) * pow(PRIME_BASE, k, PRIME) for k, c in enumerate(raw)) % PRIME
    for size in (1, 16, 1 << 18):
        assert prime_hashes(data, np.array([shift]), np.array([shift + len(raw)]), size).tolist() == [want]


def test_runs_whose_first_hash_collides_stay_apart(spark, monkeypatch):
    """With the 64-bit hash made blind to all but the length, the verifying hash decides."""
    real = sd.runs

    def blind(data, ends, length=50, k=20):
        anchor, whole, check, first, count = real(data, ends, length, k)
        return anchor, count.astype(np.uint64), check, first, count

    rows = [(i, PROSE[:k] + "X" + PROSE[k + 1 :]) for i, k in enumerate(range(0, len(PROSE), 3))]
    data = b"".join(t.encode() for _, t in rows)
    ends = np.cumsum([len(t.encode()) for _, t in rows])
    anchor, whole, check, first, count = blind(np.frombuffer(data, np.uint8), ends)
    content = [data[f : f + c + 49] for f, c in zip(first.tolist(), count.tolist(), strict=True)]
    assert len(set(zip(anchor.tolist(), whole.tolist(), strict=True))) < len(set(content))
    assert len(set(zip(anchor.tolist(), whole.tolist(), check.tolist(), strict=True))) == len(set(content))
    monkeypatch.setattr(sd, "runs", blind)
    assert sorted((tuple(r) for r in sd.digest(docs(spark, rows)).collect()), key=str) == brute(rows)


def test_what_is_found_does_not_grow_with_documents_times_buckets(spark, monkeypatch):
    """Tables on the way have a row for each bucket, part and kind at most, whatever the number of documents."""
    monkeypatch.setattr(sd, "BUCKET", 64)
    written = []
    real = sd.materialize
    monkeypatch.setattr(sd, "materialize", lambda df, tag: written.append(real(df, tag)) or written[-1])
    rows = [(i, f"{PROSE} {i} {PROSE[: i % 50]}") for i in range(300)]
    assert sorted((tuple(r) for r in sd.digest(docs(spark, rows)).collect()), key=str) == brute(rows)
    runs, ends = written
    buckets = -(-sum(len(t.encode()) for _, t in rows) // (16 * 64))
    assert buckets > 8 and max(runs.count(), ends.count()) <= 2 * 8 * buckets
    assert runs.select("part", "kind").distinct().count() <= 16

"""Operator 4 against a literal search for every window."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from corpusloom.llm import decontaminate as dc

from .cases import PROSE, docs, odd_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items, window=10):
    ws, hit, found = WORD.findall(lower(text)), set(), set()
    for i, t in items:
        it = WORD.findall(lower(t))
        m = min(window, len(it))
        windows = {tuple(it[k : k + m]) for k in range(len(it) - m + 1)} if it else set()
        for k in range(len(ws) - m + 1):
            if m and tuple(ws[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                found.add(i)
    ids = ",".join(sorted(str(i) for i in found if i is not None))
    return len(ws), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_automaton_on_small_alphabets():
    rnd = random.Random(5)
    for trial in range(300):
        window = rnd.choice([2, 3, 4])
        items = [(str(k), [b"abc"[x : x + 1] for x in rnd.choices(range(3), k=rnd.randrange(0, 9))]) for k in range(rnd.randrange(0, 5))]
        m = dc.Matcher(items, window)
        for _ in range(5):
            ws = [b"abcd"[x : x + 1] for x in rnd.choices(range(4), weights=[5, 5, 5, 1], k=rnd.randrange(0, 20))]
            spans, found = m.hits(ws)
            want = brute(" ".join(w.decode() for w in ws), [(i, " ".join(w.decode() for w in t)) for i, t in items], window)
            assert (len(ws), sum(b - a for a, b in spans), len(found)) == want[:3], (items, ws)


def test_rows(spark):
    items = [(1, PROSE), (2, "Seven WISE owls"), (10, "über naïve"), (3, None), (4, ""), (5, "!!"), (6, PROSE + " x y z"), (None, "quick brown fox"), (7, "漢字")]
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = odd_texts() + [(4, PROSE), (40, "a b seven wise, owls... c " + PROSE[:60]), (41, "Öl über-naïve x")]
    d = docs(spark, rows).withColumn("items", F.lit(2)).withColumn("spans", F.lit(3))
    for chars in (1 << 20, 1):  # one shard; a shard for each item
        got = sorted((tuple(r) for r in dc.digest(d, it, max_item_chars=chars).collect()), key=str)
        assert got == sorted(((i, *brute(t, items)) for i, t in rows), key=str)
    assert dc.digest(d, it.limit(0)).where("contaminated").count() == 0
    assert dc.digest(d.limit(0), it).count() == 0


def test_clean_removes_spans_and_drops_leaks(spark):
    item = " ".join(f"w{k}" for k in range(30))
    it = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, PROSE + ". " + item.upper() + "! Then " + PROSE + " and more of it"), (2, item), (3, PROSE), (4, None), (5, ""), (None, PROSE)]
    d = docs(spark, rows).withColumns({c: F.lit(1) for c in ("spans", "items", "row", "__text", "__spans", "__items")})
    out = dc.clean(d, it)
    assert out.schema == d.schema
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 3, 4, 5, None}
    assert got[1].text == PROSE + ". ! Then " + PROSE + " and more of it" and got[1].n_chars == len(got[1].text)
    assert got[3].text == PROSE and got[4].text is None

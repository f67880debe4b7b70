"""Operators 2, 8 and 10 against plain Python."""

import hashlib
import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, quality_rules, url_reputation

from .cases import PROSE, docs, odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_filling(sizes, weights=(5, 2, 1), most=3):
    """Repeated resharing, literally."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    fixed, free, total = {}, list(names), sum(sizes.values())
    while free:
        left, ws = total - sum(fixed.values()), sum(w[s] for s in free)
        share = {s: left * w[s] / ws for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}
        free = [s for s in free if s not in above]
    return fixed


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1}, {"a": 1, "b": 100, "c": 100, None: 7}, {"x": 5}, {"a": 0, "b": 3}, {"a": 2, "b": 2, "c": 2, "d": 90}])
def test_targets_are_those_of_repeated_resharing(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = water_filling(sizes)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_mix_odd_rows(spark):
    d = docs(spark, odd_texts() + [(4, PROSE)]).withColumn("copies", F.lit(9)).withColumn("size", F.lit("x"))
    rows = mixing.mix_plan(d).collect()
    assert len(rows) == 13 and len({(r.doc_id, r.copies) for r in rows}) == 12
    assert all(0 <= r.copies <= 3 for r in rows)
    assert {r.doc_id: r.size for r in rows}[8] == 3000 and {r.doc_id: r.size for r in rows}[1] == 0
    assert Counter(mixing.mix_plan(d).collect()) == Counter(rows)
    d = d.withColumns({c: F.lit(c) for c in ("row", "n", "copy", "of", "rate", "__n", "__rate", "__of", "__copy", "source_size", "target")})
    kept = mixing.mix(d)
    assert kept.columns == d.columns and all(r["__n"] == "__n" and r["row"] == "row" for r in kept.collect())
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in kept.collect()) == +want
    assert mixing.mix_plan(d.limit(0)).count() == 0


def test_mix_is_near_its_targets(spark):
    d = spark.range(30000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.least(F.col("id") % 9, F.lit(3))).alias("source"))
    for r in mixing.mix_plan(d).groupBy("source_size", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.05)


def brute_features(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_rule_features(spark):
    texts = odd_texts() + [(20, "a b c d e a b c d e f a b c d e"), (21, "x a b c d e y\nx a b c d e y\n\n \nz"), (22, "a a a a a a"), (23, "1 2 3 4 5 6 7 8 9 | < > # a\r\na\r\na")]
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.features(docs(spark, texts).withColumn("h", F.lit(1))).collect()}
    for i, t in texts:
        assert got[i] == brute_features(t), i
    assert quality_rules.features(docs(spark, [])).count() == 0


def test_binomial_tail(spark):
    for n, r, a in [(1000, 0, 0.01), (1000, 3, 0.01), (5000, 10, 0.004), (300, 1, 0.02)]:
        want = sum(comb(n, k) * a**k * (1 - a) ** (n - k) for k in range(r + 1))
        got = spark.range(1).select(F.exp(F.expr(quality_rules.log_tail(f"{n}L", f"{r}L", a)))).first()[0]
        assert got == pytest.approx(want, rel=1e-9)
    assert spark.range(1).select(F.expr(quality_rules.log_tail("10L", "5L", 0.1))).first()[0] == 0


def test_rules_reject_junk_and_keep_good(spark):
    good = spark.range(3000).select("id", F.concat(F.lit(PROSE + " "), F.md5(F.col("id").cast("string"))).alias("text"))
    junk = spark.range(3000, 3300).select("id", F.concat(F.regexp_replace(F.lit(PROSE), " ", "*** "), F.md5(F.col("id").cast("string"))).alias("text"))
    d = good.union(junk).withColumnRenamed("id", "doc_id")
    labels = d.select("doc_id", (F.col("doc_id") < 3000).cast("int").alias("quality")).union(spark.createDataFrame([(None, 1), (5, None), (10**9, 1)], "doc_id long, quality int"))
    rows = quality_rules.apply_rules(d, labels).collect()
    assert len(rows) == 3300 and all(r.kept == (r.doc_id < 3000) for r in rows)
    none = quality_rules.apply_rules(d, labels.limit(0)).where("kept").count()
    assert none == 3300
    assert quality_rules.apply_rules(d.limit(0), labels).count() == 0
    assert quality_rules.apply_rules(docs(spark, odd_texts() + [(4, PROSE)]).withColumn("stratum", F.lit("x")), labels).count() == 13


def test_rules_use_every_label(spark):
    """1,900 good labels certify a cutoff however many other labels there are; half of them wouldn't."""
    clean = spark.range(1900).select("id", F.concat(F.lit(PROSE + " "), F.md5(F.col("id").cast("string"))).alias("text"))
    junk = spark.range(1900, 1910).select("id", F.regexp_replace(F.lit(PROSE), " ", "*** ").alias("text"))
    labels = spark.range(120_000).select(F.col("id").alias("doc_id"), (F.col("id") < 1900).cast("int").alias("quality"))
    rows = quality_rules.apply_rules(clean.union(junk).withColumnRenamed("id", "doc_id"), labels).collect()
    assert len(rows) == 1910 and all(r.kept == (r.doc_id < 1900) for r in rows)


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q=1", "x://example.org/en/1#a", "x://example.org/en/2", "x://org", "x://com/fr/", "x://notcom/fr/", "x://b.com/fr/a?://z", "x://b.com/de/", "x://Ä.COM:80/de", "a://b://c/d", "x://h?q/de/", "x://h\n/x\ny"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit(3))
    none = spark.createDataFrame([], "page_id int, good int")
    got = [tuple(r)[1:4] for r in url_reputation.judge_urls(df, none).orderBy("page_id").collect()]
    want = []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, rest = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
        host, path = "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest).group()
        fits = [(h + p, v) for v, h, p in url_reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((host, path, max(fits, key=lambda x: len(x[0]))[0] if fits else None))
    assert got == want
    assert url_reputation.judge_urls(df.limit(0), none).count() == 0


def test_reputation_shrinks_towards_its_domain(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.{'bad' if i % 50 < 5 else 'good'}.net/x") for i in range(5000)] + [(9000, "http://new.bad.net/"), (9001, "http://new.good.net/")], "page_id int, url string")
    seen = spark.createDataFrame([(i, int(i % 50 >= 5 or i % 20 == 0)) for i in range(0, 5000, 3)] + [(3, None), (None, 1), (6, 0)], "page_id int, good int")
    v = {r.page_id: r.verdict for r in url_reputation.judge_urls(pages, seen).collect()}
    assert v[9000] == "block" and v[9001] == "allow" and len(v) == 5002
    assert all(v[i] == ("block" if i % 50 < 5 else "allow") for i in range(5000))


def test_seeded_draw_is_the_documented_one(spark):
    want = int(hashlib.md5(b"mix-1:42").hexdigest()[:13], 16) / 2**52
    assert spark.range(1).select(mixing.unit_hash("mix-1", F.lit(42))).first()[0] == want


SF = "/root/testdata/sf0.01"


def test_certified_rules_reject_on_the_given_tables(spark):
    rows = quality_rules.query(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    extra = [r for r in rows if not r.kept and not r.base_failed]
    assert extra
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(not r.kept for r in good) <= 0.03 * len(good)


def test_the_union_of_rules_is_certified(spark):
    """Each rule alone rejects 2 % of the good rows, all together 10 %: no level may hold."""
    rows = [(k, {j: 9.0 for j in range(5) if k % 50 == j}) for k in range(4000)]
    t = spark.createDataFrame([(0, False, *(x.get(j, 0.0) for j in range(5))) for _, x in rows], "stratum int, base_failed boolean, " + ", ".join(f"{r} double" for r in quality_rules.GRIDS))
    assert quality_rules.calibrate(t).count() == 0
    one = spark.createDataFrame([(0, False, x.get(0, 0.0), 0.0, 0.0, 0.0, 0.0) for _, x in rows], t.schema)
    assert [tuple(r) for r in quality_rules.calibrate(one).collect()] == [(0, quality_rules.LEVELS - 1)]
    assert quality_rules.calibrate(one.limit(100)).count() == 0


def test_levels_are_nested():
    for cuts in quality_rules.GRIDS.values():
        assert len(cuts) == quality_rules.LEVELS and list(cuts) == sorted(cuts, reverse=True)


def test_reputation_blocks_hosts_on_the_given_tables(spark):
    n = Counter(r.verdict for r in url_reputation.query(spark, SF).where("rule IS NULL").collect())
    assert n["block"] and n["allow"]


def test_suffixes_and_domains(spark):
    hosts = {
        "a.co.uk": ("co.uk", "a.co.uk"), "x.a.co.uk:80": ("co.uk", "a.co.uk"), "co.uk": ("co.uk", "co.uk"), "a.example.com": ("com", "example.com"), "com": ("com", "com"),
        "10.0.0.1": ("ip", "10.0.0.1"), "10.0.0.1:80": ("ip", "10.0.0.1"), "[::1]": ("ip", "[::1]"), "": ("", ""), "b.com.io": ("com.io", "b.com.io"), "x.notco.uk": ("uk", "notco.uk"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r[0]: (r[1], r[2]) for r in df.select("host", *url_reputation.suffix_and_domain(F.col("host"))).collect()}
    assert got == hosts

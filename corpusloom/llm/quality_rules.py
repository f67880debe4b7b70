"""Quality rules with risk-controlled thresholds (operator 8), in DataFrame functions only.

Each rule rejects a text whose metric exceeds a cutoff.  The cutoffs of all rules form
levels, from loose to tight, each of which rejects whatever the one before rejects.  On
labelled good documents the number that a level's rules together reject is binomial; a
level is certified in a stratum if the exact lower tail P(X <= rejected) under a false
rejection rate of ``alpha`` is at most ``delta`` divided by the number of strata, and so is
every looser level: the levels of a stratum are tested in that fixed order up to the first
failure, which needs no further correction.  So with probability 1 - delta no stratum
loses more than alpha of its good documents to all rules together.  The tightest certified
level of a stratum holds; without one the rules are off there, so that few labels mean few
rejections, never wrong ones.

Strata are bands of word counts: four rows at most, which is what is broadcast.
Features are computed once for every document and kept in shared storage without text.

Defined results: a null text counts as an empty one (no words: the base rule rejects
it); repeated rows are judged alike; labels without a document, or null, are ignored, a
repeated label counts once (good only if all its rows say so); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, materialize, only, table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Lower ends of the strata, in words.
BANDS = (0, 100, 400, 1600)
#: Rule: cutoffs of the levels, from loose to tight.  The tight ends are usual values of web corpora.
GRIDS = {
    "symbols": (1.0, 0.5, 0.3, 0.2, 0.15, 0.1),
    "bangs": (1.0, 0.5, 0.3, 0.2, 0.15, 0.1),
    "capitals": (0.9, 0.7, 0.5, 0.4, 0.35, 0.3),
    "dup_lines": (0.7, 0.6, 0.5, 0.4, 0.35, 0.3),
    "repeats": (0.2, 0.19, 0.18, 0.17, 0.16, 0.15),
}
LEVELS = 6
#: False rejection rate of all rules in a stratum, and the probability that any stratum exceeds it.
ALPHA, DELTA = 0.03, 0.1


def features(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bangs, n_capitals.

    All within the row: windows are hashed to 64 bits, and only texts in which one of
    them occurs twice are sorted, so the cost is that of one pass over the text.
    """
    d = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.select(
        "doc_id",
        F.expr(r"transform(filter(split(t, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), w -> xxhash64(w))").alias("h"),
        F.length(F.regexp_replace("t", BLANK, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "!", ""))).cast("bigint").alias("n_bangs"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_capitals"),
        F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    d = d.withColumn("n_words", F.size("h").cast("bigint"))
    window = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    d = d.withColumn("w", F.expr(f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({window})) ELSE cast(array() AS array<bigint>) END"))
    d = d.withColumn("s", F.expr("CASE WHEN size(array_distinct(w)) < size(w) THEN array_sort(transform(w, (x, i) -> struct(x AS x, i AS i))) END"))
    twice = "(j > 0 AND s[j - 1].x = y.x) OR (j + 1 < size(s) AND s[j + 1].x = y.x)"
    d = d.withColumn("p", F.expr(f"array_sort(transform(filter(s, (y, j) -> {twice}), y -> y.i))"))
    covered = f"aggregate(p, struct(0L AS n, -{WINDOW} AS last), (a, i) -> struct(a.n + least({WINDOW}, i - a.last) AS n, i AS last), a -> a.n)"
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"), "n_bangs", "n_capitals",
    )


def metrics(feats: DataFrame) -> DataFrame:
    """Adds the rules' metrics, the stratum, and base_failed."""
    words, band = F.greatest(F.col("n_words"), F.lit(1)), F.lit(0)
    for k, least in enumerate(BANDS):
        band = F.when(F.col("n_words") >= least, k).otherwise(band)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return feats.withColumns({
        "symbols": F.col("n_symbols") / words,
        "bangs": F.col("n_bangs") / words,
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "stratum": band,
        "base_failed": failed,
    })


def log_tail(n: str, r: str, alpha: float) -> str:
    """SQL for ln P(X <= r) with X binomial (n, alpha); 0 where r is not below n * alpha."""
    step = f"a.t + ln((cast({n} AS double) - k + 1) / k) + ln({alpha}D / (1 - {alpha}D))"
    added = f"greatest(a.s, {step}) + log1p(exp(-abs(a.s - ({step}))))"
    first = f"{n} * ln(1 - {alpha}D)"
    more = f"aggregate(sequence(1, cast({r} AS int)), struct({first} AS t, {first} AS s), (a, k) -> struct({step} AS t, {added} AS s), a -> a.s)"
    return f"CASE WHEN {r} >= {n} * {alpha}D THEN 0D WHEN {r} = 0 THEN {first} ELSE {more} END"


def rejected_at(level: int) -> Column:
    """Whether any rule rejects a row of metrics at a level."""
    out = F.lit(False)
    for rule, cuts in GRIDS.items():
        out = out | (F.col(rule) > cuts[level])
    return out


def calibrate(labelled: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and level, the tightest certified one; strata without one are left out.  labelled: metrics of good documents.

    Levels are nested, so their tails grow with the level: those certified are the first ones.
    """
    counts = [F.count_if(rejected_at(k)).alias(f"r{k}") for k in range(LEVELS)]
    t = labelled.where("NOT base_failed").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    certified = [F.when(F.expr(log_tail("n", f"r{k}", alpha)) <= F.log(F.lit(delta / len(BANDS))), k) for k in range(LEVELS)]
    return t.select("stratum", F.greatest(*certified).alias("level")).where("level IS NOT NULL")


def apply_rules(docs: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of docs (doc_id, text).

    labels: (doc_id, quality).  All of them calibrate, at every size: they are counted, not collected.
    """
    feats = metrics(materialize(features(docs), "rule-features"))
    known = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = known.where(F.col("quality") == 1).select("doc_id")
    levels = F.broadcast(calibrate(feats.join(good, "doc_id", "left_semi"), alpha=alpha, delta=delta))
    rejected = F.lit(False)
    for k in range(LEVELS):
        rejected = F.when(F.col("level") == k, rejected_at(k)).otherwise(rejected)
    return feats.join(levels, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
d AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t
), w AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i) WHERE len(ws) >= 5
), rep AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(t) - length(translate(t, '!', '')) AS n_bangs,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
  FROM d LEFT JOIN cov USING (doc_id)
), m AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN n_words >= 1600 THEN 3 WHEN n_words >= 400 THEN 2 WHEN n_words >= 100 THEN 1 ELSE 0 END AS stratum,
         [n_symbols / greatest(n_words, 1)::DOUBLE, n_bangs / greatest(n_words, 1)::DOUBLE, n_capitals / greatest(word_chars, 1)::DOUBLE,
          n_dup_lines / greatest(n_lines, 1)::DOUBLE, n_repeat_words / greatest(n_words, 1)::DOUBLE] AS metrics
  FROM f
), lv(level, c) AS (
  VALUES (0, [1.0, 1.0, 0.9, 0.7, 0.2]::DOUBLE[]), (1, [0.5, 0.5, 0.7, 0.6, 0.19]::DOUBLE[]), (2, [0.3, 0.3, 0.5, 0.5, 0.18]::DOUBLE[]),
    (3, [0.2, 0.2, 0.4, 0.4, 0.17]::DOUBLE[]), (4, [0.15, 0.15, 0.35, 0.35, 0.16]::DOUBLE[]), (5, [0.1, 0.1, 0.3, 0.3, 0.15]::DOUBLE[])
), good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
x AS (
  SELECT doc_id, stratum, base_failed, level,
         metrics[1] > c[1] OR metrics[2] > c[2] OR metrics[3] > c[3] OR metrics[4] > c[4] OR metrics[5] > c[5] AS rejected FROM m, lv
), c AS (
  SELECT stratum, level, count(*) AS n, count_if(rejected)::BIGINT AS r FROM x JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY stratum, level
), tail AS (
  SELECT stratum, level,
    CASE WHEN r >= n * 0.03::DOUBLE THEN 1 ELSE list_sum([exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.03::DOUBLE) + (n - k) * ln(1 - 0.03::DOUBLE)) for k in range(0, r + 1)]) END AS p FROM c
), held AS (SELECT stratum, max(level) AS level FROM tail WHERE p <= 0.1::DOUBLE / 4 GROUP BY stratum),
bad AS (SELECT DISTINCT doc_id FROM x JOIN held USING (stratum, level) WHERE rejected)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM m LEFT JOIN bad USING (doc_id)
"""

"""How filters interact (operator 12): what each removes in every order in which they may run.

Five filters, each with the condition under which a text fails it:

* A: fewer than 100 words; B: its distinct words are under 80 % of its words;
* C: over 10 % of its characters are A-Z; D: it holds any of #$%&*|;
* E: a document with a smaller doc_id has the same text.

Words are relational: texts are dealt once by (doc_id, hash of the text), exploded to words, aggregated by
document and word, and then by document to the number of words and of distinct ones, both where
the rows already are.  The least doc_id of each text, and the labels, are joined to that from outside.
One aggregation then counts, in each part (language), the documents that fail exactly one
of the 32 sets of filters: 32 columns each for all, good and toxic documents, from which every order and
step follows by sums of columns.  So the corpus is read the same however many orders there are.

Copies of a text never meet in one task: the least doc_id of a text is a minimum that is combined
before it is shuffled, and it goes back by (doc_id, text), which only the first copy matches.

Defined results: a null text is an empty one, a null language the part of the empty string; a
null doc_id has no smaller one and isn't smaller than any, and has no label; repeated rows count each, and
aren't copies of each other; a document is good (toxic) if any row of its labels says so; labels without a
document are ignored; without documents there are no parts, so no rows.  Texts are taken to be the same if the
first 128 bits of their SHA-256 are.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, UPPER, only, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
#: A text that holds any of these fails D.
SYMBOLS = "[#$%&*|]"
BLANKS = " \t\n\x0b\x0c\r"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _hash(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def text_flags(docs: DataFrame) -> DataFrame:
    """doc_id, h (that of the text), part, a, b, c, d, copies: what a text fails by itself, a row for each (doc_id, text, part) and its number of rows."""
    t = only(docs, "doc_id", "text", "lang").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    capitals = F.length("t") - F.length(F.translate("t", UPPER, ""))
    t = t.withColumns({"h": _hash(F.col("t")), "c": 100 * capitals > MAX_CAPITAL_PERCENT * F.length("t"), "d": F.rlike("t", F.lit(SYMBOLS))})
    key = ["doc_id", "h", "part", "c", "d"]
    # One blank after the last word and none before the first: the last piece of a split text, and no other, is empty.
    t = t.withColumn("t", F.ltrim("t", F.lit(BLANKS))).withColumn("t", F.when(F.col("t") == "", "").otherwise(F.concat("t", F.lit(" "))))
    words = t.repartition("doc_id", "h").select(*key, F.explode(F.split("t", f"{BLANK}+")).alias("word"))
    each = words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    is_word = F.col("word") != ""
    whole = each.groupBy(*key).agg(
        F.sum(F.when(is_word, F.col("n")).otherwise(0)).alias("words"), F.count_if(is_word).alias("kinds"), F.sum(F.when(is_word, 0).otherwise(F.col("n"))).alias("copies")
    )
    # Repeated rows add up in `words`, not in `kinds`.
    few, alike = F.col("words") < MIN_WORDS * F.col("copies"), 100 * F.col("kinds") * F.col("copies") < MIN_DISTINCT_PERCENT * F.col("words")
    return whole.select("doc_id", "h", "part", few.alias("a"), alike.alias("b"), "c", "d", "copies")


def first_copies(docs: DataFrame) -> DataFrame:
    """doc_id, h of the least doc_id of each text."""
    t = only(docs, "doc_id", "text").where("doc_id IS NOT NULL").select("doc_id", _hash(F.coalesce("text", F.lit(""))).alias("h"))
    return t.groupBy("h").agg(F.min("doc_id").alias("doc_id"))


def outcomes(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic of every labelled doc_id."""
    t = only(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id")
    return t.agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, copies, fails (bit k set where FILTERS[k] fails), good, toxic, for each (doc_id, text, part) of docs."""
    first = first_copies(docs).withColumn("first", F.lit(True))
    t = text_flags(docs).join(first, ["doc_id", "h"], "left")
    e = F.col("doc_id").isNotNull() & F.col("first").isNull()
    bits = [F.col("a"), F.col("b"), F.col("c"), F.col("d"), e]
    fails = sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))
    # Null ids match no label; they are dealt by their texts, so that they don't meet in one task.
    t = t.select("part", "copies", fails.alias("fails"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.xxhash64("h")).alias("doc_id"))
    known = outcomes(labels).withColumn("no_id", F.lit(False))
    t = t.join(known, ["doc_id", "no_id"], "left")
    return t.select("part", "copies", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def counts(fails: DataFrame) -> DataFrame:
    """part and, for each set of filters, all_<set>, good_<set>, toxic_<set>: the documents that fail exactly these."""
    one = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    cols = [F.sum(F.when((F.col("fails") == m) & keep, F.col("copies")).otherwise(0)).alias(f"{k}_{m}") for k, keep in one.items() for m in range(SETS)]
    return fails.groupBy("part").agg(*cols)


def _bits(letters: Column) -> Column:
    """The set of the filters that a string names."""
    return sum((F.when(F.contains(letters, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))


def report(tally: DataFrame) -> DataFrame:
    """The rows of `audit` from those of `counts`: sums over sets, part by part."""
    t = tally.select("part", *(F.array(*(f"{k}_{m}" for m in range(SETS))).alias(k) for k in ("all", "good", "toxic")))
    t = t.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    t = t.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    t = t.withColumns({"this": _bits(F.substring("filter_order", F.col("step"), F.lit(1))), "before": _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})

    def total(of: str, condition: str, weight: str = "1") -> Column:
        return F.expr(f"aggregate(sequence(0, {SETS - 1}), 0L, (a, m) -> a + IF({condition}, {of}[m] * {weight}, 0L))")

    here = "m & this > 0 AND m & before = 0"
    return t.select(
        "part", "filter_order", "step",
        total("all", "m & (this | before) = 0").alias("kept"),
        total("all", here).alias("removed"),
        total("all", "m & this > 0 AND m & before > 0").alias("redundant"),
        total("all", "m = this").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # Of the orders, a document's filters come first equally often.
        total("all", "m & this > 0", f"({len(ORDERS)} div bit_count(m))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of docs (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    return report(counts(failures(docs, labels)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lab AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': len(ws) < 100, 'B': 100 * len(list_distinct(ws)) < 80 * len(ws), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
     'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false)} AS x
  FROM t LEFT JOIN lab ON lab.doc_id = t.doc_id
), g AS (SELECT part, good, toxic, concat_ws('', CASE WHEN x.A THEN 'A' END, CASE WHEN x.B THEN 'B' END, CASE WHEN x.C THEN 'C' END, CASE WHEN x.D THEN 'D' END, CASE WHEN x.E THEN 'E' END) AS fails FROM f),
n AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM g GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS this, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, this, n, good, toxic, contains(fails, this) AS here, fails = this AS alone, len(list_filter(string_split(before, ''), lambda q: q <> '' AND contains(fails, q))) > 0 AS gone FROM n, s
), v AS (
  SELECT part, filter_order, step, this, coalesce(sum(n) FILTER (WHERE NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE here AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE here AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE here AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, this))::BIGINT AS shapley
FROM v
"""

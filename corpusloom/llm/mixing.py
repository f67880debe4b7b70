"""Mixing sources to target weights (operator 2), in DataFrame functions only.

Tokens are summed per source; targets follow the weights, and no target exceeds
``max_repeat`` times its source: what is above is shared anew by weight until none is
(water filling, in closed form).  Each document is then emitted floor(rate) times plus
once more with the rate's fraction as probability, drawn from the MD5 of seed and doc_id.

Defined results: a null text has size 0; null sources are one source, ranked last;
rows with one doc_id draw alike; an empty table gives an empty result; a mix of size
0 has targets 0; extra columns are ignored by `mix_plan` and kept by `mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, only, positional, table, unit_hash

#: By rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEAT, SEED = 3, "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, total: int | None = None) -> DataFrame:
    """source, source_size, target of sizes (source, source_size), one row per source.

    With sources in ascending order of cap / weight, those before the first whose cap
    reaches its share of what the earlier ones left over are filled to their caps.
    The windows run over one row per source, never over documents.
    """
    ranked = Window.partitionBy("one").orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("one", F.lit(1)).withColumn("rank", F.row_number().over(ranked) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint")
    t = t.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
    filling = Window.partitionBy("one").orderBy((F.col("cap") / F.col("w")).asc(), "rank")
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("one")
    whole = F.sum("source_size").over(everything) if total is None else F.lit(total)
    t = t.withColumn("left", whole - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    level = F.struct("left", "left_w")
    holds = F.col("cap").cast("double") * F.col("left_w") >= F.col("left").cast("double") * F.col("w")
    t = t.withColumn("first", F.min(F.when(holds, F.struct((F.col("cap") / F.col("w")).alias("r"), "rank", level.alias("at")))).over(everything))
    share = F.col("first.at.left").cast("double") * F.col("w") / F.col("first.at.left_w")
    target = F.coalesce(F.least(F.col("cap").cast("double"), share), F.col("cap").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies of every row of docs (doc_id, text, source)."""
    sized = only(docs, "doc_id", "text", "source").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    # The words of each text are counted for the sums and again for the plan: cheaper than keeping them.
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(totals, weights=weights, max_repeat=max_repeat)
    keyed = plan.select(F.col("source").alias("of"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (unit_hash(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("int")
    out = sized.join(keyed, F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.floor(rate) + extra).cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs, all its columns whatever their names, as many times as its plan says."""
    t, (doc_id, text, source) = positional(docs, "doc_id", "text", "source")
    rows = t.select(F.struct("*").alias("row"))
    doc_id, text, source = (F.col(f"row.{c}") for c in (doc_id, text, source))
    plan = source_targets(rows.groupBy(source.alias("source")).agg(F.sum(word_count(text)).alias("source_size")), weights=options.get("weights", WEIGHTS), max_repeat=options.get("max_repeat", MAX_REPEAT))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    by = plan.select(F.col("source").alias("of"), rate.alias("rate"))
    copies = F.floor("rate") + (unit_hash(options.get("seed", SEED), doc_id) < F.col("rate") - F.floor("rate")).cast("int")
    out = rows.join(by, source.eqNullSafe(F.col("of")), "left").select("row", copies.cast("int").alias("n"))
    return out.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).select("row.*").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source
), c AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, source_size * 3 AS cap FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0))::DOUBLE AS "left", (sum(w) OVER () - coalesce(sum(w) OVER p, 0))::DOUBLE AS left_w
  FROM c WINDOW p AS (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT "left", left_w FROM f WHERE cap::DOUBLE * left_w >= "left" * w ORDER BY cap::DOUBLE / w, rank LIMIT 1
), t AS (SELECT source, source_size, least(cap::DOUBLE, l."left" * w / l.left_w) AS target FROM c, l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""

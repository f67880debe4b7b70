"""Gates, first-wins deduplication, stratified splits and the corpus report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.names import unused


def length_gate(q: Column, a: Column, q_range: tuple[int, int] = (4, 80), a_range: tuple[int, int] = (5, 200)) -> Column:
    """Both lengths, in code points of the raw texts, lie within their closed ranges."""
    return F.length(q).between(*q_range) & F.length(a).between(*a_range)


def quality_gate(q: Column, a: Column, keywords: Column, names: Column) -> Column:
    """Long enough, and the answer holds a keyword, a product name or any digit."""
    return (F.length(q) >= 4) & (F.length(a) >= 5) & (T.contains_any(a, keywords) | T.contains_any(a, names) | T.has_digit(a))


def first_wins(rows: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key.  Gate rows before: a row that fails a gate must not hide a later one.

    row_number() = 1 becomes a partial group limit before the shuffle, so copies of a hot key
    are dropped on the map side.
    """
    *names, rank = unused(rows, *(f"__k{k}" for k in range(len(keys))), "__rn")
    t = rows.withColumns(dict(zip(names, keys, strict=True)))
    t = t.withColumn(rank, F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    return t.where(F.col(rank) == 1).drop(rank, *names)


def stratified_split(rows: DataFrame, stratum: str, key: Column, *, seed: str = "42", train: float = 0.8, val: float = 0.9, digits: int = 3) -> DataFrame:
    """Adds split: within each stratum in hash order, the first int(n * train) rows, up to int(n * val), and the rest.

    `key` must be unique.  Rows are ranked within (stratum, leading `digits` hex digits of the hash), so a
    stratum is dealt to 16 ** digits groups; what precedes a group is summed over the groups' counts.
    """
    h, bin_, of_stratum, of_bin, total, before, rank = unused(rows, "__h", "__bin", "__s", "__b", "__n", "__before", "__rn")
    t = rows.withColumn(h, T.hash_order(seed, key)).withColumn(bin_, F.substring(h, 1, digits))
    bins = t.groupBy(F.col(stratum).alias(of_stratum), F.col(bin_).alias(of_bin)).agg(F.count(F.lit(1)).alias("m"))
    of = Window.partitionBy(of_stratum)
    earlier = F.sum("m").over(of.orderBy(of_bin).rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(of_stratum, of_bin, F.sum("m").over(of).alias(total), F.coalesce(earlier, F.lit(0)).alias(before))
    t = t.withColumn(rank, F.row_number().over(Window.partitionBy(stratum, bin_).orderBy(h)))
    t = t.join(bins, F.col(stratum).eqNullSafe(F.col(of_stratum)) & (F.col(bin_) == F.col(of_bin)))
    place = F.col(before) + F.col(rank)
    split = F.when(place <= F.floor(F.col(total) * F.lit(train)), "train").when(place <= F.floor(F.col(total) * F.lit(val)), "val").otherwise("test")
    return t.withColumn("split", split).drop(h, bin_, of_stratum, of_bin, total, before, rank)


def split_by_group(rows: DataFrame, group: Column, *, seed: str = "42", train: float = 0.8, val: float = 0.9) -> DataFrame:
    """Adds split by a hash of the group alone: variants of one question stay together, and nothing is shuffled."""
    u = T.hash_int(seed, group) / F.lit(float(1 << 32))
    return rows.withColumn("split", F.when(u < train, "train").when(u < val, "val").otherwise("test"))


def corpus_stats(raw: DataFrame, kept: DataFrame, seeds: int) -> DataFrame:
    """One row: raw_count, dedup_dropped, final_count, expansion_ratio, source, intent_dist, split, ood_ratio."""
    # Each table is read once: a few rows an origin or intent are summed up.
    entries = lambda key, n: F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, n))))
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counted = raw.groupBy("origin").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("raw_count"), entries("origin", "count").alias("source"))
    parts = ("train", "val", "test")
    each = kept.groupBy("intent").agg(F.count(F.lit(1)).alias("final_count"), *(F.count_if(F.col("split") == s).alias(s) for s in parts), F.count_if("ood").alias("n_ood"))
    sums = each.agg(entries("intent", F.col("final_count").alias("count")).alias("intent_dist"), *map(add, ("final_count", *parts, "n_ood")))
    one = counted.crossJoin(F.broadcast(sums))  # one row each
    return one.select(
        "raw_count", (F.col("raw_count") - F.col("final_count")).alias("dedup_dropped"), "final_count", F.round(F.col("final_count") / F.lit(float(seeds)), 1).alias("expansion_ratio"),
        "source", "intent_dist", F.struct("train", "val", "test").alias("split"), F.round(F.col("n_ood") / F.greatest("final_count", F.lit(1)), 3).alias("ood_ratio"),
    )


def build_corpus(raw: DataFrame, *, dedup: str = "qa", seed: str = "42", q_range: tuple[int, int] = (4, 80), a_range: tuple[int, int] = (5, 200)) -> DataFrame:
    """raw (ord, intent, q, a, ...): gated, deduplicated on question and answer (or "q"), split within intents."""
    gated = raw.where(length_gate(F.col("q"), F.col("a"), q_range, a_range))
    keys = [T.normalize(F.col("q"))] + ([T.normalize(F.col("a"))] if dedup == "qa" else [])
    return stratified_split(first_wins(gated, keys, [F.col("ord")]), "intent", F.col("ord"), seed=seed)

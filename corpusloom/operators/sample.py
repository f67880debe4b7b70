"""Sampling by hash order: reproducible on any engine and partitioning.

The k rows of the least hashes, for any k, are those up to a threshold.  It is found by counting rows per
leading hash digits, then per further digits within the bin that holds the k-th row only, until a bin
ends with it: a few passes that send back one number a bin.  What is selected then is a filter of the input, in
as many tasks as that has; nothing is sorted or moved.  The first k rows in an order of their own are found
likewise, between pivots.  Input that is not the same at every reading must be written to a table first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.names import unused

#: Hex digits that a pass counts by: at most 16 ** DIGITS numbers come back.
DIGITS = 4
#: Pivots of a pass over rows in an order of their own, and rows between two of them that are sorted at last.
PIVOTS, SETTLED = 256, 4096
#: Copies of one row that a task makes.
COPIES = 1 << 20


def _threshold(hashes: DataFrame, k: int) -> tuple[str | None, int]:
    """(prefix, rows missing) of hashes (h, hex digits): those whose leading digits are at most prefix are the k least, but for the last that are missing.

    No prefix: all rows are fewer than k.  Rows miss only where one hash stands on both sides.
    """
    width = 32
    prefix, before = "", 0
    while True:
        n = min(DIGITS, width - len(prefix))
        t = hashes.where(F.startswith("h", F.lit(prefix))).groupBy(F.substring("h", len(prefix) + 1, n).alias("d")).count()
        for d, count in sorted(tuple(r) for r in t.collect()):
            if before + count >= k:
                break
            before += count
        else:
            return None, 0
        prefix += d
        if before + count == k:
            return prefix, 0
        if len(prefix) == width:
            return prefix, k - before


def _copies(rows: DataFrame, n: int) -> DataFrame:
    """n copies of the first of rows that are all the same, COPIES in a task."""
    tasks = -(-n // COPIES)
    one = rows.limit(1).select(F.struct("*").alias("row"))
    t = one.select("row", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")).repartition(tasks, "task")
    size = F.least(F.lit(COPIES), F.lit(n) - F.col("task").cast("bigint") * COPIES)
    return t.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).select("row.*")


def _tied(rows: DataFrame, k: int) -> DataFrame:
    """k of rows that are equal in order: by the hash of all their columns; where that is one too, they are the same row."""
    h = F.md5(F.to_json(F.struct("*")))
    prefix, missing = _threshold(rows.select(h.alias("h")), k)
    if prefix is None:
        return rows
    if not missing:
        return rows.where(F.substring(h, 1, len(prefix)) <= prefix)
    return rows.where(h < prefix).unionByName(_copies(rows.where(h == prefix), missing))


def _least(rows: DataFrame, k: int, h: Column) -> tuple[Column, DataFrame | None]:
    """(condition, more): the k rows of the least hashes are those that fulfil the condition, and more."""
    if k <= 0:
        return F.lit(False), None
    prefix, missing = _threshold(rows.select(h.alias("h")), k)
    if prefix is None:
        return F.lit(True), None
    if not missing:
        return F.substring(h, 1, len(prefix)) <= prefix, None
    return h < prefix, _tied(rows.where(h == prefix), missing)


def simple(rows: DataFrame, k: int, key: Column, *, seed: str = "42") -> DataFrame:
    """k rows without replacement, all where there are fewer: those of the least hashes of the key.

    Rows of one key that stand on both sides of the k-th are told apart by all their columns.
    """
    chosen, more = _least(rows, k, T.hash_order(seed, key))
    out = rows.where(chosen)
    return out if more is None else out.unionByName(more)


class Ranges:
    """An order of rows by ascending columns (null first), cut into ranges by pivots drawn from them."""

    def __init__(self, keys: DataFrame):
        """keys: a table with the struct `key` alone."""
        self.fields = keys.schema["key"].dataType.fields

    def literal(self, values) -> Column:
        return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, self.fields, strict=True)))

    def draw(self, keys: DataFrame, rows: int, pivots: int, seed: int) -> list:
        """At most `pivots` keys of a table of some number of rows, in order."""
        drawn = sorted_keys(keys.sample(min(1.0, 4 * pivots / max(rows, 1)), seed=seed).limit(8 * pivots).distinct())
        return drawn[:: -(-len(drawn) // pivots) or 1]

    def number(self, pivots: list, key: Column) -> Column:
        """2j where key lies between pivots j - 1 and j, 2j - 1 where it is pivot j - 1."""
        if not pivots:
            return F.lit(0)
        bounds = F.array(*map(self.literal, pivots))
        reached = F.size(F.filter(bounds, lambda p: p <= key))
        return F.when(reached == 0, 0).when(F.element_at(bounds, F.greatest(reached, F.lit(1))) == key, 2 * reached - 1).otherwise(2 * reached)


def order_key(order: tuple[Column, ...]) -> Column:
    return F.struct(*(c.alias(f"k{j}") for j, c in enumerate(order)))


def first(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows by ascending columns (null first), all where there are fewer, in no order; for any k, and without a sort of the rows.

    Pivots drawn from the rows cut them into ranges, and the range that holds the k-th row is cut again until it
    is small.  A pivot's own rows are a range, so one key may fill the table.  Rows that are equal in order are
    told apart by all their columns.
    """
    if k <= 0:
        return rows.where(F.lit(False))
    key = order_key(order)
    keys, missing = rows.select(key.alias("key")), k
    ranges, n, turn = Ranges(keys), keys.count(), 0
    if n <= k:
        return rows
    while n > SETTLED:
        turn += 1
        pivots = ranges.draw(keys, n, PIVOTS, turn)
        if not pivots:
            continue
        for at, n in sorted(tuple(r) for r in keys.groupBy(ranges.number(pivots, F.col("key")).alias("range")).count().collect()):
            if n >= missing:
                break
            missing -= n
        if at % 2:
            return _up_to(rows, key, ranges.literal(pivots[at // 2]), missing, n)
        if at:
            keys = keys.where(F.col("key") > ranges.literal(pivots[at // 2 - 1]))
        if at // 2 < len(pivots):
            keys = keys.where(F.col("key") < ranges.literal(pivots[at // 2]))
    last = sorted_keys(keys)
    end = last[missing - 1]
    return _up_to(rows, key, ranges.literal(end), missing - last.index(end), last.count(end))


def _up_to(rows: DataFrame, key: Column, end: Column, needed: int, there: int) -> DataFrame:
    """The rows below end, and as many as are needed of those there on it."""
    if needed == there:
        return rows.where(key <= end)
    return rows.where(key < end).unionByName(_tied(rows.where(key == end), needed))


def sorted_keys(keys: DataFrame) -> list:
    """The keys of a small table, in Spark's order."""
    return [r.key for r in keys.orderBy("key").collect()]


def head(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def head_per_group(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    (rank,) = unused(rows, "__rn")
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= n).drop(rank)


def stratified(rows: DataFrame, stratum: str, total: int, key: Column, *, seed: str = "42") -> DataFrame:
    """max(1, total div strata) rows of each stratum at most, `total` in all."""
    n = rows.select(F.countDistinct(stratum).alias("n")).first().n
    quota = max(1, total // max(n, 1))
    (h,) = unused(rows, "__h")
    t = head_per_group(rows.withColumn(h, T.hash_order(seed, key)), stratum, quota, F.col(h))
    return t.orderBy(stratum, h).limit(total).drop(h)


def rebalance(rows: DataFrame, flag: str, share: float, key: Column, *, seed: str = "42") -> DataFrame:
    """All flagged rows, and min(n, int(flagged * (1 - share) / share)) of the others, in DOUBLE arithmetic.

    One filter over the rows: flagged, or of a hash up to the threshold.
    """
    c = rows.agg(F.count_if(F.col(flag)).alias("yes"), F.count_if(~F.col(flag)).alias("no")).first()
    quota = min(c.no, int(c.yes * (1 - share) / share))
    others = rows.where(~F.col(flag))
    chosen, more = _least(others, quota, T.hash_order(seed, key)) if quota < c.no else (F.lit(True), None)
    out = rows.where(F.col(flag) | (~F.col(flag) & chosen))
    return out if more is None else out.unionByName(more)


def mix_in(domain: DataFrame, general: DataFrame, share: float, *order: Column) -> DataFrame:
    """domain and the first min(int(n * share), available) rows of general."""
    return domain.unionByName(first(general, int(domain.count() * share), *order))


def choice(options: Column, key: Column, *, seed: str = "42") -> Column:
    """One element of an array, by hash."""
    return F.element_at(options, (T.hash_int(seed, key) % F.size(options) + 1).cast("int"))

"""Token streams: encoding, packing, hold-out, windows and diversity.

Offsets over the whole corpus come from a two-level prefix sum: the sums of ranges of the key
are collected (one number for each range), and only the order within a range is a window.
A row's range depends on its key alone, never on how a plan happens to be partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Texts that a task encodes at once.
AT_ONCE = 64


def bpe_encode(rows: DataFrame, tokenizer_json: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ids, encoded in Arrow batches by a public tokenizer given as its JSON text."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread of the library would hold caches of its own
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(tokenizer_json)

        def each(texts: list[str]) -> Iterator[np.ndarray]:
            for k in range(0, len(texts), AT_ONCE):  # an encoding holds far more than its ids
                for e in t.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False):
                    yield np.array(e.ids, np.int32)

        for s in batches:
            yield pd.Series(list(each(s.fillna("").tolist())), index=s.index, dtype=object)

    return rows.withColumn(ids, encode(F.col(text)))


def decode(rows: DataFrame, tokenizer_json: str, *, ids: str = "ids", text: str = "decoded", skip: int = 0) -> DataFrame:
    """Adds the text of ids from position `skip` on, without special tokens."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(tokenizer_json)
        for s in batches:
            yield pd.Series([t.decode(list(map(int, x[skip:])), skip_special_tokens=True) for x in s], index=s.index)

    return rows.withColumn(text, run(F.col(ids)))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def packed(rows: DataFrame, ids: str, eot: int) -> DataFrame:
    """ids with the end token appended."""
    return rows.withColumn(ids, F.concat(F.col(ids), F.array(F.lit(eot))))


def _range_of(key: Column, bounds: list) -> Column:
    """How many bounds are at most key, in about twice the root of their number of comparisons; 0 for null."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    chunks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    chunk = below(F.array(*(F.lit(c[0]) for c in chunks)))
    within = below(F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in chunks)), chunk))
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * step + within)


def with_offsets(rows: DataFrame, size: Column, key: str, parts: int | None = None) -> DataFrame:
    """Adds start: the sum of size over all rows with a smaller key (unique, a number or time; null first).

    The key's quantiles cut it into `parts` ranges (as many as the session's shuffle partitions),
    which both the sums and the windows use.  Other columns are carried as they are, whatever their names.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / parts for k in range(1, parts)]
    t = rows.select(F.struct("*").alias("row"), F.col(key).alias("key"), size.cast("bigint").alias("size"))
    bounds = t.agg(F.percentile_approx("key", cuts, 50 * parts).alias("b")).first().b if cuts else None
    t = t.withColumn("part", _range_of(F.col("key"), sorted(set(bounds or []))))
    before, total = [], 0
    for r in t.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect():
        before.append((r["part"], total))
        total += r.n or 0
    w = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    base = spark.createDataFrame(before, "of int, base long")
    t = t.withColumn("within", F.coalesce(F.sum("size").over(w), F.lit(0)))
    t = t.join(F.broadcast(base), F.col("part") == F.col("of"), "left")  # a row without a range's sum is an error, not a loss
    start = F.when(F.col("base").isNull(), F.raise_error(F.lit("the rows changed between two evaluations")).cast("bigint")).otherwise(F.col("base") + F.col("within"))
    return t.select("row.*", start.alias("start"))


def hold_out(rows: DataFrame, size: Column, total: int, eval_tokens: int) -> DataFrame:
    """Adds part: eval where a document (start, size) ends in the last eval_tokens of total, else train."""
    if eval_tokens >= total:
        raise ValueError("the corpus is not larger than the part held out")
    return rows.withColumn("part", F.when(F.col("start") + size > total - eval_tokens, "eval").otherwise("train"))


def blocks(rows: DataFrame, ids: str, block: int, overlap: int = 0, only: DataFrame | None = None) -> DataFrame:
    """block_id, ids: the packed stream (rows with start, ids) in blocks of `block` tokens and the next `overlap`; the last may be shorter.

    A row's tokens are sliced at the blocks' borders: what is shuffled is one slice per row and block, of the blocks in
    `only` (block_id) where that is given.
    """
    n = F.size(ids)
    first = F.greatest(F.lit(0), F.floor((F.col("start") - overlap) / block)).cast("bigint")
    last = F.floor((F.col("start") + n - 1) / block).cast("bigint")
    t = rows.where(n > 0).select("start", F.col(ids).alias("ids"), F.explode(F.sequence(first, last)).alias("block_id"))
    if only is not None:
        t = t.join(only.select("block_id").distinct(), "block_id", "left_semi")
    lo = F.greatest(F.lit(0).cast("bigint"), F.col("block_id") * block - F.col("start"))
    hi = F.least(F.size("ids").cast("bigint"), (F.col("block_id") + 1) * block + overlap - F.col("start"))
    t = t.select("block_id", "start", F.slice("ids", (lo + 1).cast("int"), F.greatest(F.lit(0), hi - lo).cast("int")).alias("x"))
    t = t.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("start", "x"))).alias("x"))
    return t.select("block_id", F.flatten(F.transform("x", lambda v: v["x"])).alias("ids"))


def next_token(ids: Column) -> tuple[Column, Column]:
    """(inputs, targets): all but the last, all but the first."""
    return F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids) - 1)


def random_window(ids: Column, block: int, u: Column) -> Column:
    """`block` tokens from a start that the integer u picks, within one row."""
    return F.slice(ids, (u % F.greatest(F.size(ids) - block - 1, F.lit(1)) + 1).cast("int"), block)


def random_windows(rows: DataFrame, ids: str, block: int, draws: int, *, lo: int = 0, hi: int | None = None, seed: str = "42", width: int | None = None) -> DataFrame:
    """draw, place, inputs, targets: `draws` windows of `block` tokens of the packed stream (rows with start, ids), and the same a token later.

    A window starts at a place in [lo, hi - block - 1) that the draw's hash picks, in the middle of a row or across
    any number of them; hi is the stream's end where it isn't given.  Places are looked up by interval: each
    belongs to one block of `width` tokens, which reaches `block` tokens into the next ones and so holds the window.  Only
    blocks with a draw are put together.
    """
    if hi is None:
        hi = rows.agg(F.max(F.col("start") + F.size(ids))).first()[0] or 0
    if hi - block - 1 <= lo:
        raise ValueError(f"no window of {block} tokens and the next one begins in [{lo}, {hi})")
    width = width or max(4 * block, 4096)
    place = T.hash_long(seed, F.col("draw")) % (hi - block - 1 - lo) + lo
    drawn = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("place", place).withColumn("block_id", F.floor(F.col("place") / width))
    t = drawn.join(blocks(rows, ids, width, block, only=drawn), "block_id")
    within = (F.col("place") - F.col("block_id") * width).cast("int")
    return t.select("draw", "place", F.slice("ids", within + 1, block).alias("inputs"), F.slice("ids", within + 2, block).alias("targets"))


def estimate(windows: DataFrame, loss: Column, batch: Column) -> DataFrame:
    """One row: loss, the mean over batches of the mean loss of a batch's windows, and batches, their number."""
    each = windows.groupBy(batch.alias("batch")).agg(F.avg(loss).alias("loss"))
    return each.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("batches"))


def corpus_distinct_n(rows: DataFrame, tokens: str, n: int, block: int = 4096) -> DataFrame:
    """One row, distinct_n, over the concatenation of rows (start, tokens): n-grams may cross rows.

    Blocks that reach n - 1 tokens into the next one hold each gram once; grams are counted before they are shuffled.
    """
    t = blocks(rows, tokens, block, n - 1).where(F.size("ids") >= n)
    grams = t.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(block), F.size("ids") - n + 1)), lambda i: F.slice("ids", i, n))).alias("g"))
    each = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.try_divide(F.count(F.lit(1)), F.sum("n")), F.lit(0.0)).alias("distinct_n"))


def corpus_distinct_n_sketch(rows: DataFrame, tokens: str, n: int, *, lg: int = 14, block: int = 4096) -> DataFrame:
    """One row, distinct_n, error, sketch: as corpus_distinct_n, by a HyperLogLog sketch of 2**lg registers.

    A gram leaves its block as a 64-bit hash, which the sketch of the task takes in at once; what is shuffled is a
    sketch a task.  error is the relative standard error of the number of distinct grams; sketches of other
    stretches of a stream can be united with `hll_union`.
    """
    t = blocks(rows, tokens, block, n - 1).where(F.size("ids") >= n)
    last = F.least(F.lit(block), F.size("ids") - n + 1)
    grams = t.select(F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("ids", i, n)))).alias("g"))
    each = grams.agg(F.hll_sketch_agg("g", lg).alias("sketch"), F.count(F.lit(1)).alias("n"))
    share = F.coalesce(F.try_divide(F.hll_sketch_estimate("sketch"), F.col("n")), F.lit(0.0))
    return each.select(share.cast("double").alias("distinct_n"), F.lit(1.04 / math.sqrt(1 << lg)).alias("error"), "sketch")


def corpus_meta(rows: DataFrame, ids: str, vocab: int, eot: int, tokenizer: str) -> DataFrame:
    return rows.agg(F.lit(vocab).alias("vocab_size"), F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("num_stories"), F.lit(eot).alias("eot_id"), F.lit(tokenizer).alias("tokenizer_path"))

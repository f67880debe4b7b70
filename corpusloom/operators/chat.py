"""Chat rows, label masks and padding."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(question: Column, answer: Column) -> Column:
    return F.array(turn("user", question), turn("assistant", answer))


def instruction_messages(instruction: Column, extra: Column, output: Column) -> Column:
    """The input is appended on a line of its own unless it is blank."""
    more = F.when(T.strip(F.coalesce(extra, F.lit(""))) != "", F.concat(F.lit("\n"), extra)).otherwise("")
    return messages(F.concat(instruction, more), output)


def template(chat: Column) -> Column:
    """<|role|>content of each turn, one per line."""
    return F.array_join(F.transform(chat, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"])), "\n")


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, q, a: user turns that an assistant turn follows at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = conversations.withColumns({"next_role": F.lead("role").over(w), "a": F.lead("text").over(w)})
    return t.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("q"), "a")


def mask_labels(ids: Column, prompt: Column, ignore: int = -100) -> Column:
    """ids with the first min(prompt, size) positions replaced."""
    m = F.least(prompt, F.size(ids))
    return F.concat(F.array_repeat(F.lit(ignore), m), F.slice(ids, m + 1, F.size(ids) - m))


def pad_batches(rows: DataFrame, ids: str, batch: str, pad: int = 0) -> DataFrame:
    """ids filled up to the longest of the batch, and attention_mask."""
    n = F.max(F.size(ids)).over(Window.partitionBy(batch))
    t = rows.select(F.struct("*").alias("row"), n.alias("n"))
    own = F.col("row")[ids]
    more = F.col("n") - F.size(own)
    filled = [F.concat(own, F.array_repeat(F.lit(pad), more)).alias(c) if c == ids else F.col("row")[c].alias(c) for c in rows.columns]
    return t.select(*filled, F.concat(F.array_repeat(F.lit(1), F.size(own)), F.array_repeat(F.lit(0), more)).alias("attention_mask"))


def collate(rows: DataFrame, batch: str, collator: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Each batch of rows through a user's collator.  A batch is one task's, so it must be a bounded number of rows."""
    return rows.groupBy(batch).applyInPandas(collator, schema)


def budget_batches(rows: DataFrame, size: Column, key: Column, budget: int, *, step: int = 16, seed: str = "42", digits: int = 3) -> DataFrame:
    """Adds batch, batch_order: rows of like length together, a padded batch within `budget` tokens.

    A row's width is its size rounded up to `step` (1 to 16 by powers of two).  Rows of one width, in the order of their
    keys' hashes, fill batches of budget // width rows, so one that is padded to its longest row stays within the budget,
    the padding of a row is under `step` tokens, and all batches of a width but its last are full.  A row above the budget is a
    batch of its own.  batch_order is a number by which to sort the batches: seeded, and unlike their lengths.

    `key` must be unique.  Places within a width are counted in two levels, within the leading `digits` digits of the hash and over
    their counts, so that a width that holds most rows isn't one task's.
    """
    n = F.greatest(size.cast("bigint"), F.lit(1))
    width = F.when(n > 8, F.ceil(n / step) * step).when(n > 4, 8).when(n > 2, 4).otherwise(n).cast("bigint")
    t = rows.select(F.struct("*").alias("row"), width.alias("width"), T.hash_order(seed, key).alias("h"))
    t = t.withColumn("bin", F.substring("h", 1, digits))
    bins = t.groupBy("width", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("width").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("width", "bin", F.coalesce(before, F.lit(0)).alias("before"))
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("width", "bin").orderBy("h")) - 1).join(bins, ["width", "bin"])
    rows_each = F.greatest(F.floor(F.lit(budget) / F.col("width")), F.lit(1))
    number = F.floor((F.col("before") + F.col("place")) / rows_each).cast("bigint")
    t = t.withColumn("batch", F.concat_ws("-", "width", number.cast("string")))
    return t.select("row.*", "batch", T.hash_long(seed, F.col("batch")).alias("batch_order"))

"""Rule verifiers, rewards, rejection sampling and preference pairs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def domain_reward(completion: Column, keywords: Column, ood: Column, markers: tuple[str, ...] = T.REFUSAL_MARKERS) -> Column:
    """+1 for a refusal out of domain or a keyword hit within, else -1."""
    good = F.when(ood, T.is_refusal(completion, markers)).otherwise(T.contains_any(completion, keywords))
    return F.when(good, 1.0).otherwise(-1.0)


def brevity_reward(completion: Column, limit: int = 80, value: float = 0.1) -> Column:
    return F.when(F.length(T.strip(completion)) <= limit, value).otherwise(0.0)


def math_reward(completion: Column, answer: Column) -> Column:
    return F.when(T.has_whole_number(completion, answer), 1.0).otherwise(0.0)


def verifier_score(completion: Column, keywords: Column, ood: Column, markers: tuple[str, ...] = T.REFUSAL_MARKERS) -> Column:
    return domain_reward(completion, keywords, ood, markers) + brevity_reward(completion)


#: Rewards by name: each takes the row's columns (completion, keywords, ood, answer).
REWARDS: dict[str, Callable[[dict[str, Column]], Column]] = {
    "domain": lambda c: domain_reward(c["completion"], c["keywords"], c["ood"]),
    "brevity": lambda c: brevity_reward(c["completion"]),
    "math": lambda c: math_reward(c["completion"], c["answer"]),
    "verifier": lambda c: verifier_score(c["completion"], c["keywords"], c["ood"]),
}


def register_reward(name: str, reward: Callable[[dict[str, Column]], Column]) -> None:
    """Adds a reward: an expression, or a pandas UDF applied to the columns."""
    REWARDS[name] = reward


def with_rewards(rows: DataFrame, *names: str) -> DataFrame:
    """Adds reward_<name> for each and their sum, reward."""
    cols = {c: F.col(c) for c in rows.columns}
    each = {f"reward_{n}": REWARDS[n](cols) for n in names}
    total = sum((F.col(c) for c in each), F.lit(0.0))
    return rows.withColumns(each).withColumn("reward", total)


def rejection_sample(completions: DataFrame, min_score: float = 1.0, markers: tuple[str, ...] = T.REFUSAL_MARKERS) -> DataFrame:
    """Completions (q, keywords, ood, intent, completion, ...) that score min_score or more, as new samples."""
    score = verifier_score(F.col("completion"), F.col("keywords"), F.col("ood"), markers)
    return completions.withColumn("score", score).where(F.col("score") >= min_score)


def preference_pairs(prompts: DataFrame, completions: DataFrame, key: str = "qid", markers: tuple[str, ...] = T.REFUSAL_MARKERS) -> DataFrame:
    """prompt, chosen, rejected: the gold answer against the worst completion, where it scores strictly less.

    Ties among the worst go to the smallest text in code-point order.  The worst is a plain
    minimum of structs, so it is combined before the shuffle.
    """
    scored = completions.join(prompts.select(key, "keywords", "ood"), key)
    scored = scored.select(key, F.struct(verifier_score(F.col("completion"), F.col("keywords"), F.col("ood"), markers).alias("s"), F.col("completion").alias("c")).alias("x"))
    worst = scored.groupBy(key).agg(F.min("x").alias("worst"))
    gold = verifier_score(F.col("a"), F.col("keywords"), F.col("ood"), markers)
    return prompts.join(worst, key).where(F.col("worst.s") < gold).select(key, F.col("q").alias("prompt"), F.col("a").alias("chosen"), F.col("worst.c").alias("rejected"))


def group_advantage(rows: DataFrame, group: str, reward: str, eps: float = 1e-4) -> DataFrame:
    """Adds advantage: the reward less its group's mean, over the group's deviation."""
    w = Window.partitionBy(group)
    return rows.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + eps))


def rl_prompts(rows: DataFrame) -> DataFrame:
    """prompt, answer_keywords, ood of samples (q, keywords, ood)."""
    return rows.select(F.col("q").alias("prompt"), F.col("keywords").alias("answer_keywords"), "ood")


def map_rows(rows: DataFrame, column: str, function: Callable[[str], str]) -> DataFrame:
    """column through a user's Python function, in Arrow batches; prefer an expression where there is one."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else function(x))

    return rows.withColumn(column, run(F.col(column)))

"""Synthetic questions, and completions from pluggable providers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusloom.functions import text as T

#: A provider answers a batch of prompts; None means that a call failed.
Provider = Callable[[list[str]], list[str | None]]


def arithmetic(rows: DataFrame, *, seed: str = "42") -> DataFrame:
    """qid, prompt, answer: a sum or a non-negative difference of numbers from 1 to 99 for each of rows (qid, unique)."""
    a, b = (T.hash_int(seed + s, F.col("qid")) % 99 + 1 for s in "ab")
    t = rows.select("qid", a.alias("a"), b.alias("b"), (T.hash_int(seed + "op", F.col("qid")) % 2 == 0).alias("plus"))
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    prompt = F.when(F.col("plus"), F.concat_ws(" + ", F.col("a").cast("string"), F.col("b").cast("string"))).otherwise(F.concat_ws(" - ", hi.cast("string"), lo.cast("string")))
    return t.select("qid", prompt.alias("prompt"), F.when(F.col("plus"), F.col("a") + F.col("b")).otherwise(hi - lo).cast("string").alias("answer"))


def math_questions(spark: SparkSession, n: int, *, seed: str = "42") -> DataFrame:
    """n of them, qid from 0."""
    return arithmetic(spark.range(n).withColumnRenamed("id", "qid"), seed=seed)


def evolve_prompt(q: Column, a: Column, n: int) -> Column:
    """Asks for n variants of a question and answer, as a JSON list."""
    return F.concat(F.lit(f"请把下面的客服问答改写成 {n} 个不同问法的变体。问题:"), q, F.lit(" 答案:"), a, F.lit(' 只输出 JSON 数组,形如 [{"question": "...", "answer": "..."}]。'))


def judge_prompt(q: Column, a: Column, resp: Column) -> Column:
    return F.concat(F.lit("请按 1 到 5 分给客服回答打分,只输出数字。问题:"), q, F.lit(" 标准答案:"), a, F.lit(" 回答:"), resp)


def complete(prompts: DataFrame, provider: Provider, *, k: int = 1, batch: int = 64) -> DataFrame:
    """prompts (prompt, ...) with k and completion (null where a call failed), k rows for each prompt.

    Providers aren't deterministic: write the result to a table before it is used twice.
    """
    schema = StructType([*prompts.schema.fields, StructField("k", IntegerType()), StructField("completion", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                for j in range(k):
                    yield part.assign(k=j, completion=provider(part["prompt"].tolist()))

    return prompts.mapInPandas(run, schema)


def http_provider(url: str, model: str, key: str, *, temperature: float = 0.8, max_tokens: int = 1024, timeout: int = 60) -> Provider:
    """A chat-completion service; failed calls give None and aren't repeated."""

    def ask(prompts: list[str]) -> list[str | None]:
        import json
        from urllib.request import Request, urlopen

        out: list[str | None] = []
        for p in prompts:
            body = json.dumps({"model": model, "messages": [{"role": "user", "content": p}], "temperature": temperature, "max_tokens": max_tokens}).encode()
            try:
                with urlopen(Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}), timeout=timeout) as r:
                    out.append(json.load(r)["choices"][0]["message"]["content"])
            except (OSError, ValueError, KeyError):
                out.append(None)
        return out

    return ask


def fixed_provider(answers: dict[str, str], default: str | None = None) -> Provider:
    """Looks prompts up: for tests and replays."""
    return lambda prompts: [answers.get(p, default) for p in prompts]


def credential(name: str, env_file: str = ".env") -> str | None:
    """A key from the environment, else from key=value lines of a file of the driver."""
    if name in os.environ:
        return os.environ[name]
    if Path(env_file).exists():
        for line in Path(env_file).read_text().splitlines():
            k, eq, v = line.strip().partition("=")
            if eq and k.strip() == name:
                return v.strip().strip("'\"")
    return None


def variants(completions: DataFrame, source: str, keep: Sequence[str] = ()) -> DataFrame:
    """The items of JSON replies as samples that inherit intent, keywords, ood and the columns `keep`; blank or unparsable replies give none."""
    t = completions.withColumn("items", T.json_items(F.col("completion"))).where(F.size(F.coalesce("items", F.array().cast("array<struct<question:string,answer:string>>"))) > 0)
    t = t.withColumn("item", F.explode("items"))
    q, a = (T.strip(F.coalesce(F.col(f"item.{c}"), F.lit(""))) for c in ("question", "answer"))
    return t.select(*keep, "intent", q.alias("q"), a.alias("a"), "keywords", "ood", F.lit(source).alias("source"))

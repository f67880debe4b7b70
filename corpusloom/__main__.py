"""Command line: python -m corpusloom COMMAND ...  Paths are anything that Spark reads and writes."""

from __future__ import annotations

import argparse
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import clean, evaluate, expand, runlog, sample, score, tokens
from corpusloom.sources import catalog, generators, journal, readers, writers

CHAT_URL = "CHAT_URL"


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    """Seeds and templates, merged with extra files: gated, deduplicated, split, and reported."""
    seeds = readers.jsonl(spark, a.seeds).drop("source") if a.seeds else catalog.seeds(spark).drop("ord")
    raw = expand.expand(seeds, catalog.products(spark), catalog.toppings(spark), catalog.topics(spark), catalog.REFUSALS)
    if a.extra_file:
        raw = readers.with_extras(raw, a.extra_file)
    # First come the templates in their order, then the files; within them the hash of the row is an order as good as any.
    raw = raw.withColumn("ord", F.struct(F.col("prefix_id").isNull().alias("extra"), F.coalesce("prefix_id", F.lit(0)).alias("prefix"), F.xxhash64("origin", "intent", "q", "a").alias("h")))
    kept = clean.build_corpus(raw, dedup=a.dedup).cache()
    writers.jsonl(kept.drop("ord", "prefix_id", "origin"), a.out, by="split")
    writers.document(clean.corpus_stats(raw, kept, seeds.count()), a.stats)


def answered(prompts: DataFrame, key: str, provider: generators.Provider, path: str | None) -> DataFrame:
    """prompts with completion; those that the journal at path has aren't asked for again."""
    return journal.complete(prompts, key, provider, path)[0] if path else generators.complete(prompts, provider)


def evolve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Variants of a stratified sample of seeds, by a chat-completion service."""
    seeds = sample.stratified(readers.jsonl(spark, a.seeds), "intent", a.sample, F.concat_ws("|", "q", "a"))
    prompts = seeds.withColumns({"prompt": generators.evolve_prompt(F.col("q"), F.col("a"), a.variants), "key": F.md5(F.concat_ws("|", "q", "a"))})
    provider = generators.http_provider(os.environ[CHAT_URL], a.model, generators.credential("CHAT_API_KEY") or "")
    done = generators.variants(answered(prompts, "key", provider, a.journal), "evolved")
    names = F.array(*(F.lit(p[0]) for p in catalog.PRODUCTS))
    good = done.where(clean.quality_gate(F.col("q"), F.col("a"), F.col("keywords"), names))
    writers.jsonl(clean.first_wins(good, [T.normalize(F.col("q"))], [F.xxhash64("q", "a")]), a.out)


def responses(spark: SparkSession, a: argparse.Namespace):
    """Test rows with the models' responses: JSONL of (model, q, resp)."""
    resp = spark.read.schema("model string, q string, resp string").json(a.responses)
    return evaluate.judged(readers.jsonl(spark, a.data_file).join(resp, "q"))


def evaluation(spark: SparkSession, a: argparse.Namespace) -> None:
    """The Markdown report of all models."""
    rows = responses(spark, a)
    rows = rows.where("ood") if a.ood_only else rows
    shown = sample.head_per_group(rows, "model", 5, F.col("q")).withColumn("ord", F.row_number().over(Window.partitionBy("model").orderBy("q")))
    shown = shown.withColumn("outcome", evaluate.outcome(F.col("hit"), F.col("refused")))
    judge = None
    if a.judgements:
        judge = evaluate.judge_mean(spark.read.schema("model string, q string, score int").json(a.judgements))
    writers.markdown(spark, evaluate.report_text(evaluate.report(evaluate.metrics(rows), judge, shown)), a.report)


def rft(spark: SparkSession, a: argparse.Namespace) -> None:
    """Responses that the verifier accepts, as new samples."""
    t = responses(spark, a).withColumnRenamed("resp", "completion")
    kept = score.rejection_sample(t, a.min_score)
    writers.jsonl(kept.select("intent", "q", F.col("completion").alias("a"), "keywords", "ood", F.lit("onpolicy").alias("source")), a.out)


def pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Gold answers against the worst response."""
    rows = readers.jsonl(spark, a.data_file).withColumn("qid", F.xxhash64("q", "a"))
    resp = spark.read.schema("model string, q string, resp string").json(a.responses)
    comps = rows.select("qid", "q").join(resp, "q").select("qid", F.col("resp").alias("completion"))
    writers.jsonl(score.preference_pairs(rows, comps).drop("qid"), a.out)


def prompts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prompts for reinforcement learning, rebalanced to a share out of domain."""
    rows = sample.rebalance(readers.jsonl(spark, a.data_file), "ood", a.ood_ratio, F.concat_ws("|", "q", "a"))
    writers.jsonl(score.rl_prompts(rows), a.out)


def questions(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.jsonl(generators.math_questions(spark, a.num_questions, seed=a.seed), a.out)


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    """A service's answers to the prompts that try a model out."""
    provider = generators.http_provider(os.environ[CHAT_URL], a.model, generators.credential("CHAT_API_KEY") or "", temperature=a.temperature, max_tokens=a.max_new_tokens)
    writers.jsonl(answered(catalog.prompts(spark), "ord", provider, a.journal), a.out)


def encode(spark: SparkSession, a: argparse.Namespace) -> None:
    """Texts as one stream of token ids in flat binary files, with a sidecar of totals."""
    texts = spark.read.parquet(a.data_file).select(F.col(a.key).alias("key"), F.coalesce(a.text, F.lit("")).alias("text"))
    spec = Path(a.tokenizer).read_text()
    vocab = max(t["id"] for t in json.loads(spec)["added_tokens"] + [{"id": k} for k in json.loads(spec)["model"]["vocab"].values()]) + 1
    scratch = f"{a.out}/_ids"
    tokens.packed(tokens.bpe_encode(texts, spec), "ids", a.end).select("key", "ids").write.mode("overwrite").parquet(scratch)
    ids = spark.read.parquet(scratch)
    stream = tokens.with_offsets(ids, F.size("ids"), "key")
    writers.token_file(tokens.blocks(stream, "ids", a.block), f"{a.out}/tokens", "<u2" if vocab <= 1 << 16 else "<u4")
    writers.document(tokens.corpus_meta(ids, "ids", vocab, a.end, a.tokenizer), f"{a.out}/meta.json")


def generated(spark: SparkSession, a: argparse.Namespace) -> None:
    """How varied generated texts (JSONL of key, text) are: distinct-1 to distinct-3 over all of them."""
    t = spark.read.schema("key long, text string").json(a.data_file).select("key", tokens.whitespace_tokens(F.col("text")).alias("w"))
    t = tokens.with_offsets(t, F.size("w"), "key").cache()
    lines = [f"distinct-{n}: {tokens.corpus_distinct_n(t, 'w', n).first().distinct_n:.4f}" for n in (1, 2, 3)]
    writers.markdown(spark, "\n".join(lines), a.report)


def scaling(spark: SparkSession, a: argparse.Namespace) -> None:
    """The scaling table of run logs."""
    runlog.scaling_table(readers.run_logs(spark, a.logs)).show(1000, truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(run, *args: tuple, name: str | None = None) -> None:
        c = sub.add_parser(name or run.__name__, help=run.__doc__)
        c.set_defaults(run=run)
        for flags, options in args:
            c.add_argument(flags, **options)

    need = {"required": True}
    data, resp, out, seeds = ("--data-file", need), ("--responses", need), ("--out", need), ("--seeds", need)
    command(build, ("--seeds", {}), out, ("--stats", need), ("--extra-file", {"action": "append", "default": []}), ("--dedup", {"choices": ["qa", "q"], "default": "qa"}))
    kept = ("--journal", {"help": "a folder in shared storage that remembers answers across runs"})
    command(evolve, seeds, out, kept, ("--sample", {"type": int, "default": 30}), ("--variants", {"type": int, "default": 3}), ("--model", need))
    command(evaluation, data, resp, ("--report", need), ("--ood-only", {"action": "store_true"}), ("--judgements", {}), name="evaluate")
    command(rft, data, resp, out, ("--min-score", {"type": float, "default": 1.0}))
    command(pairs, data, resp, out)
    command(prompts, data, out, ("--ood-ratio", {"type": float, "default": 0.2}))
    command(questions, out, ("--num-questions", {"type": int, "default": 50}), ("--seed", {"default": "2026"}))
    command(infer, out, kept, ("--model", need), ("--temperature", {"type": float, "default": 0.7}), ("--max-new-tokens", {"type": int, "default": 256}))
    command(encode, data, out, ("--tokenizer", need), ("--key", need), ("--text", {"default": "text"}), ("--end", {"type": int, "default": 0}), ("--block", {"type": int, "default": 1 << 20}))
    command(generated, data, ("--report", need))
    command(scaling, ("--logs", need))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("corpusloom").getOrCreate(), a)


if __name__ == "__main__":
    main()

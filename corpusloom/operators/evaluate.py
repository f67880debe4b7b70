"""Metrics of models over a test set, and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def judged(rows: DataFrame, markers: tuple[str, ...] = T.REFUSAL_MARKERS) -> DataFrame:
    """Adds hit and refused to rows (resp, keywords)."""
    return rows.withColumns({"hit": T.contains_any(F.col("resp"), F.col("keywords")), "refused": T.is_refusal(F.col("resp"), markers)})


def metrics(rows: DataFrame) -> DataFrame:
    """model, domain_acc, refusal_rate, overall_acc, miss_rate, avg_len, samples of rows (model, resp, hit, refused, ood): one pass for all models."""
    ood, hit, refused = F.col("ood"), F.col("hit"), F.col("refused")
    n, n_ood = F.count(F.lit(1)), F.count_if(ood)
    good, caught = F.count_if(~ood & hit), F.count_if(ood & refused)
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    return rows.groupBy("model").agg(
        (good / at_least_one(n - n_ood)).alias("domain_acc"),
        (caught / at_least_one(n_ood)).alias("refusal_rate"),
        ((good + caught) / at_least_one(n)).alias("overall_acc"),
        (F.count_if(~ood & ~hit) / at_least_one(n - n_ood)).alias("miss_rate"),
        (F.sum(F.length("resp")) / at_least_one(n)).alias("avg_len"),
        n.alias("samples"),
    )


def best(table: DataFrame, metric: str = "overall_acc", order: str = "model") -> DataFrame:
    """The row with the largest metric; the first by `order` among equals."""
    return table.orderBy(F.desc(metric), order).limit(1)


def judge_mean(scores: DataFrame) -> DataFrame:
    """model, mean, n of scores (model, score): failed judgements (null or 0) don't count."""
    return scores.where("score IS NOT NULL AND score <> 0").groupBy("model").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))


def exact_match(rows: DataFrame) -> DataFrame:
    """model, accuracy, n of rows (model, resp, ans): the last integer of resp is ans."""
    return rows.groupBy("model").agg(F.avg(T.last_integer(F.col("resp")).eqNullSafe(F.col("ans")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def outcome(hit: Column, refused: Column) -> Column:
    return F.when(refused, "refused").when(hit, "hit").otherwise("miss")


def each_model(questions: DataFrame, models: Sequence[str]) -> DataFrame:
    """questions x models (model_id, model): the models are a literal, so nothing is joined."""
    return questions.select("*", F.posexplode(F.array(*map(F.lit, models))).alias("model_id", "model"))


def accuracy_delta(table: DataFrame, first: str, second: str) -> DataFrame:
    """One row: the accuracies of two models (model, accuracy) and what the second gains, in points."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("accuracy")))
    t = table.agg(of(first).alias("first"), of(second).alias("second"))
    return t.select("first", "second", T.points(F.col("second") - F.col("first")).alias("gain"))


def side_by_side(first: DataFrame, second: DataFrame, key: str = "qid", width: int = 100) -> DataFrame:
    """The two answers (key, resp) to the same question, cut to `width` characters."""
    l, r = (t.select(key, F.left("resp", F.lit(width)).alias(name)) for t, name in ((first, "first"), (second, "second")))
    return l.join(r, key)


def side_by_side_lines(pairs: DataFrame, key: str = "qid") -> DataFrame:
    """One Markdown line for each pair."""
    flat = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" "))
    return pairs.select(key, F.concat(F.lit("| "), F.col(key).cast("string"), F.lit(" | "), flat("first"), F.lit(" | "), flat("second"), F.lit(" |")).alias("line"))


def report_lines(table: DataFrame) -> DataFrame:
    """One Markdown line for each row of metrics."""
    p = [T.percent(F.col(c)) for c in ("domain_acc", "refusal_rate", "overall_acc", "miss_rate")]
    return table.select("model", F.concat(F.lit("| "), "model", *(x for c in p for x in (F.lit(" | "), c)), F.lit(" | "), T.fixed(F.col("avg_len")), F.lit(" |")).alias("line"))


def report(table: DataFrame, judge: DataFrame | None = None, examples: DataFrame | None = None) -> DataFrame:
    """part, ord, line of the whole report: metrics, the best model, the judge's means, and examples (model, ord, outcome, resp).

    It has a few rows a model; sorted by part and ord, its lines are the Markdown text.
    """
    head = lambda part, *lines: [(part, f"0{k}", x) for k, x in enumerate(lines)]
    fixed = head(0, "| model | domain | refusal | overall | miss | length |", "| --- | --- | --- | --- | --- | --- |")
    key = lambda *c: F.concat(F.lit("1"), *(x for y in c for x in (F.lit("|"), y)))
    top = best(table).select(F.lit(1).alias("part"), F.lit("0").alias("ord"), F.concat(F.lit("Best: "), "model", F.lit(" ("), T.percent(F.col("overall_acc")), F.lit(")")).alias("line"))
    parts = [report_lines(table).select(F.lit(0).alias("part"), key(F.col("model")).alias("ord"), "line"), top]
    if judge is not None:
        fixed += head(2, "| model | judge | n |", "| --- | --- | --- |")
        parts.append(judge.select(F.lit(2).alias("part"), key(F.col("model")).alias("ord"), F.concat(F.lit("| "), "model", F.lit(" | "), T.fixed(F.col("mean"), 2), F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line")))
    if examples is not None:
        parts.append(examples.select(F.lit(3).alias("part"), key(F.col("model"), F.lpad(F.col("ord").cast("string"), 3, "0")).alias("ord"), F.concat(F.lit("* "), "model", F.lit(" ["), "outcome", F.lit("] "), F.replace(F.left("resp", F.lit(120)), F.lit("\n"), F.lit(" "))).alias("line")))
    out = table.sparkSession.createDataFrame(fixed, "part int, ord string, line string")
    for p in parts:
        out = out.unionByName(p)
    return out


def report_text(report: DataFrame) -> str:
    return "\n".join(r.line for r in report.orderBy("part", "ord").collect())

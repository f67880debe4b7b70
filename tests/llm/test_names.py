"""Every operator beside columns whose names clash with those that it needs, but for their case, or hold dots."""

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import conversation_repair, decontaminate, filter_audit, line_quality, mixing, ngram_join, personal_data, quality_rules, suffix_dedup, token_counts, toxicity

from .cases import PROSE, docs

NAMES = ("TEXT", "Doc_Id", "LANG", "Source", "a.b", "doc_id.text", "c0")


def more(df):
    return df.select("*", *(F.lit("x").alias(n) for n in NAMES))


LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 0, 1)]
RUNS = {
    "suffix_dedup": lambda d, lab: suffix_dedup.digest(d),
    "mixing": lambda d, lab: mixing.mix_plan(d),
    "decontamination": lambda d, lab: decontaminate.digest(d, d.sparkSession.createDataFrame([(1, PROSE)], "item_id long, text string")),
    "toxicity": lambda d, lab: toxicity.scored(d, toxicity.train(d, lab)),
    "personal_data": lambda d, lab: personal_data.find(d),
    "line_quality": lambda d, lab: line_quality.scored(d, line_quality.train(d, lab)),
    "quality_rules": lambda d, lab: quality_rules.apply_rules(d, lab),
    "ngram_join": lambda d, lab: ngram_join.near_duplicates(d).drop("key"),
    "filter_audit": lambda d, lab: filter_audit.audit(d, lab),
    "token_counts": lambda d, lab: token_counts.count_tokens(d, token_counts.default_model()),
}


@pytest.mark.parametrize("name", list(RUNS))
def test_clashing_names_change_nothing(spark, name):
    d = docs(spark, [(k, PROSE * (k % 3) + f" {k}") for k in range(8)])
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = sorted(map(tuple, RUNS[name](d, labels).collect()), key=repr)
    assert sorted(map(tuple, RUNS[name](more(d), labels).collect()), key=repr) == want


def test_conversations(spark):
    t = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "user", "B.")], "conv_id long, turn long, role string, text string")
    wide = t.select("*", *(F.lit("x").alias(n) for n in ("ROLE", "Text", "conv_id.turn", "Turn")))
    assert conversation_repair.repair(wide).collect() == conversation_repair.repair(t).collect()
    assert conversation_repair.damage(wide).collect() == conversation_repair.damage(t).collect()

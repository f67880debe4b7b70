"""The engine's own queries, each over its whole tables, with the SQL that gives the same rows.

Bindings: question/answer samples are user turns of `conversations` with the assistant turn that
follows; keywords are the first three words of four letters or more of an answer; every fifth
conversation counts as out of domain; completions are the assistant turns of the conversation;
products are `part`; run logs are `events` (user_id is the run, event_id the order).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import text as T
from corpusloom.operators import chat, clean, evaluate, expand, runlog, sample, score, tokens
from corpusloom.sources import generators
from corpusloom.streaming import runlog as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MARKERS = ("thth", "erer", "ciónci")
Q_RANGE, A_RANGE = (4, 400), (5, 1000)
WS = T.PY_WS

QA = "qa AS (SELECT conv_id, turn, conv_id * 1000 + turn AS qid, text AS q, a, list_slice(regexp_extract_all(a, '[A-Za-z]{4,}'), 1, 3) AS keywords, conv_id % 5 = 0 AS ood FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"
COMP = QA + ", comp AS (SELECT qa.*, c.turn AS k, c.text AS completion FROM qa JOIN conversations c ON c.conv_id = qa.conv_id AND c.role = 'assistant')"
REFUSED = "({0} LIKE '%thth%' OR {0} LIKE '%erer%' OR {0} LIKE '%ciónci%')"
HIT = "coalesce(list_bool_or([contains({0}, x) for x in keywords]), false)"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def norm_sql(c: str) -> str:
    return f"regexp_replace({c}, '{WS}', '', 'g')"


def _verifier(c: str) -> str:
    good = f"CASE WHEN ood THEN {REFUSED.format(c)} ELSE {HIT.format(c)} END"
    return f"(CASE WHEN {good} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END + CASE WHEN length({strip_sql(c)}) <= 80 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    t = chat.qa_pairs(read(spark, sf, "conversations"))
    words = F.slice(F.regexp_extract_all("a", F.lit("[A-Za-z]{4,}"), F.lit(0)), 1, 3)
    return t.withColumns({"qid": F.col("conv_id") * 1000 + F.col("turn"), "keywords": words, "ood": F.col("conv_id") % 5 == 0})


def completions(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", F.col("turn").alias("k"), F.col("text").alias("completion"))
    return samples(spark, sf).join(c, "conv_id")


def products(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select((F.col("p_partkey") - 1).alias("ord"), F.col("p_name").alias("name"), F.floor("p_retailprice").cast("int").alias("price"), F.split("p_type", " ").alias("tags"))


PROD = "prod AS (SELECT p_partkey - 1 AS ord, p_name AS name, floor(p_retailprice)::INT AS price, string_split(p_type, ' ') AS tags FROM part)"


def _values(templates) -> str:
    return ", ".join(f"({k}, '{t}')" for k, t in enumerate(templates))


# ---- text and cleaning

SPLIT = "CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END"


@query(f"""
WITH g AS (SELECT doc_id, lang, source, text, {norm_sql('text')} AS nt FROM documents WHERE length(text) >= 5),
u AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY nt ORDER BY doc_id) = 1),
s AS (SELECT lang, {SPLIT} AS split, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '42', doc_id::VARCHAR))) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM u))
SELECT lang, split, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM s GROUP BY lang, split
""")
def corpus_build(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").where(F.length("text") >= 5)
    unique = clean.first_wins(docs.select("doc_id", "lang", "text"), [T.normalize(F.col("text"))], [F.col("doc_id")])
    return clean.stratified_split(unique, "lang", F.col("doc_id")).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5, length({norm_sql('text')}) AS n FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    n = T.normalize(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("n"))


@query(f"WITH {QA} SELECT conv_id, turn FROM qa WHERE length(q) BETWEEN 4 AND 400 AND length(a) BETWEEN 5 AND 1000")
def length_gate(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).where(clean.length_gate(F.col("q"), F.col("a"), Q_RANGE, A_RANGE)).select("conv_id", "turn")


@query(f"WITH {QA} SELECT qid FROM qa WHERE length(q) BETWEEN 4 AND 400 AND length(a) BETWEEN 5 AND 1000 QUALIFY row_number() OVER (PARTITION BY {norm_sql('q')}, {norm_sql('a')} ORDER BY qid) = 1")
def dedup_first_qa(spark: SparkSession, sf: str) -> DataFrame:
    gated = samples(spark, sf).where(clean.length_gate(F.col("q"), F.col("a"), Q_RANGE, A_RANGE))
    return clean.first_wins(gated, [T.normalize(F.col("q")), T.normalize(F.col("a"))], [F.col("qid")]).select("qid")


@query(f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {norm_sql('text')} ORDER BY doc_id) = 1")
def dedup_first_q(spark: SparkSession, sf: str) -> DataFrame:
    return clean.first_wins(read(spark, sf, "documents").select("doc_id", "text"), [T.normalize(F.col("text"))], [F.col("doc_id")]).select("doc_id")


STRAT = f"SELECT doc_id, lang, {SPLIT} AS split FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '42', doc_id::VARCHAR))) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


@query(STRAT)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return clean.stratified_split(read(spark, sf, "documents").select("doc_id", "lang"), "lang", F.col("doc_id"))


@query(f"SELECT lang, split, count(*) AS n FROM ({STRAT}) GROUP BY lang, split")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(spark, sf).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT conv_id, ('0x' || substr(md5(concat_ws('|', '42', conv_id::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM conversations)")
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    return clean.split_by_group(read(spark, sf, "conversations").select("conv_id").distinct(), F.col("conv_id"))


@query("SELECT count(*) AS n, sum(toxic)::BIGINT AS n_ood, round(sum(toxic) / greatest(count(*), 1)::DOUBLE, 3) AS ood_ratio FROM labels")
def ood_ratio(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count(F.lit(1))
    return read(spark, sf, "labels").agg(n.alias("n"), F.sum("toxic").cast("bigint").alias("n_ood"), F.round(F.sum("toxic") / F.greatest(n, F.lit(1)), 3).alias("ood_ratio"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {QA}, g AS (SELECT * FROM qa WHERE length(q) BETWEEN 4 AND 400 AND length(a) BETWEEN 5 AND 1000 QUALIFY row_number() OVER (PARTITION BY {norm_sql('q')}, {norm_sql('a')} ORDER BY qid) = 1),
s AS (SELECT *, {SPLIT} AS split FROM (SELECT *, row_number() OVER (PARTITION BY ood ORDER BY md5(concat_ws('|', '42', qid::VARCHAR))) AS rn, count(*) OVER (PARTITION BY ood) AS n FROM g))
SELECT (SELECT count(*) FROM qa) AS raw_count, (SELECT count(*) FROM qa) - count(*) AS dedup_dropped, count(*) AS final_count, round(count(*) / 55.0::DOUBLE, 1) AS expansion_ratio,
  count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test, round(count_if(ood) / greatest(count(*), 1)::DOUBLE, 3) AS ood_ratio FROM s
""")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    raw = samples(spark, sf).withColumns({"intent": F.col("ood").cast("string"), "ord": F.col("qid"), "origin": F.lit("conversations")})
    kept = clean.build_corpus(raw, q_range=Q_RANGE, a_range=A_RANGE)
    return clean.corpus_stats(raw, kept, 55).select("raw_count", "dedup_dropped", "final_count", "expansion_ratio", "split.*", "ood_ratio")


# ---- expansion and sampling


@query(f"WITH {PROD} SELECT ord, t.k AS tpl_id, replace(t.t, '{{name}}', name) AS q, concat(name, ' ', price::VARCHAR, ' 元一杯。') AS a, price::VARCHAR AS keywords FROM prod, (VALUES {_values(expand.PRICE)}) t(k, t)")
def price_templates(spark: SparkSession, sf: str) -> DataFrame:
    return expand.price_questions(products(spark, sf)).select("ord", "tpl_id", "q", "a", F.array_join("keywords", ",").alias("keywords"))


@query(f"WITH {PROD}, tag AS (SELECT ord, name, price, i - 1 AS tag_id, tags[i] AS tag FROM prod, (VALUES (1), (2)) n(i) WHERE i <= len(tags)) SELECT ord, tag_id, t.k AS tpl_id, replace(t.t, '{{tag}}', tag) AS q, concat('推荐', name, ',', price::VARCHAR, ' 元一杯。') AS a, name AS keywords FROM tag, (VALUES {_values(expand.RECOMMEND)}) t(k, t)")
def tag_templates(spark: SparkSession, sf: str) -> DataFrame:
    return expand.recommend_questions(products(spark, sf)).select("ord", "tag_id", "tpl_id", "q", "a", F.array_join("keywords", ",").alias("keywords"))


@query(f"WITH {PROD} SELECT ord, t.k AS tpl_id, replace(t.t, '{{name}}', name) AS q, CASE WHEN t.k < 3 THEN concat('可以,', name, ' 可以选择糖度,包括无糖和半糖。') ELSE concat('可以,', name, ' 支持去冰;部分饮品可做热饮。') END AS a, CASE WHEN t.k < 3 THEN '无糖,半糖' ELSE '去冰' END AS keywords FROM prod, (VALUES {_values(expand.SUGAR + expand.ICE)}) t(k, t) WHERE ord < 4")
def hot_customize(spark: SparkSession, sf: str) -> DataFrame:
    return expand.customize_questions(products(spark, sf)).select("ord", "tpl_id", "q", "a", F.array_join("keywords", ",").alias("keywords"))


@query(f"WITH {QA} SELECT qid, t.k AS prefix_id, replace(t.t, '{{q}}', q) AS q FROM qa, (VALUES {_values(expand.PARAPHRASE)}) t(k, t)")
def paraphrase(spark: SparkSession, sf: str) -> DataFrame:
    return expand.paraphrase(samples(spark, sf).select("qid", "q")).select("qid", "prefix_id", "q")


@query("SELECT p_partkey AS ord, concat('加', p_name, '多少钱?') AS q, concat('加', p_name, '加 ', floor(p_retailprice)::INT::VARCHAR, ' 元。') AS a, floor(p_retailprice)::INT::VARCHAR AS keywords FROM part")
def topping_templates(spark: SparkSession, sf: str) -> DataFrame:
    t = products(spark, sf).select((F.col("ord") + 1).alias("ord"), "name", "price")
    return expand.topping_questions(t).select("ord", "q", "a", F.array_join("keywords", ",").alias("keywords"))


@query(f"WITH {QA} SELECT origin, count(*) AS n, count(source) AS n_source FROM (SELECT q, 'conversations' AS origin, NULL AS source FROM qa UNION ALL SELECT text, 'benchmark', 'extra' FROM benchmark) GROUP BY origin")
def union_extra(spark: SparkSession, sf: str) -> DataFrame:
    extra = read(spark, sf, "benchmark").select(F.col("text").alias("q"), F.lit("benchmark").alias("origin"), F.lit("extra").alias("source"))
    all_ = expand.union_all([samples(spark, sf).select("q", F.lit("conversations").alias("origin")), extra])
    return all_.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("source").alias("n_source"))


@query("SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', '42', doc_id::VARCHAR)) LIMIT 16")
def sample_k(spark: SparkSession, sf: str) -> DataFrame:
    return sample.simple(read(spark, sf, "documents").select("doc_id"), 16, F.col("doc_id"))


@query("SELECT doc_id, CASE ('0x' || substr(md5(concat_ws('|', '42', doc_id::VARCHAR)), 1, 8))::BIGINT % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS pick FROM documents")
def choice_hash(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", sample.choice(F.array(*map(F.lit, "xyz")), F.col("doc_id")).alias("pick"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, md5(concat_ws('|', '42', doc_id::VARCHAR)) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h) <= greatest(1, 30 // (SELECT count(DISTINCT lang) FROM documents))) ORDER BY lang, h LIMIT 30")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.stratified(read(spark, sf, "documents").select("doc_id", "lang"), "lang", 30, F.col("doc_id"))


@query("WITH c AS (SELECT count_if(toxic = 1) AS y, count_if(toxic = 0) AS n FROM labels) SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id::VARCHAR))) AS rn FROM labels WHERE toxic = 0) WHERE rn <= (SELECT least(n, floor(y * (1 - 0.2::DOUBLE) / 0.2::DOUBLE)) FROM c)")
def rebalance_ood(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "labels").select("doc_id", "toxic", (F.col("toxic") == 1).alias("ood"))
    return sample.rebalance(t, "ood", 0.2, F.col("doc_id")).select("doc_id", "toxic")


@query(f"WITH {QA} SELECT qid, q FROM qa ORDER BY qid LIMIT 20")
def head_limit(spark: SparkSession, sf: str) -> DataFrame:
    return sample.head(samples(spark, sf), 20, F.col("qid")).select("qid", "q")


@query(f"WITH {QA} SELECT 'domain' AS origin, qid AS id FROM qa UNION ALL SELECT 'general', item_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark) WHERE rn <= (SELECT floor(count(*) * 0.2::DOUBLE) FROM qa)")
def mix_general(spark: SparkSession, sf: str) -> DataFrame:
    general = read(spark, sf, "benchmark").select(F.lit("general").alias("origin"), F.col("item_id").alias("id"))
    return sample.mix_in(samples(spark, sf).select(F.lit("domain").alias("origin"), F.col("qid").alias("id")), general, 0.2, F.col("id"))


def _h(seed: str, key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {key}::VARCHAR)), 1, 8))::BIGINT"


@query(f"WITH t AS (SELECT event_id AS qid, {_h('42a', 'event_id')} % 99 + 1 AS a, {_h('42b', 'event_id')} % 99 + 1 AS b, {_h('42op', 'event_id')} % 2 = 0 AS plus FROM events) SELECT qid, CASE WHEN plus THEN a::VARCHAR || ' + ' || b::VARCHAR ELSE greatest(a, b)::VARCHAR || ' - ' || least(a, b)::VARCHAR END AS prompt, CASE WHEN plus THEN a + b ELSE greatest(a, b) - least(a, b) END::VARCHAR AS answer FROM t")
def math_questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question for every event."""
    return generators.arithmetic(read(spark, sf, "events").select(F.col("event_id").alias("qid")))


# ---- verifiers and alignment


@query(f"WITH {COMP} SELECT qid, k, {HIT.format('completion')} AS hit FROM comp")
def keyword_hit(spark: SparkSession, sf: str) -> DataFrame:
    return completions(spark, sf).select("qid", "k", T.contains_any(F.col("completion"), F.col("keywords")).alias("hit"))


@query(f"SELECT doc_id, {REFUSED.format('text')} AS refused FROM documents")
def refusal_flag(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.is_refusal(F.col("text"), MARKERS).alias("refused"))


@query("SELECT page_id, TRY_CAST(regexp_extract_all(url, '-?[0-9]+')[-1] AS BIGINT) AS last FROM pages")
def last_int(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", T.last_integer(F.col("url")).alias("last"))


@query("SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '[0-9]+'), '') AS BIGINT) AS first FROM pages")
def first_int(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", T.first_integer(F.col("url")).alias("first"))


@query("SELECT page_id, regexp_matches(url, '(^|[^0-9])' || (page_id % 100)::VARCHAR || '([^0-9]|$)') AS found FROM pages")
def whole_number(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", T.has_whole_number(F.col("url"), (F.col("page_id") % 100).cast("string")).alias("found"))


@query("SELECT event_id, regexp_matches(props, '[0-9]') AS found FROM events")
def any_digit(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", T.has_digit(F.col("props")).alias("found"))


@query("SELECT item_id, n, question FROM (SELECT item_id, i AS n, CASE WHEN item_id % 7 = 3 THEN NULL ELSE 'q' || i::VARCHAR || '-' || item_id::VARCHAR END AS question FROM benchmark, (VALUES (0), (1), (2)) v(i) WHERE item_id % 5 <> 0) WHERE question IS NOT NULL")
def json_items(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("item_id").cast("string")
    item = lambda i: F.concat(F.lit(f'{{"question": "q{i}-'), key, F.lit('", "answer": "a"}'))
    body = F.concat(F.lit("Here you are:\n```json\n["), F.concat_ws(",\n", *(item(i) for i in range(3))), F.lit("]\n``` done"))
    # Every fifth call failed: a null reply, which the operator gives no items.
    reply = F.when(F.col("item_id") % 5 == 0, F.lit(None)).when(F.col("item_id") % 7 == 3, F.concat(F.lit("[{"), key)).otherwise(body)
    t = read(spark, sf, "benchmark").select("item_id", F.posexplode(T.json_items(reply)).alias("n", "item"))
    return t.select("item_id", "n", F.col("item.question").alias("question"))


@query(f"WITH {QA} SELECT qid, length(q) >= 4 AND length(a) >= 5 AND ({HIT.format('a')} OR contains(a, 'thing') OR contains(a, 'oder') OR regexp_matches(a, '[0-9]')) AS pass FROM qa")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("thing"), F.lit("oder"))
    return samples(spark, sf).select("qid", clean.quality_gate(F.col("q"), F.col("a"), F.col("keywords"), names).alias("pass"))


@query(f"WITH {COMP} SELECT qid, k, CASE WHEN CASE WHEN ood THEN {REFUSED.format('completion')} ELSE {HIT.format('completion')} END THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS reward FROM comp")
def domain_reward(spark: SparkSession, sf: str) -> DataFrame:
    return completions(spark, sf).select("qid", "k", score.domain_reward(F.col("completion"), F.col("keywords"), F.col("ood"), MARKERS).alias("reward"))


@query(f"WITH {COMP} SELECT qid, k, CASE WHEN length({strip_sql('completion')}) <= 80 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM comp")
def brevity_reward(spark: SparkSession, sf: str) -> DataFrame:
    return completions(spark, sf).select("qid", "k", score.brevity_reward(F.col("completion")).alias("reward"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(^|[^0-9])' || (page_id % 50)::VARCHAR || '([^0-9]|$)') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM pages")
def math_reward(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", score.math_reward(F.col("html"), (F.col("page_id") % 50).cast("string")).alias("reward"))


@query(f"WITH {COMP} SELECT qid, k, {_verifier('completion')} AS score FROM comp")
def verifier_score(spark: SparkSession, sf: str) -> DataFrame:
    return completions(spark, sf).select("qid", "k", score.verifier_score(F.col("completion"), F.col("keywords"), F.col("ood"), MARKERS).alias("score"))


@query(f"WITH {COMP} SELECT qid, k, completion, 'onpolicy' AS source FROM comp WHERE {_verifier('completion')} >= 1.0::DOUBLE")
def rejection_sampling(spark: SparkSession, sf: str) -> DataFrame:
    return score.rejection_sample(completions(spark, sf), 1.0, MARKERS).select("qid", "k", "completion", F.lit("onpolicy").alias("source"))


@query(f"WITH {COMP}, c AS (SELECT q, {_verifier('completion')} >= 1.0::DOUBLE AS ok FROM comp) SELECT count(*) AS total, count_if(ok) AS passed, count_if(NOT ok) AS failed, count_if(ok) / greatest(count(*), 1)::DOUBLE AS pass_rate FROM c")
def sampling_counts(spark: SparkSession, sf: str) -> DataFrame:
    ok = score.verifier_score(F.col("completion"), F.col("keywords"), F.col("ood"), MARKERS) >= 1.0
    n = F.count(F.lit(1))
    return completions(spark, sf).agg(n.alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), (F.count_if(ok) / F.greatest(n, F.lit(1))).alias("pass_rate"))


@query(f"WITH {COMP}, w AS (SELECT qid, min(struct_pack(s := {_verifier('completion')}, c := completion)) AS x FROM comp GROUP BY qid) SELECT qid, q AS prompt, a AS chosen, x.c AS rejected FROM qa JOIN w USING (qid) WHERE x.s < {_verifier('a')}")
def preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = completions(spark, sf).select("qid", "completion")
    return score.preference_pairs(samples(spark, sf), c, markers=MARKERS)


@query(f"WITH {COMP}, s AS (SELECT qid, k, {_verifier('completion')} AS r FROM comp) SELECT qid, k, round((r - avg(r) OVER w) / (coalesce(stddev_samp(r) OVER w, 0) + 0.0001::DOUBLE), 6) AS advantage FROM s WINDOW w AS (PARTITION BY qid)")
def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    t = score.group_advantage(verifier_score(spark, sf), "qid", "score")
    return t.select("qid", "k", F.round("advantage", 6).alias("advantage"))


# ---- evaluation and chat


@query(f"WITH {QA} SELECT conv_id, turn, q, a FROM qa")
def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return chat.qa_pairs(read(spark, sf, "conversations"))


@query(f"WITH {QA} SELECT qid, concat('<|user|>', q, chr(10), '<|assistant|>', a) AS chat, 2 AS turns FROM qa")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = chat.messages(F.col("q"), F.col("a"))
    return samples(spark, sf).select("qid", chat.template(m).alias("chat"), F.size(m).alias("turns"))


@query(f"WITH {QA} SELECT qid, concat(q, CASE WHEN qid % 2 = 0 AND {strip_sql('a')} <> '' THEN concat(chr(10), a) ELSE '' END) AS content FROM qa")
def instruction_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = chat.instruction_messages(F.col("q"), F.when(F.col("qid") % 2 == 0, F.col("a")), F.lit("-"))
    return samples(spark, sf).select("qid", m[0]["content"].alias("content"))


RESP = COMP + f", resp AS (SELECT *, 'm' || (k % 3)::VARCHAR AS model, completion AS resp, {HIT.format('completion')} AS hit, {REFUSED.format('completion')} AS refused FROM comp)"
METRICS = "SELECT model, count_if(NOT ood AND hit) / greatest(count_if(NOT ood), 1)::DOUBLE AS domain_acc, count_if(ood AND refused) / greatest(count_if(ood), 1)::DOUBLE AS refusal_rate, (count_if(NOT ood AND hit) + count_if(ood AND refused)) / greatest(count(*), 1)::DOUBLE AS overall_acc, count_if(NOT ood AND NOT hit) / greatest(count_if(NOT ood), 1)::DOUBLE AS miss_rate, sum(length(resp))::BIGINT / greatest(count(*), 1)::DOUBLE AS avg_len, count(*) AS samples FROM resp GROUP BY model"


def responses(spark: SparkSession, sf: str) -> DataFrame:
    t = completions(spark, sf).withColumns({"model": F.concat(F.lit("m"), (F.col("k") % 3).cast("string")), "resp": F.col("completion")})
    return evaluate.judged(t, MARKERS)


@query(f"WITH {RESP} {METRICS}")
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.metrics(responses(spark, sf))


@query(f"WITH {RESP}, m AS ({METRICS}) SELECT model, overall_acc FROM m ORDER BY overall_acc DESC, model LIMIT 1")
def eval_best(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.best(eval_metrics(spark, sf)).select("model", "overall_acc")


@query(f"WITH {RESP}, j AS (SELECT model, CASE WHEN length(resp) % 6 = 5 THEN NULL ELSE length(resp) % 6 END AS score FROM resp QUALIFY row_number() OVER (PARTITION BY model ORDER BY md5(concat_ws('|', '0', qid::VARCHAR, k::VARCHAR))) <= 15) SELECT model, avg(score) AS mean, count(*) AS n FROM j WHERE score IS NOT NULL AND score <> 0 GROUP BY model")
def judge_mean(spark: SparkSession, sf: str) -> DataFrame:
    s = F.length("resp") % 6
    t = responses(spark, sf).withColumns({"score": F.when(s != 5, s), "h": T.hash_order("0", F.col("qid"), F.col("k"))})
    return evaluate.judge_mean(sample.head_per_group(t, "model", 15, F.col("h")))


@query("SELECT 'm' || (page_id % 3)::VARCHAR AS model, avg((TRY_CAST(regexp_extract_all(url, '-?[0-9]+')[-1] AS BIGINT) IS NOT DISTINCT FROM page_id)::INT) AS accuracy, count(*) AS n FROM pages GROUP BY 1")
def math_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "pages").select(F.concat(F.lit("m"), (F.col("page_id") % 3).cast("string")).alias("model"), F.col("url").alias("resp"), F.col("page_id").alias("ans"))
    return evaluate.exact_match(t)


SIDE = COMP + ", fs AS (SELECT l.qid, left(l.completion, 100) AS first, left(r.completion, 100) AS second FROM comp l JOIN comp r ON l.qid = r.qid AND l.k = 2 AND r.k = 4)"


def answers(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The answers of one model: those at turn k."""
    return completions(spark, sf).where(F.col("k") == k).select("qid", F.col("completion").alias("resp"))


@query(f"WITH {SIDE} SELECT * FROM fs")
def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.side_by_side(answers(spark, sf, 2), answers(spark, sf, 4))


@query(f"WITH {SIDE} SELECT qid, '| ' || qid::VARCHAR || ' | ' || replace(first, chr(10), ' ') || ' | ' || replace(second, chr(10), ' ') || ' |' AS line FROM fs")
def side_by_side_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.side_by_side_lines(side_by_side(spark, sf))


@query(f"WITH {RESP} SELECT model, qid, left(resp, 120) AS resp, CASE WHEN refused THEN 'refused' WHEN hit THEN 'hit' ELSE 'miss' END AS outcome FROM resp QUALIFY row_number() OVER (PARTITION BY model ORDER BY qid, k) <= 5")
def eval_examples(spark: SparkSession, sf: str) -> DataFrame:
    t = sample.head_per_group(responses(spark, sf), "model", 5, F.col("qid"), F.col("k"))
    return t.select("model", "qid", F.left("resp", F.lit(120)).alias("resp"), evaluate.outcome(F.col("hit"), F.col("refused")).alias("outcome"))


@query(f"WITH {RESP}, m AS ({METRICS}) SELECT model, format('| {{}} | {{:.1f}}% | {{:.1f}}% | {{:.1f}}% | {{:.1f}}% | {{:.1f}} |', model, domain_acc * 100, refusal_rate * 100, overall_acc * 100, miss_rate * 100, avg_len) AS line FROM m")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report_lines(eval_metrics(spark, sf))


# ---- tokens and logs

TOK = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(f"WITH t AS (SELECT doc_id, {TOK} AS w FROM documents), g AS (SELECT doc_id, len(w) AS n, [list_slice(w, i, i + 1) for i in range(1, len(w))] AS g FROM t) SELECT doc_id, CASE WHEN n >= 2 THEN len(list_distinct(g)) / len(g)::DOUBLE ELSE 0.0::DOUBLE END AS distinct_2 FROM g")
def distinct_n(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tokens.whitespace_tokens(F.col("text")).alias("w")).select("doc_id", A.distinct_n(F.col("w"), 2).alias("distinct_2"))


def conversation_tokens(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("conv_id") * 1000 + F.col("turn")
    return read(spark, sf, "conversations").select(key.alias("key"), tokens.whitespace_tokens(F.col("text")).alias("w"))


CTOK = f"t AS (SELECT conv_id * 1000 + turn AS key, {TOK} AS w FROM conversations)"


@query(f"WITH {CTOK}, f AS (SELECT key, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM t), o AS (SELECT tok, lead(tok) OVER (ORDER BY key, i) AS nxt FROM f) SELECT round(count(DISTINCT tok || ' ' || nxt) / count(nxt)::DOUBLE, 9) AS distinct_n FROM o WHERE nxt IS NOT NULL")
def corpus_distinct_n(spark: SparkSession, sf: str) -> DataFrame:
    t = tokens.with_offsets(conversation_tokens(spark, sf), F.size("w"), "key")
    return tokens.corpus_distinct_n(t, "w", 2).select(F.round("distinct_n", 9).alias("distinct_n"))


OFFS = f"{CTOK}, o AS (SELECT key, w, coalesce(sum(len(w) + 1) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t)"


def packed(spark: SparkSession, sf: str) -> DataFrame:
    """Words stand for ids: their lengths, with 0 as the end."""
    t = conversation_tokens(spark, sf).select("key", F.transform("w", lambda x: F.length(x)).alias("ids"))
    return tokens.with_offsets(tokens.packed(t, "ids", 0), F.size("ids"), "key")


@query(f"WITH {OFFS} SELECT key, start, len(w) + 1 AS n FROM o")
def pack_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf).select("key", "start", F.size("ids").cast("bigint").alias("n"))


@query(f"WITH {OFFS} SELECT CASE WHEN start + len(w) + 1 > (SELECT sum(len(w) + 1) FROM t) - 2000 THEN 'eval' ELSE 'train' END AS part, count(*) AS n FROM o GROUP BY 1")
def token_holdout(spark: SparkSession, sf: str) -> DataFrame:
    t = packed(spark, sf)
    total = t.agg(F.sum(F.size("ids"))).first()[0]
    return tokens.hold_out(t, F.size("ids"), total, 2000).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


BLOCKS = f"{OFFS}, x AS (SELECT start + i - 1 AS pos, CASE WHEN i <= len(w) THEN length(w[i]) ELSE 0 END AS tok FROM o, LATERAL (SELECT unnest(range(1, len(w) + 2)) AS i)), b AS (SELECT pos // 256 AS block_id, list(tok ORDER BY pos) AS ids FROM x GROUP BY 1)"


@query(f"WITH {BLOCKS} SELECT block_id, len(ids) AS n, array_to_string(ids, ' ') AS ids FROM b")
def fixed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.blocks(packed(spark, sf), "ids", 256).select("block_id", F.size("ids").cast("bigint").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(f"WITH {BLOCKS} SELECT block_id, list_sum(list_slice(ids, 1, len(ids) - 1))::BIGINT AS x_sum, list_sum(list_slice(ids, 2, len(ids)))::BIGINT AS y_sum FROM b WHERE len(ids) > 1")
def next_token(spark: SparkSession, sf: str) -> DataFrame:
    x, y = tokens.next_token(F.col("ids"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: s + v)
    return tokens.blocks(packed(spark, sf), "ids", 256).where(F.size("ids") > 1).select("block_id", add(x).alias("x_sum"), add(y).alias("y_sum"))


@query(f"WITH {QA}, t AS (SELECT qid, [length(x) for x in list_filter(regexp_split_to_array(q || ' ' || a, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')] AS ids, len(list_filter(regexp_split_to_array(q, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS m FROM qa) SELECT qid, array_to_string([CASE WHEN i <= m THEN -100 ELSE ids[i] END for i in range(1, len(ids) + 1)], ' ') AS labels FROM t")
def label_mask(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda c: F.transform(tokens.whitespace_tokens(c), lambda x: F.length(x))
    t = samples(spark, sf).select("qid", size(F.concat_ws(" ", "q", "a")).alias("ids"), F.size(size(F.col("q"))).alias("m"))
    return t.select("qid", F.array_join(F.transform(chat.mask_labels(F.col("ids"), F.col("m")), lambda x: x.cast("string")), " ").alias("labels"))


@query(f"WITH {CTOK}, p AS (SELECT key, len(w) AS n, max(len(w)) OVER (PARTITION BY key // 1000) AS top, list_sum([length(x) for x in w])::BIGINT AS total FROM t) SELECT key, top AS size, n AS ones, coalesce(total, 0)::BIGINT AS total FROM p")
def pad_batch(spark: SparkSession, sf: str) -> DataFrame:
    t = conversation_tokens(spark, sf).select("key", F.floor(F.col("key") / 1000).alias("batch"), F.transform("w", lambda x: F.length(x)).alias("ids"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: s + v)
    return chat.pad_batches(t, "ids", "batch").select("key", F.size("ids").cast("bigint").alias("size"), add(F.col("attention_mask")).alias("ones"), add(F.col("ids")).alias("total"))


@query("SELECT user_id, event_id, value, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM events WHERE value IS NOT NULL")
def best_so_far(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "events").where("value IS NOT NULL").select("user_id", "event_id", "value")
    return runlog.best_so_far(t, "user_id", "event_id", "value")


@query("SELECT user_id, event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS tokens_seen FROM events")
def cum_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "events").select("user_id", "event_id", F.length("props").alias("n"))
    return runlog.cumulative(t, "user_id", "event_id", F.col("n")).select("user_id", "event_id", F.col("tokens_seen").cast("bigint").alias("tokens_seen"))


EVENTS = "SELECT user_id AS run, event_id AS ord, CASE event_id % 3 WHEN 0 THEN 'meta' WHEN 1 THEN 'train' ELSE 'eval' END AS type, event_id % 7 AS step, event_id AS n_params, value AS val_loss FROM events"


def log_events(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "meta").when(i % 3 == 1, "train").otherwise("eval")
    return read(spark, sf, "events").select(F.col("user_id").alias("run"), i.alias("ord"), kind.alias("type"), (i % 7).alias("step"), i.alias("n_params"), F.col("value").alias("val_loss"))


@query(f"WITH e AS ({EVENTS}), t AS (SELECT run, arg_min(n_params, ord) FILTER (type = 'meta') AS n_params, arg_max(val_loss, ord) FILTER (type = 'eval') AS val_loss FROM e GROUP BY run) SELECT * FROM t WHERE n_params IS NOT NULL AND val_loss IS NOT NULL")
def scaling_table(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.scaling_table(log_events(spark, sf))


@query(f"WITH e AS ({EVENTS}) SELECT run, step, val_loss AS value FROM e WHERE type = 'train'")
def loss_curve(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.curve(log_events(spark, sf), "train", "val_loss")


@query("SELECT event_id, event_id % 10 = 0 AS log, event_id > 0 AND event_id % 50 = 0 AS eval FROM events")
def cadence(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return read(spark, sf, "events").select("event_id", runlog.every(i, 10, from_zero=True).alias("log"), runlog.every(i, 50, from_zero=False).alias("eval"))


@query("SELECT user_id, round(avg(value), 6) AS mean_loss, count(value) AS n FROM events GROUP BY user_id")
def mean_loss(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.mean_loss(read(spark, sf, "events"), "user_id", "value").select("user_id", F.round("mean_loss", 6).alias("mean_loss"), "n")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the driver and all executors see; only in local mode may it be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@query("SELECT user_id::VARCHAR AS run, event_id AS ord, value AS loss, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM events WHERE value IS NOT NULL")
def stream_best_so_far(spark: SparkSession, sf: str) -> DataFrame:
    schema = read(spark, sf, "events").schema
    t = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", "events.parquet").load(sf)
    t = t.where("value IS NOT NULL").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("ord"), F.col("value").alias("loss"))
    return stream.replay(stream.running_best(t), scratch(spark, "stream-out"), scratch(spark, "stream-checkpoint"))


# ---- numeric kernels

PROBE = "e AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _probe(c: Column) -> Column:
    """A position-weighted sum, rounded: one number that stands for an array."""
    return F.round(A.total(F.transform(c, lambda x, i: x * (i + 1))), 6)


PROBE_SQL = "round(list_sum([o[i] * i for i in range(1, len(o) + 1)]), 6)"


@query(f"WITH {PROBE}, m AS (SELECT vec_id, v, list_avg(v) AS mu FROM e), s AS (SELECT *, list_avg([(x - mu) * (x - mu) for x in v]) AS var FROM m), r AS (SELECT vec_id, [(x - mu) / sqrt(var + 1e-5) for x in v] AS o FROM s) SELECT vec_id, {PROBE_SQL} AS probe FROM r")
def layer_norm(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", _probe(A.layer_norm(F.col("v"))).alias("probe"))


@query(f"WITH {PROBE}, r AS (SELECT vec_id, [x / (sqrt(list_avg([y * y for y in v])) + 1e-5) for x in v] AS o FROM e) SELECT vec_id, {PROBE_SQL} AS probe FROM r")
def rms_norm(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", _probe(A.rms_norm(F.col("v"))).alias("probe"))


@query(f"WITH {PROBE}, m AS (SELECT vec_id, [exp(x - list_max(v)) for x in v] AS x FROM e), r AS (SELECT vec_id, [y / list_sum(x) for y in x] AS o FROM m) SELECT vec_id, {PROBE_SQL} AS probe FROM r")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", _probe(A.softmax(F.col("v"))).alias("probe"))


@query(f"WITH {PROBE} SELECT vec_id, len([x for x in v if x >= list_sort(v)[-8]]) AS kept, round(list_sum([x for x in v if x >= list_sort(v)[-8]]), 6) AS total FROM e")
def topk_mask(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.filter(A.top_k(F.col("v"), 8), lambda x: x > float("-inf"))
    return vectors(spark, sf).select("vec_id", F.size(kept).cast("bigint").alias("kept"), F.round(A.total(kept), 6).alias("total"))


@query(f"WITH {PROBE}, r AS (SELECT vec_id, [CASE WHEN i <= 32 THEN v[i] * cos((vec_id % 128) / pow(10000.0::DOUBLE, 2 * (i - 1) / 64.0::DOUBLE)) - v[i + 32] * sin((vec_id % 128) / pow(10000.0::DOUBLE, 2 * (i - 1) / 64.0::DOUBLE)) ELSE v[i - 32] * sin((vec_id % 128) / pow(10000.0::DOUBLE, 2 * (i - 33) / 64.0::DOUBLE)) + v[i] * cos((vec_id % 128) / pow(10000.0::DOUBLE, 2 * (i - 33) / 64.0::DOUBLE)) END for i in range(1, 65)] AS o FROM e) SELECT vec_id, {PROBE_SQL} AS probe FROM r")
def rope(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", _probe(A.rope(F.col("v"), (F.col("vec_id") % 128).cast("double"), 64)).alias("probe"))


@query("SELECT vec_id, h AS heads, i AS head, round(pow(2.0::DOUBLE, -8.0::DOUBLE * i / h), 9) AS slope FROM (SELECT vec_id, vec_id % 8 + 1 AS h FROM embeddings), (SELECT unnest(range(1, 9)) AS i) b WHERE i <= h")
def alibi(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 8 + 1).alias("heads"))
    t = t.select("vec_id", "heads", F.posexplode(A.alibi_slopes(F.col("heads"))).alias("i", "s"))
    return t.select("vec_id", "heads", (F.col("i") + 1).cast("bigint").alias("head"), F.round("s", 9).alias("slope"))


@query("SELECT event_id AS step, round(CASE WHEN event_id < 1000 THEN 0.0006::DOUBLE * (event_id + 1) / 1000.0::DOUBLE ELSE 0.0006::DOUBLE * 0.5 * (1 + cos(pi() * ((event_id - 1000) / 99000.0::DOUBLE))) END, 12) AS lr FROM events")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """The rate at each event's step."""
    return read(spark, sf, "events").select(F.col("event_id").alias("step"), F.round(A.learning_rate(F.col("event_id"), 0.0006, 1000, 100000), 12).alias("lr"))


@query("WITH t AS (SELECT p_partkey, 4096 + p_partkey AS v, 64 * p_size AS c, 1 + p_partkey % 12 AS l, 8 AS h, CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 1 END AS k, 256 AS b FROM part) SELECT p_partkey, k AS kv_heads, (v * c + b * c + l * (2 * c * c + 2 * c * c * k // h + 8 * c * c + 2 * c) + c)::BIGINT AS n FROM t")
def param_count(spark: SparkSession, sf: str) -> DataFrame:
    """A model for each part: its size is the width."""
    key = F.col("p_partkey")
    kv = F.when(key % 3 == 0, 8).when(key % 3 == 1, 4).otherwise(1)
    width = (F.lit(64) * F.col("p_size")).cast("bigint")
    n = A.parameter_count(4096 + key, width, 1 + key % 12, F.lit(8), kv, F.lit(256))
    return read(spark, sf, "part").select("p_partkey", kv.alias("kv_heads"), n.alias("n"))


# ---- plain analytics on the star tables, for benchmarks


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


from corpusloom.plans import kernels, storage  # noqa: E402, F401  (their queries are registered on import)

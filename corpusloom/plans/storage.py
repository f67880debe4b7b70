"""Queries over what the engine writes and reads back, its literal tables, providers and reports."""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chat, clean, evaluate, expand, match, sample, score, tokens
from corpusloom.plans.registry import COMP, CTOK, HIT, METRICS, OFFS, QA, RESP, SQL, WS, completions, conversation_tokens, eval_metrics, judge_mean, packed, products, query, read, responses, samples, scratch
from corpusloom.sources import catalog, generators, journal, readers, writers
from corpusloom.streaming import ordered, sink
from corpusloom.streaming import runlog as stream

# ---- files


@query(f"WITH {QA} SELECT qid, q, a, array_to_string(keywords, ',') AS keywords, ood FROM qa")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    writers.jsonl(samples(spark, sf).select("qid", "q", "a", "keywords", "ood"), path, by="ood")
    back = readers.jsonl(spark, path, "qid long, q string, a string, keywords array<string>, ood boolean")
    return back.withColumn("keywords", F.array_join("keywords", ","))


@query("SELECT item_id, text FROM benchmark")
def jsonl_blank_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every third line of the file is followed by a blank one."""
    path = scratch(spark, "lines")
    line = F.to_json(F.struct("item_id", "text"))
    lines = read(spark, sf, "benchmark").select(F.explode(F.when(F.col("item_id") % 3 == 0, F.array(line, F.lit(""), F.lit("  "))).otherwise(F.array(line))).alias("value"))
    lines.write.text(path)
    return readers.jsonl(spark, path, "item_id long, text string")


@query("SELECT doc_id, quality, toxic FROM labels")
def json_inferred(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "inferred")
    writers.jsonl(read(spark, sf, "labels"), path)
    return readers.jsonl_inferred(spark, path).select("doc_id", "quality", "toxic")


@query("SELECT doc_id, 'limit' AS of FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25) UNION ALL SELECT min(doc_id), 'zero' FROM documents")
def limited_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A limit is tested after a row is taken, so 0 gives one row."""
    d = read(spark, sf, "documents").select("doc_id")
    return readers.first_rows(d, 25, "doc_id").withColumn("of", F.lit("limit")).unionByName(readers.first_rows(d, 0, "doc_id").withColumn("of", F.lit("zero")))


@query("SELECT doc_id, length(text) AS n FROM documents ORDER BY doc_id LIMIT 100")
def first_stories(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of many files in the order of their names."""
    path = scratch(spark, "stories")
    docs = read(spark, sf, "documents").select("doc_id", "text")
    docs.repartitionByRange(16, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return readers.first_stories(spark, path, 100).select("doc_id", F.length("text").alias("n"))


@query(f"""
WITH {QA}, x AS (
  SELECT 'base' AS origin, q, a, ood::VARCHAR AS intent, NULL AS source FROM qa
  UNION ALL SELECT 'evolved', q, a, NULL, 'evolved' FROM qa WHERE ood
  UNION ALL SELECT 'onpolicy', q, NULL, ood::VARCHAR, NULL FROM qa WHERE NOT ood
  UNION ALL SELECT 'judged', text, NULL, NULL, 'judge' FROM benchmark)
SELECT origin, md5(q) AS q, md5(a) AS a, intent, source FROM x
""")
def merged_files(spark: SparkSession, sf: str) -> DataFrame:
    """Samples and three files with columns of their own, each row under its file's stem."""
    t = samples(spark, sf).select("q", "a", F.col("ood").cast("string").alias("intent"), "ood")
    base, folder = t.drop("ood"), scratch(spark, "extra")
    extras = {
        "evolved": t.where("ood").select("q", "a", F.lit("evolved").alias("source")),
        "onpolicy": t.where("NOT ood").select("q", "intent"),
        "judged": read(spark, sf, "benchmark").select(F.col("text").alias("q"), F.lit("judge").alias("source"), "item_id"),
    }
    for name, rows in extras.items():
        writers.jsonl(rows, f"{folder}/{name}.jsonl")
    merged = readers.with_extras(base.withColumn("origin", F.lit("base")), [f"{folder}/{n}.jsonl" for n in extras], "q string, a string, intent string, source string")
    return merged.select("origin", F.md5("q").alias("q"), F.md5("a").alias("a"), "intent", "source")


@query("SELECT least(count(*), 50) AS n, least(count(*), 50) AS rows_of_the_corpus FROM documents")
def corpus_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows a limit gives is open: they are counted, and those that the corpus holds."""
    docs = read(spark, sf, "documents")
    got = readers.parquet_sample(spark, f"{sf}/documents.parquet", 50).select("doc_id", F.md5("text").alias("h"))
    known = docs.select("doc_id", F.md5("text").alias("h"), F.lit(1).alias("known"))
    return got.join(known, ["doc_id", "h"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("rows_of_the_corpus"))


@query("SELECT 'run=' || (user_id % 4)::VARCHAR AS run, CASE event_id % 2 WHEN 0 THEN 'train' ELSE 'eval' END AS type, count(*) AS n, sum(event_id)::BIGINT AS steps FROM events GROUP BY 1, 2")
def run_log_glob(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "logs")
    i = F.col("event_id")
    events = read(spark, sf, "events").select((F.col("user_id") % 4).alias("run"), F.when(i % 2 == 0, "train").otherwise("eval").alias("type"), i.cast("int").alias("step"))
    events.write.partitionBy("run").json(path)
    t = readers.run_logs(spark, f"{path}/run=*/*.json")
    return t.groupBy("run", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("step").cast("bigint").alias("steps"))


@query("SELECT event_id, 2::BIGINT AS times FROM events")
def event_log_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "events")
    e = read(spark, sf, "events").select("event_id")
    for _ in range(2):
        writers.append_events(e, path)
    return spark.read.schema("event_id long").json(path).groupBy("event_id").agg(F.count(F.lit(1)).alias("times"))


@query(f"WITH {CTOK} SELECT 4096 AS vocab_size, sum(len(w) + 1)::BIGINT AS total_tokens, count(*) AS num_stories, 0 AS eot_id, 'words' AS tokenizer_path FROM t")
def meta_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """Totals written as one JSON document and read back."""
    path = f"{scratch(spark, 'meta')}/meta.json"
    writers.document(tokens.corpus_meta(packed(spark, sf), "ids", 4096, 0, "words"), path)
    return readers.sidecar(spark, path, "vocab_size int, total_tokens long, num_stories long, eot_id int, tokenizer_path string")


@query(f"WITH {OFFS}, x AS (SELECT start + i - 1 AS pos, CASE WHEN i <= len(w) THEN length(w[i]) ELSE 0 END AS tok FROM o, LATERAL (SELECT unnest(range(1, len(w) + 2)) AS i)) SELECT count(*) AS n, sum(tok)::BIGINT AS total, sum(tok * (pos % 1009))::BIGINT AS weighed FROM x")
def token_file(spark: SparkSession, sf: str) -> DataFrame:
    """The stream as flat binary files, read back in stretches of 100 ids by their own bytes."""
    path = scratch(spark, "tokens")
    writers.token_file(tokens.blocks(packed(spark, sf), "ids", 512), path)
    t = readers.token_file(spark, path, 100).select(F.posexplode("ids").alias("i", "tok"), F.col("place").alias("at"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("total"), F.sum(F.col("tok") * ((F.col("at") + F.col("i")) % 1009)).cast("bigint").alias("weighed"))


# ---- literal tables, each row of a given table taking one of their rows


def _quoted(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()


def _values_of(rows) -> str:
    return "VALUES " + ", ".join(f"({', '.join(map(_quoted, r))})" for r in rows)


SEED_ROWS = _values_of((k, i, q, a, ",".join(w), i == "ood") for k, (i, q, a, w) in enumerate(catalog.SEEDS))


@query(f"SELECT c_custkey, intent, q, a, keywords, ood FROM customer JOIN ({SEED_ROWS}) t(ord, intent, q, a, keywords, ood) ON c_custkey % {len(catalog.SEEDS)} = ord")
def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer asks one of the seed questions."""
    asked = read(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % len(catalog.SEEDS)).alias("ord"))
    t = asked.join(F.broadcast(catalog.seeds(spark)), "ord").drop("ord")  # a literal table
    return t.withColumn("keywords", F.array_join("keywords", ","))


@query(f"""
SELECT p.name AS product, t.name AS topping, count(*) AS n, sum(p.price + t.price)::BIGINT AS price, count(l.note) AS noted, sum(length(o.thing) + length(r.answer) + length(m.prompt))::BIGINT AS chars
FROM orders
JOIN ({_values_of((k, x[0], x[1]) for k, x in enumerate(catalog.PRODUCTS))}) p(ord, name, price) ON o_orderkey % {len(catalog.PRODUCTS)} = p.ord
JOIN ({_values_of((k, *x) for k, x in enumerate(catalog.TOPPINGS))}) t(ord, name, price) ON o_custkey % {len(catalog.TOPPINGS)} = t.ord
JOIN ({_values_of(enumerate(catalog.TOPICS))}) o(ord, thing) ON o_orderkey % {len(catalog.TOPICS)} = o.ord
JOIN ({_values_of(enumerate(catalog.REFUSALS))}) r(ord, answer) ON o_orderkey % {len(catalog.REFUSALS)} = r.ord
JOIN ({_values_of(enumerate(catalog.PROMPTS))}) m(ord, prompt) ON o_custkey % {len(catalog.PROMPTS)} = m.ord
LEFT JOIN ({_values_of(catalog.ALLERGENS.items())}) l(name, note) ON l.name = p.name
GROUP BY 1, 2
""")
def literal_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every order takes a product, a topping, a topic, a refusal and a prompt."""
    one = lambda t, n, **names: F.broadcast(t.select(F.col("ord").cast("long").alias(f"of_{n}"), *(F.col(c).alias(new) for c, new in names.items())))
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    t = read(spark, sf, "orders").select(
        (order % len(catalog.PRODUCTS)).alias("of_product"), (customer % len(catalog.TOPPINGS)).alias("of_topping"), (order % len(catalog.TOPICS)).alias("of_topic"),
        (order % len(catalog.REFUSALS)).alias("of_refusal"), (customer % len(catalog.PROMPTS)).alias("of_prompt"),
    )
    t = t.join(one(catalog.products(spark), "product", name="product", price="price"), "of_product").join(one(catalog.toppings(spark), "topping", name="topping", price="more"), "of_topping")
    t = t.join(one(catalog.topics(spark), "topic", thing="thing"), "of_topic").join(one(catalog.refusals(spark), "refusal", answer="answer"), "of_refusal")
    t = t.join(one(catalog.prompts(spark), "prompt", prompt="prompt"), "of_prompt")
    notes = F.broadcast(catalog.allergens(spark).select(F.explode("allergens").alias("product", "note")))
    t = t.join(notes, "product", "left")
    chars = F.length("thing") + F.length("answer") + F.length("prompt")
    return t.groupBy("product", "topping").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price") + F.col("more")).alias("price"), F.count("note").alias("noted"), F.sum(chars).alias("chars"))


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds and topics, with `part` as products and toppings."""
    # A part gives a hundred rows, so few bytes of parts are work for many tasks.
    dealt = products(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ord")
    toppings = dealt.select((F.col("ord") + 1).alias("ord"), "name", "price")
    raw = expand.expand(catalog.seeds(spark).drop("ord"), dealt, toppings, catalog.topics(spark), catalog.REFUSALS)
    return raw.withColumn("ord", F.xxhash64("origin", "q", "a", "prefix_id"))


_PLAIN = f"""
SELECT 'seed' AS origin, q, a FROM ({SEED_ROWS}) t(ord, intent, q, a, keywords, ood)
UNION ALL SELECT 'price_template', q, a FROM ({SQL['price_templates']})
UNION ALL SELECT 'recommend_template', q, a FROM ({SQL['tag_templates']})
UNION ALL SELECT 'customize_template', q, a FROM ({SQL['hot_customize']})
UNION ALL SELECT 'topping_template', q, a FROM ({SQL['topping_templates']})
UNION ALL SELECT 'ood_template', replace((SELECT list(x ORDER BY k) FROM ({_values_of(enumerate(expand.OUT_OF_DOMAIN))}) v(k, x))[('0x' || substr(md5('42q|' || thing), 1, 8))::BIGINT % {len(expand.OUT_OF_DOMAIN)} + 1], '{{thing}}', thing),
  (SELECT list(x ORDER BY k) FROM ({_values_of(enumerate(catalog.REFUSALS))}) v(k, x))[('0x' || substr(md5('42a|' || thing), 1, 8))::BIGINT % {len(catalog.REFUSALS)} + 1]
  FROM (SELECT thing FROM ({_values_of(enumerate(catalog.TOPICS))}) v(k, thing) ORDER BY md5('42|' || thing) LIMIT 16)
"""
_ALL = f"plain AS ({_PLAIN}), raw AS (SELECT origin, replace(p.t, '{{q}}', q) AS q, a FROM plain, ({_values_of(enumerate(expand.PARAPHRASE))}) p(k, t))"


@query(f"WITH plain AS ({_PLAIN}) SELECT origin, count(*) AS plain, 5 * count(*) AS n FROM plain GROUP BY origin")
def template_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The union of all branches, in all paraphrases."""
    return _templates(spark, sf).groupBy("origin").agg(F.count_if(F.col("prefix_id") == 0).alias("plain"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ALL}, kept AS (SELECT DISTINCT regexp_replace(q, '{WS}', '', 'g') AS q FROM raw WHERE length(q) BETWEEN 4 AND 80 AND length(a) BETWEEN 5 AND 200), c AS (SELECT (SELECT count(*) FROM raw) AS n, (SELECT count(*) FROM kept) AS k) SELECT n AS raw_count, n - k AS dedup_dropped, k AS final_count, round(k / {len(catalog.SEEDS)}.0::DOUBLE, 1) AS expansion_ratio FROM c")
def template_corpus_build(spark: SparkSession, sf: str) -> DataFrame:
    """Gated and deduplicated by question."""
    raw = _templates(spark, sf)
    each = raw.select("intent", "q", "a", "ood", "ord").distinct()  # rows that products of one name and price share, before they are normalised and ranked
    return clean.corpus_stats(raw, clean.build_corpus(each, dedup="q"), len(catalog.SEEDS)).select("raw_count", "dedup_dropped", "final_count", "expansion_ratio")


# ---- prompts, providers, children


@query(f"WITH {QA} SELECT qid, '请把下面的客服问答改写成 3 个不同问法的变体。问题:' || q || ' 答案:' || a || ' 只输出 JSON 数组,形如 [{{\"question\": \"...\", \"answer\": \"...\"}}]。' AS prompt FROM qa")
def evolve_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select("qid", generators.evolve_prompt(F.col("q"), F.col("a"), 3).alias("prompt"))


@query(f"WITH {COMP} SELECT qid, k, '请按 1 到 5 分给客服回答打分,只输出数字。问题:' || q || ' 标准答案:' || a || ' 回答:' || completion AS prompt FROM comp")
def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return completions(spark, sf).select("qid", "k", generators.judge_prompt(F.col("q"), F.col("a"), F.col("completion")).alias("prompt"))


@query("SELECT item_id, k, CASE WHEN item_id % 9 = 4 THEN NULL ELSE 'echo ' || text END AS completion FROM benchmark, (VALUES (0), (1), (2)) t(k)")
def provider_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Three completions of each prompt by a provider, whose failed calls give null."""
    prompts = read(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 9 != 4, F.col("text")).alias("prompt"))
    return generators.complete(prompts, lambda batch: [None if p is None else f"echo {p}" for p in batch], k=3).select("item_id", "k", "completion")


@query("SELECT item_id, k, CASE WHEN k = 0 THEN 'first ' ELSE 'second ' END || text AS completion, 2 * (SELECT count(*) FROM benchmark) AS asked FROM benchmark, (VALUES (0), (1), (2)) t(k)")
def journal_completions(spark: SparkSession, sf: str) -> DataFrame:
    """One completion of each prompt, then three by another provider, which is only asked for the two that the journal lacks."""
    path = scratch(spark, "journal")
    prompts = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("prompt"))
    journal.complete(prompts, "item_id", lambda batch: [f"first {p}" for p in batch], path)
    done, asked = journal.complete(prompts, "item_id", lambda batch: [f"second {p}" for p in batch], path, k=3)
    return done.select("item_id", "k", "completion", F.lit(asked).cast("bigint").alias("asked"))


@query(f"WITH {QA} SELECT qid, 'how ' || i::VARCHAR AS q, CASE WHEN i = 2 THEN '' ELSE 'so' END AS a, array_to_string(keywords, ',') AS keywords, ood, ood::VARCHAR AS intent, 'evolved' AS source FROM qa, (VALUES (0), (1), (2)) t(i) WHERE qid % 4 <> 1")
def child_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The items of replies inherit their seed's intent, keywords and ood; missing answers are empty; replies that don't parse give none."""
    items = ", ".join(f'{{"question": " how {i} ", "answer": {"null" if i == 2 else chr(34) + "so" + chr(34)}}}' for i in range(3))
    reply = F.when(F.col("qid") % 4 == 1, "sorry, [no").otherwise(f"Sure: [{items}] done")
    t = samples(spark, sf).withColumns({"completion": reply, "intent": F.col("ood").cast("string")})
    return generators.variants(t, "evolved", keep=("qid",)).withColumn("keywords", F.array_join("keywords", ","))


@query("SELECT n_nationkey, n_name AS found, NULL AS missing FROM nation")
def credential(spark: SparkSession, sf: str) -> DataFrame:
    """Looked up in a file of the driver, a line for each nation, where the environment has none."""
    import tempfile

    nations = [tuple(r) for r in read(spark, sf, "nation").select("n_nationkey", "n_name").collect()]  # a fixed 25
    with tempfile.TemporaryDirectory() as d:
        file = Path(d) / ".env"
        file.write_text("# keys\n" + "".join(f"CORPUSLOOM_KEY_{k} = '{v}'\n" for k, v in nations))
        found = [(k, generators.credential(f"CORPUSLOOM_KEY_{k}", str(file)), generators.credential(f"CORPUSLOOM_NO_KEY_{k}", str(file))) for k, _ in nations]
    return spark.createDataFrame(found, "n_nationkey int, found string, missing string")


@query("SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem, string_split(url, '/')[-2] AS parent, 'lora:' || string_split(rtrim(url, '/'), '/')[-1] AS label FROM pages")
def path_names(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", T.base_name(u).alias("name"), T.base_name(u, stem=True).alias("stem"), T.parent_name(u).alias("parent"), T.folder_label(u, "lora:").alias("label"))


@query("SELECT row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) AS number, doc_id FROM documents")
def numbering(spark: SparkSession, sf: str) -> DataFrame:
    t = expand.numbered(read(spark, sf, "documents").select("doc_id", "lang"), F.col("lang"), F.col("doc_id"), start=1)
    return t.select(F.col("ord").cast("bigint").alias("number"), "doc_id")


# ---- encoding


def _encoder() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


@query("SELECT conv_id * 1000 + turn AS key, text FROM conversations")
def encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-level ids of every turn, decoded again."""
    t = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    spec = _encoder()
    return tokens.decode(tokens.bpe_encode(t, spec), spec).select("key", F.col("decoded").alias("text"))


@query(f"WITH {QA}, m AS (SELECT qid, concat('<|user|>', q, chr(10), '<|assistant|>', a) AS chat FROM qa), w AS (SELECT qid, list_filter(regexp_split_to_array(chat, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM m) SELECT qid, least(len(w), 64)::BIGINT AS n FROM w")
def chat_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows as tokens, cut at a length; all input columns are dropped."""
    t = samples(spark, sf).select("qid", chat.template(chat.messages(F.col("q"), F.col("a"))).alias("chat"))
    return t.select("qid", F.size(F.slice(tokens.whitespace_tokens(F.col("chat")), 1, 64)).cast("bigint").alias("n"))


@query(f"WITH {CTOK} SELECT key, len(w) AS n, max(len(w)) OVER (PARTITION BY key // 1000) AS width FROM t")
def collated(spark: SparkSession, sf: str) -> DataFrame:
    """A user's collator over batches: here it pads to the batch's longest row."""

    def pad(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": batch["key"], "n": batch["w"].map(len), "width": int(batch["w"].map(len).max())})

    t = conversation_tokens(spark, sf).withColumn("batch", F.floor(F.col("key") / 1000))
    return chat.collate(t, "batch", pad, "key long, n long, width long")


@query(f"WITH {CTOK} SELECT key, len(list_slice(w, ({{h}} % greatest(len(w) - 9, 1))::BIGINT + 1, ({{h}} % greatest(len(w) - 9, 1))::BIGINT + 8)) AS n, ({{h}} % greatest(len(w) - 9, 1))::BIGINT AS at FROM t".replace("{h}", "('0x' || substr(md5(concat_ws('|', '42', key::VARCHAR)), 1, 8))::BIGINT"))
def random_windows(spark: SparkSession, sf: str) -> DataFrame:
    u = T.hash_int("42", F.col("key"))
    t = conversation_tokens(spark, sf)
    return t.select("key", F.size(tokens.random_window(F.col("w"), 8, u)).cast("bigint").alias("n"), (u % F.greatest(F.size("w") - 9, F.lit(1))).cast("bigint").alias("at"))


# ---- rewards and reports


@query(f"WITH {COMP} SELECT qid, k, list_reduce(list_transform(string_split(completion, ''), lambda c: ord(c)::BIGINT), lambda s, c: (s * 31 + c) % 1000003, 7::BIGINT)::VARCHAR AS completion FROM comp")
def mapped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A user's function that no expression stands for: a rolling checksum of characters."""

    def checksum(s: str) -> str:
        n = 7
        for c in s:
            n = (n * 31 + ord(c)) % 1000003
        return str(n)

    return score.map_rows(completions(spark, sf).select("qid", "k", "completion"), "completion", checksum)


@query(f"WITH {COMP} SELECT qid, k, CASE WHEN CASE WHEN ood THEN {' OR '.join(f'contains(completion, {chr(39)}{m}{chr(39)})' for m in T.REFUSAL_MARKERS)} ELSE {HIT.format('completion')} END THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END + (length(completion) % 10) / 10.0::DOUBLE AS reward FROM comp")
def reward_sum(spark: SparkSession, sf: str) -> DataFrame:
    """A reward of the registry and a user's, added."""

    @F.pandas_udf("double")
    def tail(c: pd.Series) -> pd.Series:
        return c.str.len() % 10 / 10.0

    score.register_reward("tail", lambda c: tail(c["completion"]))
    return score.with_rewards(completions(spark, sf), "domain", "tail").select("qid", "k", "reward")


@query(f"WITH {QA} SELECT q AS prompt, array_to_string(keywords, ',') AS answer_keywords, ood FROM qa")
def rl_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return score.rl_prompts(samples(spark, sf)).withColumn("answer_keywords", F.array_join("answer_keywords", ","))


@query("SELECT item_id, model_id, model FROM benchmark, (VALUES (0, 'base'), (1, 'sft'), (2, 'rl')) t(model_id, model)")
def model_grid(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.each_model(read(spark, sf, "benchmark").select("item_id"), ("base", "sft", "rl"))


@query("WITH m AS (SELECT page_id % 3 AS model, avg((TRY_CAST(regexp_extract_all(url, '-?[0-9]+')[-1] AS BIGINT) IS NOT DISTINCT FROM page_id)::INT) AS acc FROM pages GROUP BY 1), d AS (SELECT max(acc) FILTER (model = 0) AS first, max(acc) FILTER (model = 1) AS second FROM m) SELECT first, second, format('{:+.1f}', (second - first) * 100) AS gain FROM d")
def accuracy_delta(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "pages").select((F.col("page_id") % 3).cast("string").alias("model"), F.col("url").alias("resp"), F.col("page_id").alias("ans"))
    return evaluate.accuracy_delta(evaluate.exact_match(t), "0", "1")


@query(f"WITH {RESP}, m AS ({METRICS}) SELECT rpad(model, 8, ' ') || ' ' || rpad(samples::VARCHAR, 6, ' ') AS line FROM m")
def console_table(spark: SparkSession, sf: str) -> DataFrame:
    return writers.table_text(eval_metrics(spark, sf), {"model": 8, "samples": 6})


@query(f"""
WITH {RESP}, m AS ({METRICS}),
j AS (SELECT model, avg(score) AS mean, count(*) AS n FROM (SELECT model, CASE WHEN length(resp) % 6 = 5 THEN NULL ELSE length(resp) % 6 END AS score FROM resp QUALIFY row_number() OVER (PARTITION BY model ORDER BY md5(concat_ws('|', '0', qid::VARCHAR, k::VARCHAR))) <= 15) WHERE score IS NOT NULL AND score <> 0 GROUP BY model),
x AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY qid, k) AS ord FROM resp QUALIFY ord <= 5),
b AS (SELECT model, overall_acc FROM m ORDER BY overall_acc DESC, model LIMIT 1)
SELECT * FROM (VALUES (0, '00', '| model | domain | refusal | overall | miss | length |'), (0, '01', '| --- | --- | --- | --- | --- | --- |'), (2, '00', '| model | judge | n |'), (2, '01', '| --- | --- | --- |')) t(part, ord, line)
UNION ALL SELECT 0, '1|' || model, format('| {{}} | {{:.1f}}% | {{:.1f}}% | {{:.1f}}% | {{:.1f}}% | {{:.1f}} |', model, domain_acc * 100, refusal_rate * 100, overall_acc * 100, miss_rate * 100, avg_len) FROM m
UNION ALL SELECT 1, '0', format('Best: {{}} ({{:.1f}}%)', model, overall_acc * 100) FROM b
UNION ALL SELECT 2, '1|' || model, format('| {{}} | {{:.2f}} | {{}} |', model, mean, n) FROM j
UNION ALL SELECT 3, '1|' || model || '|' || lpad(ord::VARCHAR, 3, '0'), '* ' || model || ' [' || CASE WHEN refused THEN 'refused' WHEN hit THEN 'hit' ELSE 'miss' END || '] ' || replace(left(resp, 120), chr(10), ' ') FROM x
""")
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the whole report: metrics, the best model, the judge's means and five examples a model."""
    from pyspark.sql import Window

    of = Window.partitionBy("model").orderBy("qid", "k")
    t = sample.head_per_group(responses(spark, sf), "model", 5, F.col("qid"), F.col("k")).withColumn("ord", F.row_number().over(of))
    return evaluate.report(eval_metrics(spark, sf), judge_mean(spark, sf), t.withColumn("outcome", evaluate.outcome(F.col("hit"), F.col("refused"))))


# ---- streams


@query("WITH w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS at, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2) SELECT strftime(w.at, '%Y-%m-%d %H:%M:%S') AS at, event_type, n, total FROM w WHERE w.at + INTERVAL '5 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'")
def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of windows that the watermark has passed."""
    schema = read(spark, sf, "events").schema
    t = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", "events.parquet").load(sf)
    t = stream.windowed_counts(t.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type", "n", F.round("total", 6).alias("total"))
    return stream.replay(t, scratch(spark, "window-out"), scratch(spark, "window-checkpoint"))


# ---- windows of the packed stream

FLAT = f"{OFFS}, flat AS (SELECT start + i - 1 AS pos, CASE WHEN i <= len(w) THEN length(w[i]) ELSE 0 END AS tok FROM o, LATERAL (SELECT unnest(range(1, len(w) + 2)) AS i)), total AS (SELECT count(*) AS n FROM flat)"
DRAWS = "draws AS (SELECT d AS draw, ('0x' || substr(md5(concat_ws('|', '42', d::VARCHAR)), 1, 15))::BIGINT % (n - 49 - {lo}) + {lo} AS place FROM total, LATERAL (SELECT unnest(range(n // 64)) AS d))"


def stream_draws(spark: SparkSession, sf: str, lo: int) -> DataFrame:
    """Windows of 48 words of the packed conversations, one for every 64 of them."""
    t = packed(spark, sf)
    total = t.agg(F.sum(F.size("ids"))).first()[0]
    return tokens.random_windows(t, "ids", 48, total // 64, lo=lo, hi=total)


@query(f"WITH {FLAT}, {DRAWS.format(lo=0)}, x AS (SELECT draw, place, list(tok ORDER BY pos) AS ids FROM draws JOIN flat ON pos BETWEEN place AND place + 48 GROUP BY ALL) SELECT draw, place, array_to_string(list_slice(ids, 1, 48), ' ') AS inputs, array_to_string(list_slice(ids, 2, 49), ' ') AS targets FROM x")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Random windows of the stream, across conversations' turns."""
    line = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return stream_draws(spark, sf, 0).select("draw", "place", line("inputs"), line("targets"))


@query(f"WITH {FLAT}, {DRAWS.format(lo=1000)}, y AS (SELECT pos, abs(lead(tok) OVER (ORDER BY pos) - tok) AS miss FROM flat), l AS (SELECT draw, avg(miss) AS loss FROM draws JOIN y ON pos BETWEEN place AND place + 47 GROUP BY draw), b AS (SELECT draw // 16 AS batch, avg(loss) AS loss FROM l GROUP BY 1) SELECT round(avg(loss), 9) AS loss, count(*) AS batches FROM b")
def stream_window_loss(spark: SparkSession, sf: str) -> DataFrame:
    """The mean over batches of 16 windows from place 1000 on; a model that repeats its input stands for the model."""
    miss = F.zip_with("inputs", "targets", lambda x, y: F.abs(x - y))
    loss = F.aggregate(miss, F.lit(0).cast("bigint"), lambda s, v: s + v) / F.size(miss)
    return tokens.estimate(stream_draws(spark, sf, 1000), loss, F.floor(F.col("draw") / 16)).select(F.round("loss", 9).alias("loss"), "batches")


@query(f"WITH {CTOK}, f AS (SELECT key, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM t), o AS (SELECT tok, lead(tok) OVER (ORDER BY key, i) AS nxt FROM f) SELECT round(count(DISTINCT tok || ' ' || nxt) / count(nxt)::DOUBLE, 9) AS exact, true AS within FROM o WHERE nxt IS NOT NULL")
def corpus_distinct_n_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """The sketch lies within four of its standard errors of the exact value."""
    t = tokens.with_offsets(conversation_tokens(spark, sf), F.size("w"), "key")
    exact = tokens.corpus_distinct_n(t, "w", 2).first().distinct_n
    got = tokens.corpus_distinct_n_sketch(t, "w", 2)
    return got.select(F.round(F.lit(exact), 9).alias("exact"), (F.abs(F.col("distinct_n") - exact) <= 4 * F.col("error") * exact).alias("within"))


# ---- streams with state and sinks


@query("""
WITH e AS (SELECT user_id::VARCHAR AS run, event_id AS ord, epoch_ms(ts) AS ms, value AS loss FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT max(ms) - 600000 AS passed FROM e),
b AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM e)
SELECT run, ord, loss, is_best FROM b, w WHERE ms <= passed
""")
def stream_best_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Events judged in the order of their times, each once the watermark has passed it."""
    schema = read(spark, sf, "events").schema
    t = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", "events.parquet").load(sf)
    t = t.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("loss"))
    best = ordered.running_best(t, delay="10 minutes", idle=timedelta(days=36500))
    return stream.replay(best.select("run", "ord", "loss", "is_best"), scratch(spark, "ordered-out"), scratch(spark, "ordered-checkpoint"))


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, 1::BIGINT AS times FROM events GROUP BY event_type")
def event_log_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All events through a stream to the log, and the stream run again."""
    schema = read(spark, sf, "events").select("event_id", "event_type").schema
    t = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", "events.parquet").load(sf)
    path, mark = scratch(spark, "event-log"), scratch(spark, "event-log-checkpoint")
    for _ in range(2):
        sink.append_once(t, path, mark, name="events")
    each = sink.log(spark, path, "event_id long, event_type string").groupBy("event_id", "event_type").agg(F.count(F.lit(1)).alias("times"))
    return each.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.max("times").alias("times"))


# ---- batches


BATCHED = f"""{CTOK}, s AS (SELECT key, len(w) AS n, CASE WHEN len(w) > 8 THEN ceil(len(w) / 16.0) * 16 WHEN len(w) > 4 THEN 8 WHEN len(w) > 2 THEN 4 ELSE greatest(len(w), 1) END::BIGINT AS width FROM t),
p AS (SELECT *, (row_number() OVER (PARTITION BY width ORDER BY md5(concat_ws('|', '42', key::VARCHAR))) - 1) // greatest(2048 // width, 1) AS number FROM s),
b AS (SELECT key, n, width::VARCHAR || '-' || number::VARCHAR AS batch FROM p)"""


def batched(spark: SparkSession, sf: str) -> DataFrame:
    return chat.budget_batches(conversation_tokens(spark, sf), F.size("w"), F.col("key"), 2048)


@query(f"WITH {BATCHED} SELECT key, batch, ('0x' || substr(md5(concat_ws('|', '42', batch)), 1, 15))::BIGINT AS batch_order FROM b")
def budget_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batched(spark, sf).select("key", "batch", "batch_order")


@query(f"WITH {BATCHED}, g AS (SELECT batch, count(*) AS rows, max(n) AS longest, sum(n) AS tokens FROM b GROUP BY batch) SELECT count(*) AS batches, sum(tokens)::BIGINT AS tokens, sum(rows * longest - tokens)::BIGINT AS padding, max(CASE WHEN rows > 1 THEN rows * longest END)::BIGINT AS most FROM g")
def batch_padding(spark: SparkSession, sf: str) -> DataFrame:
    """Padding of all batches, and the largest padded batch of several rows."""
    n = F.size("w")
    each = batched(spark, sf).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.max(n).alias("longest"), F.sum(n).alias("tokens"))
    padded = F.col("rows") * F.col("longest")
    return each.agg(F.count(F.lit(1)).alias("batches"), F.sum("tokens").alias("tokens"), F.sum(padded - F.col("tokens")).alias("padding"), F.max(F.when(F.col("rows") > 1, padded)).alias("most"))


# ---- many keywords

NAMES = f"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}')) AS w FROM conversations WHERE role = 'user'),
g AS (SELECT list(w) AS ws FROM k)
SELECT doc_id, len(f) AS n, md5(array_to_string(list_sort(f), ' ')) AS words FROM (SELECT doc_id, list_filter(ws, lambda w: contains(text, w)) AS f FROM documents, g)"""


def _names(spark: SparkSession, sf: str, held: int) -> DataFrame:
    """The words of all questions that each document holds."""
    asked = read(spark, sf, "conversations").where("role = 'user'").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("w"))
    t = match.found(read(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id", asked, "w", held=held)
    return t.select("doc_id", F.size("found").cast("bigint").alias("n"), F.md5(F.array_join("found", " ")).alias("words"))


@query(NAMES)
def names_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf, match.HELD)


@query(NAMES)
def names_in_documents_joined(spark: SparkSession, sf: str) -> DataFrame:
    """As if the names were too many to send."""
    return _names(spark, sf, 0)

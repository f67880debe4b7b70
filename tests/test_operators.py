"""Golden counts, the traps of Python semantics, and properties of the operators."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import text as T
from corpusloom.operators import chat, clean, evaluate, expand, runlog, sample, score, tokens
from corpusloom.sources import catalog, generators, readers, writers
from corpusloom.streaming import runlog as stream

SEED_COUNTS = {"price": 10, "recommend": 9, "ood": 8, "customize": 5, "member": 5, "hours": 4, "delivery": 4, "store": 4, "after_sale": 3, "allergen": 3}


@pytest.fixture(scope="module")
def corpus(spark):
    seeds = [(k, f"种子问题 {k} {i}?", f"种子答案 {k} {i}。", [str(i)], k == "ood") for k, n in SEED_COUNTS.items() for i in range(n)]
    s = spark.createDataFrame(seeds, "intent string, q string, a string, keywords array<string>, ood boolean")
    raw = expand.expand(s, catalog.products(spark), catalog.toppings(spark), catalog.topics(spark), catalog.REFUSALS)
    return raw.withColumn("ord", F.xxhash64("origin", "q", "a", "prefix_id"))


def test_expansion_counts(corpus):
    want = {"seed": 55, "price_template": 64, "recommend_template": 96, "customize_template": 20, "topping_template": 5, "ood_template": 16}
    assert {r.origin: r["count"] for r in corpus.where("prefix_id = 0").groupBy("origin").count().collect()} == want
    assert corpus.count() == 1280


@pytest.mark.parametrize("dedup, final, ratio, splits", [("q", 1250, 22.7, None), ("qa", 1280, 23.3, (1024, 125, 131))])
def test_corpus_golden_counts(corpus, dedup, final, ratio, splits):
    kept = clean.build_corpus(corpus, dedup=dedup)
    s = clean.corpus_stats(corpus, kept, 55).first()
    assert (s.raw_count, s.dedup_dropped, s.final_count, s.expansion_ratio) == (1280, 1280 - final, final, ratio)
    assert sum(s.source.values()) == 1280 and sum(s.intent_dist.values()) == final
    if splits:
        assert tuple(s.split) == splits
    assert sum(s.split) == final
    assert kept.groupBy("intent").agg(F.countDistinct("split").alias("n")).where("n < 3").count() == 0


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


PAGE = [chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]


def test_strip_and_normalize_are_pythons(spark):
    texts = ["".join(PAGE) + "a b" + "".join(PAGE), "x​y", "", " 　", "问？ ?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.strip(F.col("t")).alias("s"), T.normalize(F.col("t")).alias("n"), T.normalize(F.col("t"), fold_width=True).alias("f")).collect()
    for r in rows:
        assert r.s == r.t.strip() and r.n == "".join(r.t.split())
    assert rows[-1].f == "问??"


def test_scalar_traps(spark):
    lit = F.lit
    assert one(spark, T.contains_any(lit("18"), F.array(lit("8")))) is True
    assert one(spark, T.contains_any(lit("x"), F.array().cast("array<string>"))) is False
    assert one(spark, T.contains_any(lit("x"), F.array(lit("")))) is True
    assert one(spark, T.last_integer(lit("a-3 b 12"))) == 12 and one(spark, T.last_integer(lit("none"))) is None
    assert one(spark, T.first_integer(lit("x7y8"))) == 7 and one(spark, T.first_integer(lit("-"))) is None
    assert one(spark, T.has_whole_number(lit("125"), lit("25"))) is False and one(spark, T.has_whole_number(lit("a25."), lit("25"))) is True
    assert one(spark, T.has_digit(lit("１"))) is True and one(spark, F.length(lit("😀"))) == 1
    assert one(spark, T.json_items(lit('x ```json\n[{"question": "a", "answer": null}]``` y')))[0].question == "a"
    for bad in ("no list", "[{", "[1, 2"):
        assert not one(spark, T.json_items(lit(bad)))
    assert one(spark, T.json_items(lit("[]"))) == []
    assert one(spark, T.base_name(lit("/a/b.c.json"), stem=True)) == "b.c" and one(spark, T.parent_name(lit("/m/exp_1/log.jsonl"))) == "exp_1"
    assert one(spark, T.is_refusal(lit("请咨询"))) is True


def test_a_gated_row_does_not_hide_a_later_one(spark):
    raw = spark.createDataFrame([(1, "i", "abcde" + "　" * 90, "answer", False), (2, "i", "abcde", "answer", False), (3, "i", "abc de", "answer", False)], "ord int, intent string, q string, a string, ood boolean")
    assert [r.ord for r in clean.build_corpus(raw).collect()] == [2]


@given(st.dictionaries(st.sampled_from("abcd"), st.integers(1, 45), min_size=1))
@settings(max_examples=8, deadline=None)
def test_split_sizes(spark, groups):
    rows = [(f"{g}{i}", g) for g, n in groups.items() for i in range(n)]
    got = clean.stratified_split(spark.createDataFrame(rows, "id string, g string"), "g", F.col("id"))
    counts = {(r.g, r.split): r["count"] for r in got.groupBy("g", "split").count().collect()}
    for g, n in groups.items():
        want = {"train": int(n * 0.8), "val": int(n * 0.9) - int(n * 0.8), "test": n - int(n * 0.9)}
        assert {s: counts.get((g, s), 0) for s in want} == want


def test_a_stratum_is_dealt_to_many_groups(spark):
    df = clean.stratified_split(spark.range(100).withColumn("g", F.col("id") % 3), "g", F.col("id"))
    windows = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in x and "Window" in x]
    assert windows and all("__bin" in x.split("windowspecdefinition")[1] for x in windows)
    one = spark.range(2000).withColumn("g", F.lit(None).cast("string"))
    got = {r.split: r["count"] for r in clean.stratified_split(one, "g", F.col("id")).groupBy("split").count().collect()}
    assert got == {"train": 1600, "val": 200, "test": 200}


def test_offsets_keep_every_row_of_many_partitions(spark):
    wide = spark.range(300_000).select(F.col("id").alias("key"), F.repeat(F.md5(F.col("id").cast("string")), 24).alias("payload"), (F.col("id") % 5).alias("n")).repartition(230)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    t = tokens.with_offsets(wide, F.col("n"), "key", parts=300)
    want = (F.floor(F.col("key") / 5) * 10 + F.element_at(F.array(*map(F.lit, (0, 0, 1, 3, 6))), (F.col("key") % 5 + 1).cast("int"))).cast("bigint")
    r = t.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"), F.count_if(F.col("start") != want).alias("wrong"), F.sum(F.length("payload")).alias("chars")).first()
    assert (r.n, r["keys"], r.wrong, r.chars) == (300_000, 300_000, 0, 300_000 * 768)


def test_offsets_of_odd_keys(spark):
    rows = spark.createDataFrame([(None, 4), (5, 1), (-7, 2), (9, None)], "key long, n int")
    assert {r.key: r.start for r in tokens.with_offsets(rows, F.col("n"), "key").collect()} == {None: 0, -7: 4, 5: 6, 9: 7}
    assert tokens.with_offsets(rows.limit(0), F.col("n"), "key").count() == 0
    assert tokens.with_offsets(rows, F.col("n"), "key", parts=1).count() == 4


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=7), min_size=1, max_size=8), st.integers(1, 3))
@settings(max_examples=8, deadline=None)
def test_corpus_distinct_n_crosses_rows(spark, texts, n):
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, w array<string>")
    t = tokens.with_offsets(rows, F.size("w"), "key")
    flat = [x for w in texts for x in w]
    grams = [tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)]
    assert tokens.corpus_distinct_n(t, "w", n, block=4).first().distinct_n == (len(set(grams)) / len(grams) if grams else 0.0)


def test_distinct_n_of_a_long_text(spark):
    import time

    words = [f"w{k % 1000}" if k % 3 else "a:1" for k in range(60_000)]
    df = spark.createDataFrame([(words,), (["a"],), ([],), (["1", "1a", "11", "a"],)], "w array<string>")
    began = time.time()
    got = [r.d for r in df.select(A.distinct_n(F.col("w"), 2).alias("d")).collect()]
    grams = list(zip(words, words[1:]))
    assert got == [len(set(grams)) / len(grams), 0.0, 0.0, 1.0] and time.time() - began < 20


def test_a_short_source_is_an_error(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        readers.first_stories(spark, str(tmp_path / "t"), 4)


def test_rebalance_uses_doubles(spark):
    df = spark.range(1043).select("id", (F.col("id") < 43).alias("ood"))
    assert sample.rebalance(df, "ood", 0.2, F.col("id")).count() == 43 + 171


def test_preferences_and_rewards(spark):
    prompts = spark.createDataFrame([(1, "q1", "价格 8 元", ["8"], False), (2, "q2", "x", ["y"], False), (3, "q3", "抱歉", ["z"], True)], "qid int, q string, a string, keywords array<string>, ood boolean")
    comps = spark.createDataFrame([(1, "b no"), (1, "a no"), (1, "18"), (2, "bad"), (3, "好的")], "qid int, completion string")
    got = {r.qid: r.rejected for r in score.preference_pairs(prompts, comps).collect()}
    assert got == {1: "a no", 3: "好的"}  # 2: the worst equals the gold answer
    t = comps.join(prompts, "qid")
    assert sorted(r.completion for r in score.rejection_sample(t).collect()) == ["18"]
    both = score.with_rewards(t.withColumn("answer", F.lit("18")), "domain", "brevity", "math").where("completion = '18'").first()
    assert (both.reward_domain, both.reward_brevity, both.reward_math, both.reward) == (1.0, 0.1, 1.0, 2.1)
    adv = score.group_advantage(spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "g int, r double"), "g", "r").orderBy("g", "r").collect()
    assert [round(r.advantage, 3) for r in adv] == [-0.707, 0.707, 0.0]


def test_metrics_on_no_rows_of_a_kind(spark):
    df = spark.createDataFrame([("m", "抱歉", ["a"], True), ("m", "好", ["a"], True)], "model string, resp string, keywords array<string>, ood boolean")
    r = evaluate.metrics(evaluate.judged(df)).first()
    assert (r.domain_acc, r.refusal_rate, r.overall_acc, r.miss_rate, r.avg_len, r.samples) == (0.0, 0.5, 0.5, 0.0, 1.5, 2)
    assert "Best: m (50.0%)" in evaluate.report_text(evaluate.report(evaluate.metrics(evaluate.judged(df))))
    assert evaluate.judge_mean(spark.createDataFrame([], "model string, score int")).count() == 0


def test_chat(spark):
    m = chat.instruction_messages(F.lit("do"), F.lit(" 　"), F.lit("done"))
    assert [tuple(x) for x in one(spark, m)] == [("user", "do"), ("assistant", "done")]
    ids = F.array(*map(F.lit, (5, 6, 7)))
    assert one(spark, chat.mask_labels(ids, F.lit(2))) == [-100, -100, 7] and one(spark, chat.mask_labels(ids, F.lit(9))) == [-100] * 3


def test_token_stream(spark):
    rows = spark.createDataFrame([(k, list(range(k % 5))) for k in range(40)], "key int, ids array<int>").repartition(7)
    t = tokens.with_offsets(tokens.packed(rows, "ids", 99), F.size("ids"), "key")
    want, at = {}, 0
    for k in range(40):
        want[k] = at
        at += k % 5 + 1
    assert {r.key: r.start for r in t.collect()} == want
    blocks = [r.ids for r in tokens.blocks(t, "ids", 16).orderBy("block_id").collect()]
    assert sum(blocks, []) == [x for k in range(40) for x in [*range(k % 5), 99]] and all(len(b) == 16 for b in blocks[:-1])
    with pytest.raises(ValueError):
        tokens.hold_out(t, F.size("ids"), at, at)
    assert one(spark, A.distinct_n(F.array(*map(F.lit, "aab")), 5)) == 0.0
    import public_tokenizers

    spec = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    texts = spark.createDataFrame([("hello world",), (None,)], "text string")
    back = tokens.decode(tokens.bpe_encode(texts, spec), spec).collect()
    assert sorted(r.decoded for r in back) == ["", "hello world"]


def test_run_log(spark, tmp_path):
    for run, events in {"exp_a": [{"type": "meta", "n_params": 5}, {"type": "eval", "val_loss": 2.0}, {"type": "meta", "n_params": 9}, {"type": "eval", "val_loss": 1.5}], "exp_b": [{"type": "meta", "n_params": 3}]}.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "log.jsonl").write_text("\n\n".join(json.dumps(e) for e in events) + "\n")
    got = runlog.scaling_table(readers.run_logs(spark, f"{tmp_path}/exp_*/log.jsonl")).collect()
    assert [tuple(r) for r in got] == [("exp_a", 5, 1.5)]
    best = runlog.best_so_far(spark.createDataFrame([(1, 1, 3.0), (1, 2, 3.0), (1, 3, 2.0)], "r int, o int, l double"), "r", "o", "l").orderBy("o").collect()
    assert [r.is_best for r in best] == [True, False, True]


def test_stream_resumes_with_its_state(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "run string, ord long, loss double"
    for k, rows in enumerate([[("a", 1, 5.0), ("a", 2, 4.0), ("b", 1, 1.0)], [("a", 3, 4.5), ("a", 4, 3.0), ("b", 2, 0.5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        got = stream.replay(stream.running_best(stream.events(spark, src, schema)), out, mark)
    assert {(r.run, r.ord) for r in got.where("is_best").collect()} == {("a", 1), ("a", 2), ("b", 1), ("a", 4), ("b", 2)}
    assert got.count() == 6


def test_providers_and_variants(spark):
    prompts = spark.createDataFrame([("p1", "price", ["8"], False), ("p2", "ood", ["x"], True)], "prompt string, intent string, keywords array<string>, ood boolean")
    reply = 'Sure: [{"question": " 多少钱 ", "answer": "8 元"}, {"question": null, "answer": "y"}]'
    done = generators.complete(prompts, generators.fixed_provider({"p1": reply}), k=2)
    assert done.count() == 4 and done.where("completion IS NULL").count() == 2
    got = generators.variants(done, "evolved").collect()
    assert {(r.q, r.a, r.source) for r in got} == {("多少钱", "8 元", "evolved"), ("", "y", "evolved")}
    for r in generators.math_questions(spark, 50).collect():
        a, op, b = r.prompt.split()
        assert int(r.answer) == (int(a) + int(b) if op == "+" else int(a) - int(b)) >= 0


def test_files(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("i", "问?", "答", ["k"], False, None)], readers.QA)
    writers.jsonl(rows, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert "问?" in text and "source" not in text
    assert readers.jsonl(spark, str(tmp_path / "j")).collect() == rows.collect()
    extra = readers.with_extras(rows.withColumn("origin", F.lit("seed")), [str(tmp_path / "j")])
    assert {r.origin for r in extra.collect()} == {"seed", "j"}
    writers.document(rows, str(tmp_path / "d.json"))
    assert readers.sidecar(spark, str(tmp_path / "d.json")).first().q == "问?"
    (tmp_path / "t.bin").write_bytes(bytes([1, 0, 2, 1]))
    assert readers.token_file(spark, str(tmp_path / "t.bin"), 8).first().ids == [1, 258]
    blocks = spark.createDataFrame([(k, [k, 258, 65535]) for k in range(50)], "block_id long, ids array<int>")
    assert writers.token_file(blocks, str(tmp_path / "stream")) == 150
    files = sorted((tmp_path / "stream").glob("part-*.bin"))
    assert b"".join(f.read_bytes() for f in files) == b"".join(x.to_bytes(2, "little") for k in range(50) for x in (k, 258, 65535))
    back = readers.token_file(spark, str(tmp_path / "stream"), 4).orderBy("path", "start").collect()
    assert [x for r in back for x in r.ids] == [x for k in range(50) for x in (k, 258, 65535)] and max(len(r.ids) for r in back) == 4
    (tmp_path / ".env").write_text("A_KEY='v1'\n")
    assert generators.credential("A_KEY", str(tmp_path / ".env")) == "v1" and generators.credential("NONE", str(tmp_path / "x")) is None
    assert readers.first_rows(extra, 0, "q").count() == 1


def test_kernels(spark):
    a = F.array(*(F.lit(float(x)) for x in (1, 3, 3, 2)))
    assert one(spark, A.top_k(a, 1)) == [float("-inf"), 3.0, 3.0, float("-inf")] and one(spark, A.top_k(a, 9)) == [1.0, 3.0, 3.0, 2.0]
    assert sum(one(spark, A.softmax(a))) == pytest.approx(1)
    q, k = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))
    assert one(spark, A.attention(q, k, F.array(F.array(F.lit(2.0)), F.array(F.lit(4.0))), 1.0)) == pytest.approx([3.0])
    assert one(spark, A.draw(F.array(F.lit(0.25), F.lit(0.75)), F.lit(0.3))) == 1
    assert one(spark, A.gelu(F.array(F.lit(1.0))))[0] == pytest.approx(0.8413447, abs=1e-6)
    assert one(spark, A.parameter_count(*map(F.lit, (4096, 384, 6, 6, 6, 256)))) == 12_292_992
    assert one(spark, A.alibi_bias(F.lit(0.5), F.lit(2))) == [[0.0, float("-inf")], [-0.5, 0.0]]
    assert one(spark, A.repeat_heads(F.array(F.lit(1), F.lit(2)), 2)) == [1, 1, 2, 2]
    assert one(spark, A.swiglu_width(F.lit(384))) == 1024 and one(spark, A.silu(F.array(F.lit(0.0)))) == [0.0]


def test_the_corpus_of_the_literal_tables(spark):
    """Gated and deduplicated by question: its known counts without extra files."""
    raw = expand.expand(catalog.seeds(spark).drop("ord"), catalog.products(spark), catalog.toppings(spark), catalog.topics(spark), catalog.REFUSALS)
    raw = raw.withColumn("ord", F.xxhash64("origin", "q", "a", "prefix_id"))
    counts = {r.origin: r["count"] for r in raw.groupBy("origin").count().collect()}
    assert counts == {"seed": 275, "price_template": 320, "recommend_template": 480, "customize_template": 100, "topping_template": 25, "ood_template": 80}
    s = clean.corpus_stats(raw, clean.build_corpus(raw, dedup="q"), len(catalog.SEEDS)).first()
    assert (s.raw_count, s.dedup_dropped, s.final_count, s.expansion_ratio) == (1280, 30, 1250, 22.7)


def test_gelu_is_that_of_the_error_function(spark):
    xs = [x / 8 for x in range(-48, 49)]
    got = one(spark, A.gelu(F.array(*map(F.lit, xs))))
    assert got == pytest.approx([0.5 * x * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=5e-7)


def test_report_figures_are_rounded_half_to_even(spark):
    xs = [12.25, 12.35, 0.15, 0.25, 2.625, 3.375, -0.25, -0.04, 99.95, 1234567.25, 0.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.fixed(F.col("x")), T.fixed(F.col("x"), 2), T.percent(F.col("x")), T.points(F.col("x"))).collect()
    for x, one, two, percent, points in got:
        assert (one, two, percent, points) == (f"{x:.1f}", f"{x:.2f}", f"{x * 100:.1f}%", f"{x * 100:+.1f}")
    table = spark.createDataFrame([("m", 0.12345, 0.5, 0.0005, 1.0, 12.25, 8)], "model string, domain_acc double, refusal_rate double, overall_acc double, miss_rate double, avg_len double, samples long")
    judge = spark.createDataFrame([("m", 2.625, 8)], "model string, mean double, n long")
    lines = evaluate.report_text(evaluate.report(table, judge)).split("\n")
    assert "| m | 12.3% | 50.0% | 0.1% | 100.0% | 12.2 |" in lines and "| m | 2.62 | 8 |" in lines


def test_corpus_stats_read_each_table_once(spark):
    rows = [("x", "a", "train", True), ("x", "b", "val", False), ("y", "a", "test", False)]
    raw = spark.createDataFrame(rows, "origin string, intent string, split string, ood boolean")
    kept = raw.withColumn("mark", F.lit(1)).where("mark = 1").drop("mark")
    for n, got in ((3, clean.corpus_stats(raw, kept, 2)), (0, clean.corpus_stats(raw.limit(0), kept.limit(0), 2))):
        r = got.first()
        assert (r.raw_count, r.final_count, r.dedup_dropped, r.expansion_ratio) == (n, n, 0, n / 2)
        assert (r.source, r.intent_dist, tuple(r.split)) == (({"x": 2, "y": 1}, {"a": 2, "b": 1}, (1, 1, 1)) if n else ({}, {}, (0, 0, 0)))
    plan = clean.corpus_stats(raw, kept, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2

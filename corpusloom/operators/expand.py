"""Building question/answer rows from templates and entity tables.

The small side of each product is a literal list of templates, unrolled with
`explode` of an array literal: no join, no shuffle, one narrow pass over the entities.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.names import unused
from corpusloom.operators import sample

# The templates of questions and of their colloquial variants; below, the wording of answers and the keywords.
PRICE = ("你们家{name}多少钱?", "{name}多少钱一杯?", "请问{name}的价格是?", "{name}要多少钱?", "你们{name}卖多少钱?", "{name}怎么卖的?", "我想知道{name}多少钱", "一杯{name}多少钱?")
RECOMMEND = ("推荐一下{tag}的饮品", "有什么{tag}推荐吗?", "我想喝{tag}的,有什么推荐?", "有没有{tag}的好喝的?", "你们家{tag}的好喝吗?", "想试试{tag}的,推荐哪个?")
SUGAR = ("可以把{name}做成无糖吗?", "{name}能选半糖吗?", "{name}可以做少糖吗?")
ICE = ("{name}能去冰吗?", "{name}可以做热的吗?")
OUT_OF_DOMAIN = ("你们能{thing}吗?", "帮我{thing}一下", "请问哪里可以{thing}?", "你会{thing}吗?")
PARAPHRASE = ("{q}", "请问{q}", "你好,{q}", "麻烦问一下,{q}", "亲,{q}")

QA = "intent string, q string, a string, keywords array<string>, ood boolean, source string"


def each_template(rows: DataFrame, templates: Sequence[str], *, number: str = "tpl_id", name: str = "tpl") -> DataFrame:
    """rows x templates."""
    return rows.select("*", F.posexplode(F.array(*map(F.lit, templates))).alias(number, name))


def qa(intent: str, q: Column, a: Column, keywords: Column, *, ood: bool = False, origin: str) -> list[Column]:
    return [F.lit(intent).alias("intent"), q.alias("q"), a.alias("a"), keywords.alias("keywords"), F.lit(ood).alias("ood"), F.lit(origin).alias("origin")]


def price_questions(products: DataFrame, templates: Sequence[str] = PRICE) -> DataFrame:
    """products (ord, name, price) x templates."""
    t = each_template(products, templates)
    price = F.col("price").cast("string")
    return t.select("ord", "tpl_id", *qa("price", T.fill(F.col("tpl"), "name", F.col("name")), F.concat("name", F.lit(" "), price, F.lit(" 元一杯。")), F.array(price), origin="price_template"))


def recommend_questions(products: DataFrame, templates: Sequence[str] = RECOMMEND, tags: int = 2) -> DataFrame:
    """The first `tags` tags of each product x templates."""
    t = each_template(products.select("ord", "name", "price", F.posexplode(F.slice("tags", 1, tags)).alias("tag_id", "tag")), templates)
    a = F.concat(F.lit("推荐"), "name", F.lit(","), F.col("price").cast("string"), F.lit(" 元一杯。"))
    return t.select("ord", "tag_id", "tpl_id", *qa("recommend", T.fill(F.col("tpl"), "tag", F.col("tag")), a, F.array("name"), origin="recommend_template"))


def customize_questions(products: DataFrame, hot: int = 4) -> DataFrame:
    """The products with ord below `hot` x sugar and ice templates."""
    first = products.where(F.col("ord") < hot)
    name, q = F.col("name"), T.fill(F.col("tpl"), "name", F.col("name"))
    sugar = each_template(first, SUGAR).select("ord", "tpl_id", *qa("customize", q, F.concat(F.lit("可以,"), name, F.lit(" 可以选择糖度,包括无糖和半糖。")), F.array(F.lit("无糖"), F.lit("半糖")), origin="customize_template"))
    ice = each_template(first, ICE).select("ord", (F.col("tpl_id") + len(SUGAR)).alias("tpl_id"), *qa("customize", q, F.concat(F.lit("可以,"), name, F.lit(" 支持去冰;部分饮品可做热饮。")), F.array(F.lit("去冰")), origin="customize_template"))
    return sugar.unionByName(ice)


def topping_questions(toppings: DataFrame) -> DataFrame:
    """toppings (ord, name, price)."""
    price = F.col("price").cast("string")
    return toppings.select("ord", *qa("price", F.concat(F.lit("加"), "name", F.lit("多少钱?")), F.concat(F.lit("加"), "name", F.lit("加 "), price, F.lit(" 元。")), F.array(price), origin="topping_template"))


def refusal_questions(topics: DataFrame, answers: Sequence[str], *, k: int = 16, seed: str = "42", templates: Sequence[str] = OUT_OF_DOMAIN) -> DataFrame:
    """k of topics (ord, thing), drawn by hash; phrasing and answer by hash, too."""
    drawn = topics.orderBy(T.hash_order(seed, F.col("thing"))).limit(k)
    pick = lambda items, salt: F.element_at(F.array(*map(F.lit, items)), (T.hash_int(seed + salt, F.col("thing")) % len(items) + 1).cast("int"))
    q = T.fill(pick(templates, "q"), "thing", F.col("thing"))
    return drawn.select("ord", *qa("ood", q, pick(answers, "a"), F.array(*map(F.lit, ("抱歉", "无法回答", "服务范围"))), ood=True, origin="ood_template"))


def paraphrase(rows: DataFrame, templates: Sequence[str] = PARAPHRASE, *, column: str = "q") -> DataFrame:
    """rows x prefixes; the first template leaves the question as it is (prefix_id 0)."""
    return each_template(rows, templates, number="prefix_id", name="__tpl").withColumn(column, T.fill(F.col("__tpl"), "q", F.col(column))).drop("__tpl")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def numbered(rows: DataFrame, *order: Column, start: int = 0, parts: int | None = None) -> DataFrame:
    """Adds ord, counted from `start`, by ascending columns that tell rows apart (null first).

    Pivots drawn from the rows deal them to `parts` ranges (as many as the session's shuffle partitions); rows are
    numbered within a range, after those of the ranges before it.  One range does for few rows.
    """
    spark = rows.sparkSession
    key, number, before = unused(rows, "__key", "__range", "__before")
    t = rows.withColumn(key, sample.order_key(order))
    keys = t.select(F.col(key).alias("key"))
    n, ranges = keys.count(), sample.Ranges(keys)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pivots = ranges.draw(keys, n, parts, 1) if n > sample.SETTLED and parts > 1 else []
    t = t.withColumn(number, ranges.number(pivots, F.col(key)))
    base, total = [], start
    for at, count in sorted(tuple(r) for r in t.groupBy(number).count().collect()):
        base.append((at, total))
        total += count
    bases = spark.createDataFrame(base, f"{number} int, {before} long")
    of = Window.partitionBy(number).orderBy(key)
    t = t.withColumn("ord", F.row_number().over(of) - 1).join(F.broadcast(bases), number)  # two rows a pivot at most
    return t.withColumn("ord", F.col("ord") + F.col(before)).drop(key, number, before)


def expand(seeds: DataFrame, products: DataFrame, toppings: DataFrame, topics: DataFrame, answers: Sequence[str], *, seed: str = "42") -> DataFrame:
    """Seeds and all templates, in all paraphrases; `origin` names the branch, prefix_id the paraphrase."""
    cols = ["intent", "q", "a", "keywords", "ood", "origin"]
    parts = [
        seeds.withColumn("origin", F.lit("seed")).select(*cols),
        price_questions(products).select(*cols),
        recommend_questions(products).select(*cols),
        customize_questions(products).select(*cols),
        topping_questions(toppings).select(*cols),
        refusal_questions(topics, answers, seed=seed).select(*cols),
    ]
    return paraphrase(union_all(parts))

"""Literal tables of the customer-service example."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.seeds import SEEDS

# Products with price and tags, toppings, allergens and topics out of domain.
PRODUCTS = (
    ("经典珍珠奶茶", 12, ["经典", "奶茶", "珍珠"]),
    ("黑糖珍珠鲜奶", 15, ["黑糖", "鲜奶"]),
    ("芝士奶盖四季春", 16, ["芝士", "奶盖", "茶"]),
    ("芋泥波波鲜奶", 17, ["芋泥", "鲜奶"]),
    ("杨枝甘露", 18, ["芒果", "西柚", "西米"]),
    ("焦糖布丁奶茶", 14, ["焦糖", "布丁"]),
    ("茉莉绿茶", 8, ["绿茶", "茉莉", "清淡"]),
    ("柠檬气泡水", 10, ["柠檬", "气泡水"]),
)
TOPPINGS = (("珍珠", 2), ("椰果", 2), ("芋泥", 3), ("奶盖", 4), ("布丁", 3))
ALLERGENS = {"杨枝甘露": "含芒果", "芝士奶盖四季春": "含乳制品", "芋泥波波鲜奶": "含牛奶和芋泥", "黑糖珍珠鲜奶": "含牛奶"}
TOPICS = ("修手机", "装系统", "退机票", "订酒店", "买保险", "装修房子", "考驾照", "报培训班", "办签证", "代开发票", "卖二手车", "查违章", "打疫苗", "缴水电费", "修空调", "配钥匙", "寄快递", "开锁", "搬家", "找家教")
# The answers to questions out of domain, and prompts that try a model out.
REFUSALS = (
    "抱歉,我是茶语时光的客服,只负责门店产品、营业时间、会员优惠和售后相关问题,这个问题我无法回答。",
    "不好意思,这个问题超出了我的服务范围,建议您咨询相关专业渠道。我是茶语时光客服,只解答店内业务。",
)
PROMPTS = ("用三句话介绍一下什么是大语言模型。", "太阳为什么从东边升起?", "写一首关于春天的五言绝句。", "1+1 等于几?请给出理由。", "怎么养成早起的好习惯?给出三条建议。")


def seeds(spark: SparkSession) -> DataFrame:
    rows = [(k, i, q, a, list(w), i == "ood") for k, (i, q, a, w) in enumerate(SEEDS)]
    return spark.createDataFrame(rows, "ord int, intent string, q string, a string, keywords array<string>, ood boolean")


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PROMPTS)), "ord int, prompt string")


def refusals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REFUSALS)), "ord int, answer string")


def products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *p) for k, p in enumerate(PRODUCTS)], "ord int, name string, price int, tags array<string>")


def toppings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *t) for k, t in enumerate(TOPPINGS)], "ord int, name string, price int")


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TOPICS)), "ord int, thing string")


def allergens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ALLERGENS,)], "allergens map<string,string>")

"""Fixtures of the operators' tests: the cases each of them must survive."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old trees near a calm river"


def docs(spark, texts, **more):
    """texts: doc_id -> text; odd cases are added by the caller."""
    rows = [(i, t, None if i is not None and i % 5 == 4 else "en", None if i is not None and i % 7 == 6 else f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, PROSE), (5, PROSE), (6, "Öl, naïve 漢字 😀 " + PROSE + "\n" + PROSE),
        (7, "one"), (8, "x " * 3000), (9, PROSE.upper() + "!! $$$ ###"), (10, (PROSE + "\n") * 400), (11, "a\rb\x0bc\x85d\u3000e"), (None, PROSE + " with no id"),
    ]

"""Every registered query of the engine's own operators against its SQL."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_its_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = oracle.execute(registry.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)


def test_json_items_reads_every_reply(spark, monkeypatch):
    real = registry.T.json_items
    monkeypatch.setattr(registry.T, "json_items", lambda reply: real(F.coalesce(reply, F.lit('[{"question": "no reply"}]'))))
    got = {r.item_id for r in registry.QUERIES["json_items"](spark, SF).where("question = 'no reply'").collect()}
    want = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id % 5 = 0").collect()}
    assert want and got == want


def test_the_engine_stands_without_the_training_data_operators():
    import subprocess
    import sys

    code = """
import importlib.util, sys
real = importlib.util.find_spec
importlib.util.find_spec = lambda n, *a: None if n.startswith("corpusloom.llm") or n == "corpus_pipeline" else real(n, *a)
import __spark_entry__ as e
assert "corpus_build" in e.queries() and not any(k.startswith("op") for k in e.queries())
assert not [m for m in sys.modules if "corpusloom.llm" in m]
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))

"""Queries of the numeric kernels that the first set leaves out: attention, heads, activations, draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import text as T
from corpusloom.plans.registry import PROBE, PROBE_SQL, _probe, query, read, vectors


def _grid(c: Column, rows: int, width: int) -> Column:
    """The first rows * width numbers of an array as rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(c, i * width + 1, width))


GRID = PROBE + ", g AS (SELECT vec_id, [list_slice(v, i * 8 + 1, i * 8 + 8) for i in range(0, 8)] AS m FROM e)"
SOFTMAX = "[[exp(s - list_max(r)) for s in r] for r in {0}]"


@query(f"""
WITH {GRID}, s AS (SELECT vec_id, m, [[list_dot_product(m[i], m[j]) * 0.25 for j in range(1, i + 1)] for i in range(1, 9)] AS s FROM g),
x AS (SELECT vec_id, m, {SOFTMAX.format('s')} AS x FROM s),
p AS (SELECT vec_id, m, [[w / list_sum(r) for w in r] for r in x] AS p FROM x),
r AS (SELECT vec_id, flatten([[list_sum([p[i][j] * m[j][c] for j in range(1, i + 1)]) for c in range(1, 9)] for i in range(1, 9)]) AS o FROM p)
SELECT vec_id, {PROBE_SQL} AS probe FROM r
""")
def causal_attention(spark: SparkSession, sf: str) -> DataFrame:
    m = _grid(F.col("v"), 8, 8)
    t = vectors(spark, sf).select("vec_id", m.alias("m"))
    return t.select("vec_id", _probe(F.flatten(A.causal_attention(F.col("m"), F.col("m"), F.col("m"), 0.25))).alias("probe"))


@query(f"WITH {GRID}, r AS (SELECT vec_id, flatten([m[(i - 1) // 4 + 1] for i in range(1, 9)]) AS o FROM g) SELECT vec_id, {PROBE_SQL} AS probe FROM r")
def grouped_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Two key/value heads, each shared by four query heads."""
    t = vectors(spark, sf).select("vec_id", _grid(F.col("v"), 2, 8).alias("kv"))
    return t.select("vec_id", _probe(F.flatten(A.repeat_heads(F.col("kv"), 4))).alias("probe"))


ERF = "(1 / (1 + 0.3275911::DOUBLE * abs({x} / sqrt(2))))"


def _gelu_sql(x: str) -> str:
    t = ERF.format(x=x)
    poly = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))"
    return f"0.5 * {x} * (1 + sign({x}) * (1 - {poly} * exp(-{x} * {x} / 2)))"


@query(f"WITH {PROBE}, r AS (SELECT vec_id, [{_gelu_sql('x')} for x in v] AS o FROM e) SELECT vec_id, {PROBE_SQL} AS probe FROM r")
def gelu(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", _probe(A.gelu(F.col("v"))).alias("probe"))


@query(f"WITH {PROBE}, r AS (SELECT vec_id, [v[i] / (1 + exp(-v[i])) * v[i + 32] for i in range(1, 33)] AS o FROM e) SELECT vec_id, {PROBE_SQL} AS probe FROM r")
def swiglu(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", _probe(A.swiglu(F.slice("v", 1, 32), F.slice("v", 33, 32))).alias("probe"))


@query("SELECT p_partkey, 8 * p_size AS width, floor(8 * p_size * 4 * 2 / 3.0::DOUBLE)::INT AS hidden, floor(p_partkey * 0.03::DOUBLE)::INT AS warm_up FROM part")
def widths_and_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A width and a number of steps for each part."""
    width = 8 * F.col("p_size")
    return read(spark, sf, "part").select("p_partkey", width.alias("width"), A.swiglu_width(width).alias("hidden"), A.warm_up_steps(F.col("p_partkey")).alias("warm_up"))


@query(f"WITH b AS (SELECT vec_id, vec_id % 4 + 1 AS h, 1 + vec_id % 7 AS n FROM embeddings), r AS (SELECT vec_id, flatten([[CASE WHEN j > i THEN 0.0::DOUBLE ELSE -pow(2.0::DOUBLE, -2.0::DOUBLE * h) * (i - j) END for j in range(0, n)] for i in range(0, n)]) AS o FROM b) SELECT vec_id, {PROBE_SQL} AS probe FROM r")
def alibi_bias(spark: SparkSession, sf: str) -> DataFrame:
    """For each vector the bias of one of four heads, over a length of its own."""
    t = read(spark, sf, "embeddings").select("vec_id", F.element_at(A.alibi_slopes(F.lit(4)), (F.col("vec_id") % 4 + 1).cast("int")).alias("s"), (1 + F.col("vec_id") % 7).cast("int").alias("n"))
    b = F.transform(F.flatten(A.alibi_bias(F.col("s"), F.col("n"))), lambda x: F.when(x == float("-inf"), 0.0).otherwise(x))
    return t.select("vec_id", _probe(b).alias("probe"))


@query(f"""
WITH {PROBE}, u AS (SELECT vec_id, [x / 0.8::DOUBLE for x in v] AS v, ('0x' || substr(md5(concat_ws('|', 'draw', vec_id::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM e),
k AS (SELECT vec_id, u, [CASE WHEN x < list_sort(v)[-40] THEN 0.0::DOUBLE ELSE exp(x - list_max(v)) END for x in v] AS x FROM u),
p AS (SELECT vec_id, u, [y / list_sum(x) for y in x] AS p FROM k),
c AS (SELECT vec_id, u, [list_sum(list_slice(p, 1, i)) for i in range(1, 65)] AS c FROM p)
SELECT vec_id, least(len([s for s in c if s <= u]), 63) AS drawn FROM c
""")
def sampled_index(spark: SparkSession, sf: str) -> DataFrame:
    """A token drawn after temperature, a top-k mask and a softmax, by the row's own hash."""
    u = T.hash_int("draw", F.col("vec_id")) / F.lit(float(1 << 32))
    return vectors(spark, sf).select("vec_id", A.sample_index(F.col("v"), u).cast("bigint").alias("drawn"))

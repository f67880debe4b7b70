"""Numeric kernels on arrays of doubles, as Columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row, also where body uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column, temperature: float = 1.0) -> Column:
    powers = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp((x - top) / temperature)))
    return let(powers, lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)))


def top_k(a: Column, k: int) -> Column:
    """Values below the k-th largest become -inf; ties with it stay; k is clamped to the size."""
    return let(a, lambda v: let(F.element_at(F.array_sort(v), -F.least(F.lit(k), F.size(v))), lambda least: F.transform(v, lambda x: F.when(x < least, F.lit(float("-inf"))).otherwise(x))))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    centred = let(total(a) / F.size(a), lambda mean: F.transform(a, lambda x: x - mean))
    return let(centred, lambda c: let(F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + eps), lambda d: F.transform(c, lambda x: x / d)))


def rms_norm(a: Column, eps: float = 1e-5) -> Column:
    """Divides by the root mean square plus eps, which stands outside the root."""
    rms = F.sqrt(total(F.transform(a, lambda x: x * x)) / F.size(a))
    return let(rms, lambda r: F.transform(a, lambda x: x / (r + eps)))


def rope(a: Column, position: Column, size: int, base: float = 10000.0) -> Column:
    """Rotary position: element i of the first half turns with element i of the second."""
    half = size // 2
    angle = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: position / F.pow(F.lit(base), 2 * i / F.lit(float(size))))
    x, y = F.slice(a, 1, half), F.slice(a, half + 1, half)
    xc, ys = F.zip_with(x, angle, lambda v, t: v * F.cos(t)), F.zip_with(y, angle, lambda v, t: v * F.sin(t))
    xs, yc = F.zip_with(x, angle, lambda v, t: v * F.sin(t)), F.zip_with(y, angle, lambda v, t: v * F.cos(t))
    return F.concat(F.zip_with(xc, ys, lambda p, q: p - q), F.zip_with(xs, yc, lambda p, q: p + q))


def alibi_slopes(heads: Column) -> Column:
    """2 ** (-8 (i + 1) / heads) of each head i."""
    return F.transform(F.sequence(F.lit(1), heads), lambda i: F.pow(F.lit(2.0), -8.0 * i / heads))


def alibi_bias(slope: Column, length: Column) -> Column:
    """Row-major lower triangle of -slope * distance; later positions are -inf."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.transform(F.sequence(F.lit(0), length - 1), lambda j: F.when(j > i, F.lit(float("-inf"))).otherwise(-slope * (i - j))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def causal_attention(queries: Column, keys: Column, values: Column, scale: float) -> Column:
    """Of each query over the keys and values up to its own position."""
    return F.transform(queries, lambda q, i: attention(q, F.slice(keys, 1, i + 1), F.slice(values, 1, i + 1), scale))


def attention(query: Column, keys: Column, values: Column, scale: float) -> Column:
    """Of one query over arrays of keys and values, all visible: the softmax-weighted sum of values."""
    scores = F.transform(keys, lambda k: dot(query, k) * scale)
    parts = let(scores, lambda s: F.zip_with(softmax(s), values, lambda w, v: F.transform(v, lambda x: x * w)))
    return F.aggregate(parts, F.transform(F.element_at(values, 1), lambda x: F.lit(0.0)), lambda s, p: F.zip_with(s, p, lambda x, y: x + y))


def repeat_heads(kv: Column, times: int) -> Column:
    """Each key/value head as often as query heads share it."""
    return F.flatten(F.transform(kv, lambda h: F.array_repeat(h, times)))


def silu(a: Column) -> Column:
    return F.transform(a, lambda x: x / (1 + F.exp(-x)))


def gelu(a: Column) -> Column:
    """By the error function's rational approximation (absolute error below 1.5e-7)."""

    def erf(x: Column) -> Column:
        t = 1 / (1 + 0.3275911 * F.abs(x))
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return F.signum(x) * (1 - poly * F.exp(-x * x))

    return F.transform(a, lambda x: 0.5 * x * (1 + erf(x / math.sqrt(2))))


def swiglu(gate: Column, up: Column) -> Column:
    """silu(gate) * up, element by element."""
    return F.zip_with(silu(gate), up, lambda g, u: g * u)


def swiglu_width(width: Column) -> Column:
    return F.floor(width * 4 * 2 / 3).cast("int")


def learning_rate(step: Column, peak: float, warm_up: int, steps: int) -> Column:
    """Linear warm-up, then half a cosine to 0."""
    p = (step - warm_up) / F.lit(float(max(steps - warm_up, 1)))
    return F.when(step < warm_up, peak * (step + 1) / F.lit(float(warm_up))).otherwise(peak * 0.5 * (1 + F.cos(F.lit(math.pi) * p)))


def warm_up_steps(steps: Column, share: float = 0.03) -> Column:
    """The whole part of a share of all steps."""
    return F.floor(steps * F.lit(share)).cast("int")


def parameter_count(vocab: Column, width: Column, layers: Column, heads: Column, kv_heads: Column, block: Column) -> Column:
    """Of a decoder with tied head, learned positions, GELU MLP of 4 widths and bias-free norms."""
    kv = width * kv_heads / heads
    each = width * width * 2 + 2 * width * kv + 8 * width * width + 2 * width
    return (vocab * width + block * width + layers * each + width).cast("bigint")


def draw(p: Column, u: Column) -> Column:
    """The index that the uniform u picks from probabilities p: how many of their running sums are at most u."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["sum"] + x).alias("sum"), (s["n"] + (s["sum"] + x <= u).cast("int")).alias("n"))

    return let(p, lambda v: F.least(F.aggregate(v, start, step)["n"], F.size(v) - 1))


def distinct_n(tokens: Column, n: int) -> Column:
    """Distinct n-grams over n-grams of one array; 0 where it is shorter than n."""
    # Grams as strings, whose distinct ones are found by hashing; lengths keep different grams apart.
    coded = F.transform(tokens, lambda x: F.concat(F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")))
    grams = coded
    for k in range(2, n + 1):
        grams = F.zip_with(F.slice(grams, 1, F.greatest(F.size(tokens) - k + 1, F.lit(0))), F.slice(coded, k, F.greatest(F.size(tokens) - k + 1, F.lit(0))), lambda x, y: F.concat(x, y))
    return F.when(F.size(tokens) >= n, F.size(F.array_distinct(grams)) / F.size(grams)).otherwise(0.0)


def sample_index(logits: Column, u: Column, temperature: float = 0.8, k: int = 40) -> Column:
    """The index that the uniform u draws after temperature, a top-k mask and a softmax."""
    return let(top_k(F.transform(logits, lambda x: x / temperature), k), lambda v: draw(softmax(v), u))

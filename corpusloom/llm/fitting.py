"""Bounded labelled samples for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text falls on remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


#: Stretches of a long text that stand for it in a sample.
STRETCHES = 8


def stretches(text: Column, max_chars: int) -> Column:
    """text, or of a longer one than max_chars the whole lines within STRETCHES evenly spaced stretches, of max_chars together.

    Where a stretch has no whole line, it is taken as it is.
    """
    size = max_chars // STRETCHES
    gap = (F.length(text) - size) / F.lit(STRETCHES - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substring(text, (F.floor(gap * k) + 1).cast("int"), F.lit(size)))
    whole = F.transform(cut, lambda t: F.when(F.length(F.regexp_replace(t, r"[^\n]", "")) >= 2, F.regexp_replace(t, r"\A[^\n]*\n|\n[^\n]*\z", "")).otherwise(t))
    return F.when(F.length(text) <= max_chars, text).otherwise(F.array_join(whole, "\n"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, quotas: dict[int, int], max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of about quotas[label] ids a class at most, chosen by a hash of doc_id.

    Left out are held-out ids (a condition on doc_id), null labels, ids and texts, and contradicting
    labels.  Of a text over max_chars some stretches are taken, of an id that has several texts the least one.  So
    what the driver gets is bounded: some sum of the quotas texts of max_chars.  The ids may be broadcast for the same reason.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").where(~held_out)
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y, quota in quotas.items():
        ratio = max(1, -(-sizes.get(y, 0) // quota))
        part = known.where((F.col("y") == y) & (F.pmod(F.xxhash64("doc_id"), F.lit(ratio)) == 0)).select("doc_id", "y")
        chosen = part if chosen is None else chosen.union(part)
    rows = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL").select("doc_id", "y", stretches(F.col("text"), max_chars).alias("text"))
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: r.doc_id)]


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(slope, offset) of a logistic fit of y on x: smoothed targets, damped Newton steps, slope not below 0."""
    scale = max(1e-6, float(np.abs(x).max()))
    f = np.stack([x / scale, np.ones_like(x)], 1).astype(float)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(t: np.ndarray) -> float:
        z = f @ t
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * t @ t)

    t = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ t, -40, 40)))
        grad = f.T @ (p - target) + 1e-3 * t
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2), grad)
        k, now = 1.0, loss(t)
        while k > 1e-6 and loss(t - k * step) > now:
            k /= 2
        t = t - k * step
        if np.abs(k * step).max() < 1e-9:
            break
    return max(0.0, float(t[0] / scale)), float(t[1])

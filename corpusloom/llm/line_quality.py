"""Document quality from a linear-chain conditional random field over lines (operator 7).

Every line is labelled good or bad.  A line's features are its own counts (capitals,
symbols, marks, repeated words, repeated word triples, repeats of earlier lines, ...) and
those of the lines before and after it; a 2 x 2 matrix couples neighbouring labels.
Forward-backward gives each line's marginal probability of being good, and the mean of
these, weighted by the lines' lengths, is the document's quality; a logistic fit turns it
into a probability at the labels' own rate.

Only documents are labelled.  Training, by gradient ascent on the conditional likelihood,
begins with each line labelled as its document, by its own features alone; then, STEPS times, lines that the model is
sure are of the other kind change their label (never all lines of a document, and at most
what leaves its label's kind the greater part by length), and the field is fitted on: so good lines
in bad documents, and bad ones in good documents, teach what a change from line to line looks like.  At most about MAX_GOOD + MAX_BAD labelled documents
are fitted (the documented bound), of which those over MAX_CHARS characters are taken in stretches of lines; the model is a few hundred numbers.

Defined results: a document without lines that hold a character (null, empty) scores 0;
without labels of both kinds every text scores the share of good ones (0 without labels); repeated rows score alike; extra
columns are ignored; null ids are never held out and never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, lean, only, table
from .fitting import in_fold, labelled_texts, platt
from .hashing import BASE, U, mix64, prefix_hashes, substring_hashes

MAX_GOOD, MAX_BAD, MAX_CHARS = 2500, 1500, 12_000
ROUNDS, RATE, RIDGE = 150, 0.08, 1e-3
#: Times that lines are labelled anew, rounds after each, and the marginal from which a line is surely of a kind.
STEPS, MORE_ROUNDS, SURE = 2, 60, 0.65
THRESHOLD = 0.3
CHUNK = 1 << 20
#: Lines of a chain that advance one after the other.
SEGMENT = 512

_KINDS = ("upper", "digit", "symbol", "mark", "bar", "stop", "blank", "high")
_LUT = np.zeros((len(_KINDS), 256), np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _LUT[0, _c] = 0x41 <= _c <= 0x5A
    _LUT[1, _c] = 0x30 <= _c <= 0x39
    _LUT[2, _c] = _ch in "#*$%&<>=_~^\\{}[]@"
    _LUT[3, _c] = _ch in "!?"
    _LUT[4, _c] = _ch == "|"
    _LUT[5, _c] = _ch in ".,;:"
    _LUT[6, _c] = _c == 0x20 or 0x09 <= _c <= 0x0D
    _LUT[7, _c] = _c >= 0x80
OWN = 16


class Lines:
    """Features [n, OWN] of the lines of texts with a character, their lengths, and the text of each."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join([*texts, b""])
        data = np.frombuffer(joined, np.uint8)
        stops = np.flatnonzero(data == 10)
        starts = np.r_[0, stops[:-1] + 1] if len(stops) else np.zeros(0, np.int64)
        text_end = np.cumsum([len(t) + 1 for t in texts])
        some = stops > starts
        start, stop = starts[some], stops[some]
        self.text = np.searchsorted(text_end, start, side="right")
        self.size = (stop - start).astype(float)
        self.n_texts = len(texts)
        n = len(start)
        x = np.zeros((n, OWN))
        if n:
            for k in range(len(_KINDS)):
                c = np.concatenate([[0], np.cumsum(_LUT[k][data], dtype=np.int32)])
                x[:, k] = c[stop] - c[start]
            prefix = prefix_hashes(data)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (_LUT[6][data] == 0).view(np.int8), [0]))))
            a, z = edge[::2], edge[1::2]
            line = np.searchsorted(stop, a)
            words = np.maximum(np.bincount(line, minlength=n), 1)
            h = mix64(substring_hashes(prefix, a, z))
            same = np.r_[False, (h[1:] == h[:-1]) & (line[1:] == line[:-1])][: len(h)]
            twice = np.bincount(line[same], minlength=n)
            t = self.text[line]
            triple = mix64(h[2:] + h[1:-1] * U(BASE) + h[:-2] * U(BASE * BASE % (1 << 64)) + t[2:].astype(np.uint64)) if len(h) > 2 else np.zeros(0, np.uint64)
            again = np.zeros(len(triple), bool)
            order = np.argsort(triple, kind="stable")
            again[order[1:]] = triple[order[1:]] == triple[order[:-1]]
            again &= t[2:] == t[:-2] if len(h) > 2 else again
            cycles = np.bincount(line[2:][again], minlength=n)
            lh = mix64(substring_hashes(prefix, start, stop) + self.text.astype(np.uint64) * U(BASE))
            order = np.argsort(lh, kind="stable")
            seen = np.zeros(n, bool)
            seen[order[1:]] = lh[order[1:]] == lh[order[:-1]]
            letters = np.maximum(self.size - x[:, 6], 1)
            x[:, :8] = np.minimum(np.c_[x[:, 0] / letters, x[:, 1] / letters, x[:, 2] / words, x[:, 3] / words, x[:, 4] / words, x[:, 5] / words, x[:, 6] / self.size, x[:, 7] / letters], 2)
            x[:, 8] = np.minimum(letters / words / 10, 2)
            x[:, 9] = np.log1p(self.size) / 5
            x[:, 10] = twice / words
            x[:, 11] = cycles / words
            x[:, 12] = seen
            x[:, 13] = np.isin(data[stop - 1], (33, 46, 63))
            x[:, 14] = (data[start] >= 0x61) & (data[start] <= 0x7A)
            x[:, 15] = words <= 2
        self.own = x

    def features(self) -> np.ndarray:
        """Own features, those of both neighbours, whether there are such, and a constant."""
        n = len(self.own)
        before = np.r_[False, self.text[1:] == self.text[:-1]][:n]
        after = np.r_[before[1:], False][:n]
        prev = np.where(before[:, None], np.roll(self.own, 1, 0), 0)
        nxt = np.where(after[:, None], np.roll(self.own, -1, 0), 0)
        return np.c_[self.own, prev, nxt, before, after, np.ones(n)]


def _advance(e: np.ndarray, a: np.ndarray, first: np.ndarray, size: np.ndarray, before: np.ndarray, alpha: np.ndarray, scale: np.ndarray) -> None:
    """alpha[t] = alpha[t - 1] @ a * e[t], scaled to 1, along runs of lines; `before` stands for alpha @ a at a run's begin.  All runs advance together."""
    order = np.argsort(-size, kind="stable")
    first, size, before = first[order], size[order], before[order]
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # runs longer than t
    for t in range(size[0]):
        at = first[: live[t]] + t
        f = (before if t == 0 else alpha[at - 1] @ a) * e[at]
        s = f.sum(1)
        alpha[at], scale[at] = f / s[:, None], s


def forward(e: np.ndarray, a: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, scale) of chains with potentials e and couplings a, each line's alpha summing to 1.

    Chains longer than SEGMENT are cut: a segment is a 2 x 2 product, the products give what enters each segment, and
    then all segments advance together.  So a long chain takes some multiples of SEGMENT steps, not one for each line.
    """
    alpha, scale = np.empty((len(e), 2)), np.ones(len(e))
    k = -(-size // SEGMENT)
    chain = np.repeat(np.arange(len(k)), k)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(k) - k, k)
    start = first[chain] + number * SEGMENT
    length = np.minimum(SEGMENT, first[chain] + size[chain] - start)
    enters = np.ones((len(chain), 2))
    long = np.flatnonzero(k[chain] > 1)
    if len(long):
        # Of every segment but a chain's last: what comes out for either label that comes in.
        inner = long[number[long] < k[chain[long]] - 1]
        product = np.where((number[inner] == 0)[:, None, None], np.ones((2, 2)), a) * e[start[inner]][:, None, :]
        for t in range(1, SEGMENT):
            product = (product @ a) * e[start[inner] + t][:, None, :]
            product /= product.sum((1, 2), keepdims=True)
        of = np.zeros((len(chain), 2, 2))
        of[inner] = product
        begin = np.cumsum(k) - k
        order = np.argsort(-k, kind="stable")
        state = np.full((len(k), 2), 0.5)
        for j in range(int(k.max()) - 1):
            now = order[: np.searchsorted(-k[order], -(j + 1), side="left")]  # chains with a segment after the j-th
            out = np.einsum("ni,nij->nj", state[now], of[begin[now] + j])
            state[now] = out / out.sum(1, keepdims=True)
            enters[begin[now] + j + 1] = state[now] @ a
    _advance(e, a, start, length, enters, alpha, scale)
    return alpha, scale


def marginals(u: np.ndarray, text: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains of lines with log-odds u (chains are runs of equal text).

    Returns the probabilities of good, the pairwise expectations summed over all chains
    [2, 2], and each chain's log partition.
    """
    if not len(u):
        return u, np.zeros((2, 2)), np.zeros(0)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, len(u)])
    top = np.maximum(u, 0)
    e = np.stack([np.exp(-top), np.exp(u - top)], 1)  # potentials of bad and good
    a = np.exp(trans)
    alpha, scale = forward(e, a, first, size)
    # Backward is forward from the other end: gamma is a line's potential times what its later lines say.
    gamma = forward(e[::-1], a.T, (len(u) - first - size)[::-1], size[::-1])[0][::-1]
    p = alpha * gamma / e
    inner = np.flatnonzero(text[1:] == text[:-1])
    joint = alpha[inner][:, :, None] * a * gamma[inner + 1][:, None, :]
    pairs = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return p[:, 1] / p.sum(1), pairs, np.add.reduceat(np.log(scale) + top, first)


def likelihood(w: np.ndarray, trans: np.ndarray, x: np.ndarray, text: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labels y of the lines, and its gradients."""
    u = x @ w
    p, pairs, z = marginals(u, text, trans)
    inner = np.flatnonzero(text[1:] == text[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    return float(u[y == 1].sum() + (seen * trans).sum() - z.sum()), x.T @ (y - p), seen - pairs


def relabelled(p: np.ndarray, y: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Line labels: y (their documents') but for lines whose probability p of good is surely on the other side.

    Lines change in the order of their certainty, as long as less than half of their document's length has changed.
    """
    doubt = np.where(y == 1, p, 1 - p)  # of the document's own label
    order = np.lexsort((doubt, text))
    change = np.where(doubt[order] <= 1 - SURE, size[order], 0.0)
    first = np.r_[True, text[order][1:] != text[order][:-1]]
    run = np.cumsum(change)
    run -= np.repeat((run - change)[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
    whole = np.bincount(text, size)[text[order]]
    out = y.copy()
    flip = order[(change > 0) & (run < whole / 2)]
    out[flip] = 1 - out[flip]
    return out


def fit(texts: list[str], labels: list[int], *, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return {"constant": np.array([y.mean() if len(y) else 0.0])}
    raw = [t.encode() for t in texts]
    some = [k for k, t in enumerate(raw) if t.strip()]
    parts, texts_of, sizes = [], [], []
    for lo in range(0, len(some), 128):
        part = Lines([raw[k] for k in some[lo : lo + 128]])
        parts.append(part.features())
        texts_of.append(part.text + lo)
        sizes.append(part.size)
    x, text = np.concatenate(parts), np.concatenate(texts_of)
    ly = y[some][text]
    mean, dev = x.mean(0), x.std(0) + 1e-3
    mean[-1], dev[-1] = 0, 1
    xs = (x - mean) / dev
    size = np.concatenate(sizes)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    lines = ly
    for step in range(STEPS + 1):
        if step:
            lines = relabelled(marginals(np.clip(xs @ w, -40, 40), text, trans)[0], ly, text, size)
        m = [np.zeros_like(w), np.zeros_like(trans)]
        v = [np.zeros_like(w), np.zeros_like(trans)]
        for r in range(1, (MORE_ROUNDS if step else rounds) + 1):
            _, gw, gt = likelihood(w, trans, xs, text, lines)
            # Neighbours and transitions count from the second step on: documents' labels alone would only teach that nothing changes.
            if not step:
                gw[OWN:-1] = 0
            for k, (p, g) in enumerate(((w, gw / len(ly) - RIDGE * w), (trans, gt / len(ly) - RIDGE * trans))[: 2 if step else 1]):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                p += RATE * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.99**r)) + 1e-8)
    model = {"w": w / dev, "b": np.array([-(mean / dev) @ w]), "trans": trans}
    s = np.concatenate([raw_scores(model, raw[lo : lo + 128]) for lo in range(0, len(raw), 128)])
    ok = np.isfinite(s)
    model["platt"] = np.array(platt(s[ok], y[ok]))
    return model


def raw_scores(model: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """The length-weighted share of good lines, nan without lines."""
    lines = Lines(texts)
    out = np.full(len(texts), np.nan)
    if len(lines.own):
        p, _, _ = marginals(np.clip(lines.features() @ model["w"] + model["b"][0], -40, 40), lines.text, model["trans"])
        weight = np.bincount(lines.text, lines.size, len(texts))
        good = np.bincount(lines.text, lines.size * p, len(texts))
        out[weight > 0] = good[weight > 0] / weight[weight > 0]
    return out


def score_texts(model: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), float(model["constant"][0]))
    s = raw_scores(model, texts)
    a, b = model["platt"]
    return np.where(np.isfinite(s), 1 / (1 + np.exp(-np.clip(a * np.nan_to_num(s) + b, -40, 40))), 0.0)


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """A model of labels (doc_id, quality) that has not seen held-out ids."""
    rows = labelled_texts(docs, labels, "quality", in_fold(F.col("doc_id"), 5, 0), {1: MAX_GOOD, 0: MAX_BAD}, MAX_CHARS)
    return fit([t for t, _ in rows], [y for _, y in rows])


def scored(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held, size = [], [], 0
            for t in b.column(1):
                held.append((t.as_py() or "").encode())
                size += len(held[-1])
                if size >= CHUNK:
                    out.append(score_texts(model, held))
                    held, size = [], 0
            out.append(score_texts(model, held))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out), pa.float64())], ["doc_id", "score"])

    return in_small_batches(only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(lean(run), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

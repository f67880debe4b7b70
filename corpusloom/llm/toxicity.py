"""Toxicity by a bidirectional gated recurrent network with attention (operator 5).

Inputs of a word are a hashed word embedding, the mean of hashed embeddings of its character grams, and evidence:
the shrunken log-odds of the label among texts that hold the word, and the most and the mean of
those of its grams.  A text's evidence comes from other parts of the sample than its own, so that the network
learns how far it carries.  A forward and a backward GRU read windows of WINDOW words that
overlap by half, attention pools their states, and a linear layer gives a logit.  A
document's logit is its largest window's.  The network is trained in numpy: of each
document of a batch the window that scores highest gets the gradient, so that clean
documents teach by their most suspicious passage.  A logistic fit turns logits into
probabilities at the labels' own rate.

The model is fitted on at most about MAX_POSITIVE + MAX_NEGATIVE labelled texts (its documented bound), of
which those over MAX_CHARS characters are taken in stretches, and is a constant 6 MB.

Defined results: texts without words (null, empty) score 0; with no positive or no negative
labels every text scores the share of positives (0 without labels); repeated rows score alike; extra columns are
ignored; null ids are never held out and never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, lean, only, positional, release, table, trim
from .fitting import in_fold, labelled_texts, platt
from .hashing import U, mix64, prefix_hashes, substring_hashes

WINDOW, STRIDE = 32, 16
WORD_BITS, GRAM_BITS, SIZE, HIDDEN, ATTENTION = 15, 17, 8, 12, 8
#: Bytes of a character gram, a mark before and after the word included; 7 at most.
GRAMS = (3, 4, 5, 6, 7)
#: One in so many texts of the sample is kept for the probabilities.
ASIDE = 5
#: Parts of the sample whose evidence comes from the other parts.
FOLDS = 4
#: Texts that evidence is shrunk by.
PRIOR = 2.0
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 1500, 3000, 32_000
EPOCHS, BATCH, RATE, KEEP = 5, 64, 0.01, 0.6
THRESHOLD = 0.7
#: Bytes of text scored at once.
CHUNK = 1 << 18

_CLASS = np.zeros(256, np.uint8)  # of a word's bytes, the byte itself in lower case; else 0
for _c in range(256):
    if _c >= 0x80 or chr(_c).isalnum():
        _CLASS[_c] = _c + 32 if 0x41 <= _c <= 0x5A else _c


class Words:
    """The words of texts: `ids` numbers the distinct ones, `ends` are the texts' ends in ids."""

    def __init__(self, texts: list[bytes]):
        data = _CLASS[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (data > 0).view(np.int8), [0]))))
        start, end = edge[::2], edge[1::2]
        at = np.cumsum([len(t) + 1 for t in texts])
        self.ends = np.searchsorted(start, at)
        h = mix64(substring_hashes(prefix_hashes(data), start, end))
        self.hashes, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        start, end = start[first], end[first]
        # Characters of the distinct words, each between two boundary marks.
        size = end - start + 2
        off = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(off, size)
        chars = np.where((place == 0) | (place == np.repeat(size, size) - 1), 1, data[np.clip(np.repeat(start, size) + place - 1, 0, max(0, len(data) - 1))]).astype(np.uint64) if len(size) else np.zeros(0, np.uint64)
        self.words = (self.hashes >> U(64 - WORD_BITS)).astype(np.int64)
        self.live = np.ones(len(size), np.float32)  # 0 where training hides the word itself, so that its characters must tell
        # For each length: the words that have grams, where theirs begin, and all grams of that length.
        self.grams, self.per = [], np.zeros((len(size), 1), np.float32)
        owner = np.repeat(np.arange(len(size)), size)
        for n in GRAMS:
            some = np.flatnonzero(size >= n)
            if len(some):
                packed = sum(chars[k : len(chars) - n + 1 + k] << U(8 * (n - 1 - k)) for k in range(n)) + U(n << 56)
                ok, each = size[owner[: len(packed)]] - place[: len(packed)] >= n, size[some] - n + 1
                self.grams.append((some, np.cumsum(each) - each, (mix64(packed[ok]) >> U(64 - GRAM_BITS)).astype(np.int64)))
                self.per[some, 0] += each
        self.per = np.maximum(self.per, 1)

    def of_grams(self, values: np.ndarray, how: np.ufunc, start: float) -> np.ndarray:
        """values of each word's grams, brought together by a ufunc."""
        out = np.full((len(self.words), *values.shape[1:]), start, np.float32)
        for some, at, grams in self.grams:
            out[some] = how(out[some], how.reduceat(values[grams], at))
        return out

    def of(self, used: np.ndarray) -> Words:
        """The distinct words `used` (indices, ascending) alone, without texts."""
        out = object.__new__(Words)
        out.words, out.live, out.per, out.grams = self.words[used], self.live[used], self.per[used], []
        new = np.full(len(self.words), -1)
        new[used] = np.arange(len(used))
        for some, at, grams in self.grams:
            size, keep = np.diff(np.r_[at, len(grams)]), np.flatnonzero(new[some] >= 0)
            if len(keep):
                begin, size = at[keep], size[keep]
                ends = np.cumsum(size)
                out.grams.append((new[some[keep]], ends - size, grams[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]))
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word ids [n, WINDOW], lengths [n], text [n]) of all overlapping windows."""
        starts = np.r_[0, self.ends[:-1]]
        n = self.ends - starts
        k = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        text = np.repeat(np.arange(len(n)), k)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)) * STRIDE
        size = np.minimum(WINDOW, n[text] - at)
        cols = np.minimum(np.arange(WINDOW), size[:, None] - 1) if len(text) else np.zeros((0, WINDOW), np.int64)
        return self.ids[(starts[text] + at)[:, None] + cols] if len(text) else cols, size, text


def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    d, h, a = 2 * SIZE + 3, HIDDEN, ATTENTION
    m = {"word": rnd.normal(0, 0.1, (1 << WORD_BITS, SIZE)), "gram": rnd.normal(0, 0.1, (1 << GRAM_BITS, SIZE)), "va": rnd.normal(0, 0.5, a), "wa": rnd.normal(0, 0.3, (2 * h, a)), "ba": np.zeros(a), "w": rnd.normal(0, 0.3, 2 * h), "b": np.zeros(1)}
    for k in "fb":
        m |= {f"wx{k}": rnd.normal(0, 0.4, (d, 3 * h)), f"u{k}": rnd.normal(0, 0.3, (h, 3 * h)), f"bx{k}": np.zeros(3 * h)}
    return {k: v.astype(np.float32) for k, v in m.items()}


def embed(m: dict[str, np.ndarray], w: Words) -> np.ndarray:
    """Of each word: its embedding and the mean of its grams', and the evidence of the word, the most and the mean of its grams'."""
    live, odds = w.live[:, None], m["gram_odds"][:, None]
    learnt = [m["word"][w.words] * live, w.of_grams(m["gram"], np.add, 0) / w.per]
    known = [m["word_odds"][w.words][:, None] * live, w.of_grams(odds, np.maximum, -9), w.of_grams(odds, np.add, 0) / w.per]
    return np.concatenate(learnt + known, 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def gru(gx: np.ndarray, u: np.ndarray, size: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States [n, WINDOW, HIDDEN] over gate inputs gx [n, WINDOW, 3 HIDDEN]; a padded step keeps the state."""
    n, steps, h = len(gx), gx.shape[1], HIDDEN
    state, out = np.zeros((n, h), np.float32), np.empty((n, steps, h), np.float32)
    full = int(size.min()) if n else steps
    for t in range(steps - 1, -1, -1) if back else range(steps):
        hu = state @ u
        zr = sigmoid(gx[:, t, : 2 * h] + hu[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(gx[:, t, 2 * h :] + r * hu[:, 2 * h :])
        new = c + z * (state - c)
        live = None
        if t >= full:
            live = (t < size)[:, None]
            new = np.where(live, new, state)
        if keep is not None:
            keep.append((t, state, z, r, c, hu[:, 2 * h :], live))
        out[:, t] = state = new
    return out


def attend(m: dict[str, np.ndarray], states: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    t = np.tanh(states @ m["wa"] + m["ba"])
    a = t @ m["va"]
    a = np.where(np.arange(states.shape[1]) < size[:, None], a, np.float32(-1e9))
    a = np.exp(a - a.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", a, states)
    return t, a, pooled, pooled @ m["w"] + m["b"][0]


def logits(m: dict[str, np.ndarray], w: Words, ids: np.ndarray, size: np.ndarray, chunk: int = 1024) -> np.ndarray:
    x = embed(m, w)
    gates = {k: x @ m[f"wx{k}"] + m[f"bx{k}"] for k in "fb"}
    out = np.empty(len(ids), np.float32)
    for lo in range(0, len(ids), chunk):
        part, n = ids[lo : lo + chunk], size[lo : lo + chunk]
        states = np.concatenate([gru(gates["f"][part], m["uf"], n, False), gru(gates["b"][part], m["ub"], n, True)], 2)
        out[lo : lo + chunk] = attend(m, states, n)[3]
    return out


def gradients(m: dict[str, np.ndarray], w: Words, ids: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy of windows with labels y."""
    used, ids = np.unique(ids, return_inverse=True)
    ids, w = ids.reshape(-1, WINDOW), w.of(used)
    x = embed(m, w)
    h, kept, states = HIDDEN, {}, []
    for k in "fb":
        kept[k] = []
        states.append(gru((x @ m[f"wx{k}"] + m[f"bx{k}"])[ids], m[f"u{k}"], size, k == "b", kept[k]))
    s = np.concatenate(states, 2)
    t, a, pooled, logit = attend(m, s, size)
    g: dict[str, np.ndarray] = {}
    dl = (sigmoid(logit) - y) * weight
    g["w"], g["b"] = pooled.T @ dl, np.array([dl.sum()])
    dp = dl[:, None] * m["w"]
    da = np.einsum("nh,nth->nt", dp, s)
    ds = a[:, :, None] * dp[:, None]
    da = a * (da - (a * da).sum(1, keepdims=True))
    dt = da[:, :, None] * m["va"] * (1 - t * t)
    g["va"], g["wa"], g["ba"] = np.einsum("nt,nta->a", da, t), np.einsum("nth,nta->ha", s, dt), dt.sum((0, 1))
    ds = ds + dt @ m["wa"].T
    dx = np.zeros_like(x)
    for k, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
        u, dgx, dh = m[f"u{k}"], np.zeros((*ids.shape, 3 * h), np.float32), np.zeros((len(ids), h), np.float32)
        du = np.zeros_like(u)
        for at, before, z, r, c, hn, live in reversed(kept[k]):
            dh = dh + part[:, at]
            now = dh if live is None else np.where(live, dh, 0)
            dc = now * (1 - z) * (1 - c * c)
            gate = np.concatenate([now * (before - c) * z * (1 - z), dc * hn * r * (1 - r), dc * r], 1)
            du += before.T @ gate
            dgx[:, at] = np.concatenate([gate[:, : 2 * h], dc], 1)
            back = gate @ u.T + now * z
            dh = back if live is None else np.where(live, back, dh)
        g[f"u{k}"], g[f"bx{k}"] = du, dgx.sum((0, 1))
        flat = np.zeros((len(x), 3 * h), np.float32)
        np.add.at(flat, ids.ravel(), dgx.reshape(-1, 3 * h))
        g[f"wx{k}"] = x.T @ flat
        dx += flat @ m[f"wx{k}"].T
    g["word"] = np.zeros_like(m["word"])
    np.add.at(g["word"], w.words, dx[:, :SIZE] * w.live[:, None])
    g["gram"] = np.zeros_like(m["gram"])
    each = dx[:, SIZE : 2 * SIZE] / w.per
    for some, at, grams in w.grams:
        np.add.at(g["gram"], grams, np.repeat(each[some], np.diff(np.r_[at, len(grams)]), 0))
    return g


def best_windows(score: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The index of the highest-scoring window of each text that has one."""
    order = np.lexsort((score, text))
    last = np.flatnonzero(np.r_[text[order][1:] != text[order][:-1], True])[: n if len(order) else 0]
    return order[last]


def evidence(raw: list[bytes], y: np.ndarray, fold: np.ndarray, prior: float = PRIOR) -> list[dict[str, np.ndarray]]:
    """word_odds and gram_odds: the log-odds of the label for each hashed word and character gram that a text holds, shrunk by a prior of so many texts.

    One for each of FOLDS folds, from the texts of the others, and one from all: a text never sees its own label in its input.
    """
    seen = {"word": np.zeros((FOLDS, 2, 1 << WORD_BITS), np.float32), "gram": np.zeros((FOLDS, 2, 1 << GRAM_BITS), np.float32)}
    for t, label, f in zip(raw, y.astype(int), fold, strict=True):
        w = Words([t])
        seen["word"][f, label][np.unique(w.words)] += 1
        seen["gram"][f, label][np.unique(np.concatenate([g for _, _, g in w.grams] or [np.zeros(0, np.int64)]))] += 1
    p = y.mean()
    odds = lambda n: (0.5 * np.log((n[1] + prior * p) / (n[0] + prior * (1 - p)) / (p / (1 - p)))).astype(np.float32)
    without = [[f for f in range(FOLDS) if f != k] for k in range(FOLDS)] + [list(range(FOLDS))]
    return [{f"{name}_odds": odds(n[k].sum(0)) for name, n in seen.items()} for k in without]


def fit(texts: Iterable[str], labels: list[int], *, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"constant": np.array([y.mean() if len(y) else 0.0])}
    raw = [t.encode() for t in texts]
    del texts
    m, rnd = new_model(seed), np.random.default_rng(seed)
    # A part of the sample sets the probabilities and teaches nothing else, where that leaves enough of either class.
    aside = rnd.permutation(len(y)) % ASIDE == 0
    if min(y[aside].sum(), (1 - y[aside]).sum()) < 20:
        aside[:] = False
    every, y_every = raw, y
    raw, y = [t for t, a in zip(raw, aside, strict=True) if not a], y[~aside]
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        of = np.flatnonzero(y == label)
        fold[of] = rnd.permutation(len(of)) % FOLDS
    odds = evidence(raw, y, fold)
    members = [[np.flatnonzero((fold == f) & (y == label)) for label in (1, 0)] for f in range(FOLDS)]
    members = [(f, *x) for f, x in enumerate(members) if all(map(len, x))]
    if not members:  # fewer texts than folds
        members = [(FOLDS, np.flatnonzero(y == 1), np.flatnonzero(y == 0))]
    mean, var, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    rounds = max(40, -(-len(y) // BATCH)) * epochs
    for r in range(rounds):
        f, pos, neg = members[r % len(members)]
        pick = np.concatenate([rnd.choice(pos, BATCH // 2), rnd.choice(neg, BATCH // 2)])
        w = Words([raw[k] for k in pick])
        ids, size, text = w.windows()
        if not len(ids):
            continue
        w.live = (rnd.random(len(w.words)) < KEEP).astype(np.float32)
        seen = m | odds[f]
        best = best_windows(logits(seen, w, ids, size), text, len(pick))
        g = gradients(seen, w, ids[best], size[best], y[pick][text[best]], np.full(len(best), 1 / len(best), np.float32))
        step += 1
        rate = RATE * min(1, step / 20) * (1 - 0.9 * r / rounds)
        for k in m:
            mean[k] += 0.1 * (g[k] - mean[k])
            var[k] += 0.001 * (g[k] * g[k] - var[k])
            m[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    m |= odds[FOLDS]
    told = [k for k in range(len(every)) if aside[k] or not aside.any()]
    top = np.concatenate([document_logits(m, part) for part in chunks(every[k] for k in told)])
    seen = np.isfinite(top)
    m["platt"] = np.array(platt(top[seen], y_every[told][seen])) if seen.any() else np.array([1.0, 0.0])
    return m


def document_logits(m: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """The largest window's logit of each text, -inf without words."""
    out = np.full(len(texts), -np.inf)
    w = Words(texts)
    ids, size, text = w.windows()
    if len(ids):
        np.maximum.at(out, text, logits(m, w, ids, size))
    return out


def score_texts(m: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    if "constant" in m:
        return np.full(len(texts), float(m["constant"][0]))
    top = document_logits(m, texts)
    a, b = m["platt"]
    return np.where(np.isfinite(top), 1 / (1 + np.exp(-np.clip(a * np.where(np.isfinite(top), top, 0) + b, -40, 40))), 0.0)


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """A model of labels (doc_id, toxic) that has not seen held-out ids."""
    rows = labelled_texts(docs, labels, "toxic", in_fold(F.col("doc_id"), 3, 1), {1: MAX_POSITIVE, 0: MAX_NEGATIVE}, MAX_CHARS)
    release(docs.sparkSession)
    known, texts = [y for _, y in rows], iter([t for t, _ in rows])
    del rows
    model = fit(texts, known)
    trim()
    return model


def chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts, about CHUNK bytes of them at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def as_bytes(texts: pa.Array) -> Iterator[bytes]:
    return ((t.as_py() or "").encode() for t in texts)


def scored(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.concatenate([np.zeros(0), *(score_texts(model, part) for part in chunks(as_bytes(b.column(1))))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return in_small_batches(rows).mapInArrow(lean(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs (all its columns) without the documents that score threshold or more."""
    model = train(docs, labels)
    at = docs.columns.index("text")
    rows, _ = positional(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.concatenate([np.zeros(0), *(score_texts(model, part) for part in chunks(as_bytes(b.column(at))))]) < threshold
            yield b.filter(pa.array(keep))

    return in_small_batches(rows).mapInArrow(lean(run), rows.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Benchmark decontamination with a generalised suffix automaton (operator 4).

The normalised items are put into one suffix automaton over word numbers.  The words of
each document are streamed through it, tracking the longest match that ends at each word.
Where a match covers a window (`window` consecutive item words, or all words of a shorter
item) the window's words are hit.  Runs in which no item's word pair occurs cannot hold a
window and are skipped before the automaton sees them.

`clean` removes the hit spans and drops documents of which too much was hit.

The items are read in shards of at most MAX_ITEM_CHARS characters, each of which is broadcast
and is one automaton in each worker.  With more than one shard the documents are streamed
once per shard, in one chain of narrow passes: the driver and every worker hold all shards,
so the items are meant to be a benchmark's, some hundred megabytes at most.

Defined results: a null or empty text has no words and no hits; null items are ignored, an
item id that repeats counts once for all its texts, null ids are left out of the list of
items; repeated documents are judged alike; without items nothing is hit; extra columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches, lean, only, positional, table
from .hashing import kept

WINDOW = 10
MAX_ITEM_CHARS = 1 << 20
#: Blanks for bytes that are not of a word; A-Z become a-z.
NORMAL = bytes((c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if 0x41 <= c <= 0x5A else 0x20) for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Matcher:
    """A generalised suffix automaton of items (id, words) and what its windows stand for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        vocab = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.vocab, self.n = vocab, len(vocab)
        texts = [(i, [vocab[w] for w in ws]) for i, ws in items if ws]
        self.least = min((min(window, len(t)) for _, t in texts), default=0)
        self.pairs = np.unique(np.array([a * (self.n + 1) + b for _, t in texts for a, b in zip(t, t[1:], strict=False)], np.int64))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, t in texts:
            last = 0
            for c in t:
                last = self._extend(last, c)
        # A window is hit when the match ends in a state that holds it: for windows of full length that is the state
        # on the suffix path with link length < window <= length; for a shorter item, the state its walk ends in.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}
        for i, t in texts:
            if len(t) < window:
                s = 0
                for c in t:
                    s = self.next[s][c]
                self.short.setdefault((s, len(t)), set()).add(i)
            else:
                for s in self._states(t):
                    self.full.setdefault(s, set()).add(i)
        self.shorts: dict[int, list[tuple[int, set[str]]]] = {}
        for (s, n), ids in self.short.items():
            self.shorts.setdefault(s, []).append((n, ids))

    def _extend(self, p: int, c: int) -> int:
        """Appends c to the item whose prefix ends in state p."""
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[p]:
            q = nxt[p][c]
            return q if length[q] == length[p] + 1 else self._split(p, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def stream(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, longest match) after each word."""
        nxt, link, length, s, n = self.next, self.link, self.len, 0, 0
        for c in ids:
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s, n = nxt[s][c], n + 1
            yield s, n

    def _window_state(self, s: int) -> int:
        while self.len[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def _states(self, t: list[int]) -> Iterator[int]:
        for s, n in self.stream(t):
            if n >= self.window:
                yield self._window_state(s)

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal stretches of words whose neighbours are pairs of some item, long enough for a window."""
        if not self.least or len(ids) < self.least:
            return
        if self.least == 1:
            ok = np.flatnonzero(ids < self.n)
            if len(ok):
                cut = np.flatnonzero(np.diff(ok) > 1)
                yield from zip(ok[np.r_[0, cut + 1]].tolist(), (ok[np.r_[cut, len(ok) - 1]] + 1).tolist(), strict=True)
            return
        key = ids[:-1] * (self.n + 1) + ids[1:]
        at = np.searchsorted(self.pairs, key)
        ok = self.pairs[np.minimum(at, len(self.pairs) - 1)] == key if len(self.pairs) else np.zeros(len(key), bool)
        edge = np.flatnonzero(np.diff(np.r_[False, ok, False].view(np.int8)))
        starts, ends = edge[::2], edge[1::2] + 1  # words starts..ends-1
        long = ends - starts >= self.least
        yield from zip(starts[long].tolist(), ends[long].tolist(), strict=True)

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged spans of hit words, ids of the items whose windows occur)."""
        if not self.least:
            return [], set()
        get, spans, found = self.vocab.get, [], set()
        ids = np.fromiter((get(w, self.n) for w in ws), np.int64, len(ws))
        for a, b in self.runs(ids):
            for k, (s, n) in enumerate(self.stream(ids[a:b].tolist()), a + 1):
                if n >= self.window:
                    found |= self.full.get(self._window_state(s), set())
                    spans.append((k - self.window, k))
                if self.shorts:
                    u, m = s, n
                    while u > 0:
                        for size, items in self.shorts.get(u, ()):
                            if size <= m:
                                found |= items
                                spans.append((k - size, k))
                        u = self.link[u]
                        m = self.len[u]
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_shards(items: DataFrame, max_chars: int = MAX_ITEM_CHARS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items (item_id, text) in lists of at most max_chars characters of text each (or one item)."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), "text").where("text IS NOT NULL").toLocalIterator():
        if held and size + len(r.text) > max_chars:
            yield held
            held, size = [], 0
        held.append((r.i, words(r.text)))
        size += len(r.text)
    if held:
        yield held


def _passes(rows: DataFrame, at: int, items: DataFrame, window: int, max_item_chars: int) -> DataFrame:
    """row (a struct of all columns of rows), spans and items; column `at` is the text.  One narrow pass for each shard of the items: nothing is shuffled.

    A shard is broadcast, and its automaton is built once in each worker.
    """
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    out = rows.select(F.struct("*").alias("row"), F.expr("cast(array() AS array<struct<a:int,b:int>>)").alias("spans"), F.expr("cast(array() AS array<string>)").alias("items"))

    out = in_small_batches(out)

    def scan(df: DataFrame, shard: list[tuple[str, list[bytes]]]) -> DataFrame:
        sent, name = df.sparkSession.sparkContext.broadcast(shard), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = kept()
            if held.get("matcher", (None,))[0] != name:
                held["matcher"] = (name, Matcher(sent.value, window))
            m = held["matcher"][1]
            for b in batches:
                spans, found = [], []
                for t, s0, i0 in zip(b.column(0).field(at), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    s, i = m.hits(words(t.as_py()))
                    spans.append([{"a": x, "b": y} for x, y in merged(s + [(z["a"], z["b"]) for z in s0])])
                    found.append(sorted({x for x in i if x is not None}.union(i0)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))], names=["row", "spans", "items"])

        return df.mapInArrow(lean(run, holds="matcher"), df.schema)

    for shard in item_shards(items, max_item_chars):
        out = scan(out, shard)
    return out


def find_hits(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """doc_id, text, spans (array of struct a, b: words a to b - 1 are hit), items (sorted ids) of every row of docs (doc_id, text)."""
    return _passes(only(docs, "doc_id", "text"), 1, items, window, max_item_chars).select("row.doc_id", "row.text", "spans", "items")


def digest(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    hits = find_hits(docs, items, window=window, max_item_chars=max_item_chars)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(words(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), b.column(3)], ["doc_id", "n_words", "spans", "items"])

    hits = hits.mapInArrow(lean(count), "doc_id long, n_words long, spans array<struct<a:int,b:int>>, items array<string>")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["b"] - s["a"]))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them; what is left keeps its bytes."""
    raw = text.encode()
    plain, ends, at = raw.translate(NORMAL), [], 0
    for w in plain.split():
        at = plain.index(w, at)
        ends.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : ends[a][0]])
        at = ends[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def clean(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """docs (all its columns) without the hit spans of min_span words or more; documents of which more than
    max_coverage of the words is hit are dropped.  n_chars, where there is one, follows the text."""
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    rows, _ = positional(docs)
    places = rows.columns
    found = _passes(rows, at, items, window, max_item_chars)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, texts, spanned = [], b.column(0).field(at).to_pylist(), b.column(1).to_pylist()
            for k, s in enumerate(spanned):
                spans = [(x["a"], x["b"]) for x in s if x["b"] - x["a"] >= min_span]
                n = sum(y - x for x, y in spans)
                if not n or n <= max_coverage * len(words(texts[k])):
                    keep.append(k)
                    texts[k] = without(texts[k], spans) if n else texts[k]
            cols = [c.take(pa.array(keep, pa.int64())) for c in b.column(0).flatten()]
            cols[at] = pa.array([texts[k] for k in keep], pa.string())
            if size is not None:
                old = cols[size].to_pylist()
                cols[size] = pa.array([len(texts[k]) if spanned[k] else o for k, o in zip(keep, old, strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names=places)

    return found.mapInArrow(lean(run), rows.schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS w
  FROM b, LATERAL (SELECT unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT m FROM win),
dw AS (
  SELECT doc_id, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS w
  FROM d, sizes, LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS i) WHERE len(ws) >= m
), hit AS (SELECT doc_id, item_id, i, dw.m FROM dw JOIN win ON dw.w = win.w AND dw.m = win.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

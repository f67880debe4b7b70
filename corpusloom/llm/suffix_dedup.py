"""Removal of substrings that earlier documents hold (operator 1), by a sparse suffix array.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a
smaller doc_id.  Every window of LENGTH bytes has an anchor: the least hash among its
KGRAM-byte strings, the leftmost if several are least; equal windows have equal anchors.
Consecutive windows with one anchor form a run.

1. Each run is dealt out by its anchor with a 64-bit hash of all its bytes and a 31-bit hash
   of another kind (modulo a prime) that verifies it.  Runs that a smaller document holds
   whole are decided by these: the inside of any copy.  Copies within a stretch of the
   corpus are decided before the shuffle.
2. Runs whose anchor other documents hold with other bytes (the ends of copies) are
   decided on the bytes themselves: their window starts are suffixes that are sorted by
   mergesort.  Two suffixes are compared by polynomial prefix hashes: binary search finds
   their common extension in a logarithmic number of steps, and equal neighbours are
   verified byte by byte.
   Windows of very frequent anchors are dealt out one by one by their own hashes, the
   copies in a stretch combined, so that no anchor's runs meet in one task.

Defined results: a null text counts as an empty one; null doc_ids rank after all others
and never precede each other; rows with one doc_id are parts of one document, which
doesn't precede itself; texts shorter than LENGTH keep all bytes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, only, release, small_batches, table
from .hashing import BASE, BASE_INV, U, mix64, powers, prefix_hashes, prime_hashes

LENGTH, KGRAM = 50, 20
#: Bytes handled at once; runs are cut after so many windows.
STRETCH, PIECE, LONGEST = 1 << 22, 1 << 21, 64
#: Runs of a bucket in step 1; suffixes of a bucket in step 2; runs of an anchor from which its windows go one by one.
BUCKET, SUFFIXES, FREQUENT = 1 << 19, 1 << 19, 2000
NO_ID = np.iinfo(np.int64).max
#: Bytes of texts that meet, as one part, what is found in them.
PART = 1 << 23


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, hash of all bytes, verifying hash, first window, number of windows) of the runs of pieces that end at `ends`."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none
    p = prefix_hashes(data)
    inv = powers(BASE_INV, len(p))
    least = mix64((p[k:] - p[:-k]) * inv[: len(data) - k + 1])
    width, span = length - k + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    piece = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + length <= ends[np.minimum(piece, len(ends) - 1)]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    last = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True])
    count = last - first + 1
    if len(count) and count.max() > LONGEST:
        parts = -(-count // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, last = np.repeat(first, parts) + step * LONGEST, np.repeat(last, parts)
        count = np.minimum(last - first + 1, LONGEST)
    whole = mix64((p[first + count + length - 1] - p[first]) * inv[first] + count.astype(np.uint64) * U(BASE))
    return least[first], whole, prime_hashes(data, first, first + count + length - 1), first, count


def compare(data: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """-1, 0 or 1: the order of the suffixes at a and b by their first `limit` bytes."""
    up = powers(BASE, len(p))

    def same(i: np.ndarray, j: np.ndarray, m) -> np.ndarray:
        return (p[i + m] - p[i]) * up[j] == (p[j + m] - p[j]) * up[i]

    out = np.zeros(len(a), np.int8)
    open_ = np.flatnonzero(~same(a, b, limit))
    i, j = a[open_], b[open_]
    lo, hi = np.zeros(len(i), np.int64), np.full(len(i), limit - 1)
    while (lo < hi).any():  # the longest common extension
        mid = (lo + hi + 1) >> 1
        ok = same(i, j, mid)
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
    out[open_] = np.where(data[i + lo] < data[j + lo], -1, 1)
    return out


def suffix_sort(data: np.ndarray, p: np.ndarray, starts: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
    """Order of starts by key, then by the suffixes' first `limit` bytes; stable.

    The leading 8 bytes are sorted as numbers; what they leave equal is merged bottom-up,
    all runs of a level at once: each suffix finds its rank in the sibling run by binary search.
    """
    lead = np.zeros(len(data), np.uint64)
    for b in range(8):
        lead[: len(data) - b] |= data[b:].astype(np.uint64) << U(56 - 8 * b)
    lead = lead[starts]
    order = np.lexsort((lead, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (lead[order][1:] != lead[order][:-1])] if len(order) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, len(order)])
    many = np.repeat(size > 1, size)
    at = np.flatnonzero(many)  # places in groups of two or more
    base, size = np.repeat(head, size)[at], np.repeat(size, size)[at]
    r = 1
    while len(at) and r < size.max():
        live = size > r
        at, base, size = at[live], base[live], size[live]
        q = at - base
        run = q // r
        sib = (run ^ 1) * r
        lo, hi = np.zeros(len(at), np.int64), np.clip(np.minimum(sib + r, size) - sib, 0, None)
        me = starts[order[at]]
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            other = starts[order[base[todo] + sib[todo] + mid]]
            c = compare(data, p, other, me[todo], limit)
            right = np.where(run[todo] & 1, c <= 0, c < 0)
            lo[todo], hi[todo] = np.where(right, mid + 1, lo[todo]), np.where(right, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        place = base + (run & ~1) * r + (q - run * r) + lo
        moved = order[at]
        order[place] = moved
        r *= 2
    return order


def repeated(data: np.ndarray, starts: np.ndarray, key: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each start, whether an equal string with its key starts in a smaller document."""
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    p = prefix_hashes(data)
    order = suffix_sort(data, p, starts, key, length)
    a, b = starts[order[:-1]], starts[order[1:]]
    equal = key[order[1:]] == key[order[:-1]]
    equal[equal] = compare(data, p, a[equal], b[equal], length) == 0
    at = np.flatnonzero(equal)
    for lo in range(0, len(at), 1 << 16):  # the bytes decide
        part = at[lo : lo + (1 << 16)]
        offs = np.arange(length)
        equal[part] = (data[a[part][:, None] + offs] == data[b[part][:, None] + offs]).all(1)
    head = np.flatnonzero(np.r_[True, ~equal])
    least = np.minimum.reduceat(doc[order], head)
    out[order] = doc[order] > np.repeat(least, np.diff(np.r_[head, len(order)]))
    return out


class _Rows:
    """Values of many kinds of the same rows, packed as bytes: a plane for each byte of a kind, so that the upper bytes of small numbers compress."""

    def __init__(self, **kinds: str):
        self.kinds = kinds

    def pack(self, **cols: np.ndarray) -> bytes:
        n = len(next(iter(cols.values())))
        return np.uint64(n).tobytes() + b"".join(np.ascontiguousarray(np.ascontiguousarray(cols[c], dtype=k).view(np.uint8).reshape(n, -1).T).tobytes() if n else b"" for c, k in self.kinds.items())

    def unpack(self, raw: memoryview) -> tuple[dict[str, np.ndarray], int]:
        n, at, out = int(np.frombuffer(raw, np.uint64, 1)[0]), 8, {}
        for c, k in self.kinds.items():
            size = np.dtype(k).itemsize
            out[c] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(k).reshape(n)
            at += n * size
        return out, at

    def concat(self, parts: Iterable[memoryview]) -> dict[str, np.ndarray]:
        got = [self.unpack(x)[0] for x in parts]
        return {c: np.concatenate([g[c] for g in got] or [np.zeros(0, k)]) for c, k in self.kinds.items()}


DOCS = _Rows(doc="i8", rid="i8", n="u4")
RUNS = _Rows(anchor="u4", whole="u8", check="u4", low="u2", high="u2", count="u1")
FOUND = _Rows(first="u4", count="u4")
ASKED = _Rows(group="u8", first="u4", count="u1", alone="u1")
TEXTS = _Rows(group="u8", doc="i8", rid="i8", first="u4", size="u2")


def _differ(x: np.ndarray) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    return x[1:] != x[:-1]


def _by_part(doc: np.ndarray, rid: np.ndarray, cols: dict[str, np.ndarray], rows: _Rows, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, its rows' values, packed): a row's part follows from doc and rid (see `_repeated_spans`), so what is shuffled is one value a bucket and part, however many rows there are."""
    if not len(doc):
        return
    part = (doc ^ rid) % parts
    order = np.lexsort((cols["first"], rid, doc, part))
    doc, rid, part = doc[order], rid[order], part[order]
    new = np.r_[True, _differ(doc) | _differ(rid)]
    cut = np.flatnonzero(np.r_[True, _differ(part)])
    for a, z in zip(cut, np.r_[cut[1:], len(order)], strict=True):
        head = np.flatnonzero(new[a:z]) + a
        yield int(part[a]), DOCS.pack(doc=doc[head], rid=rid[head], n=np.diff(np.r_[head, z])) + rows.pack(**{c: v[order[a:z]] for c, v in cols.items()})


def _of_rows(blobs: pa.ChunkedArray, rows: _Rows) -> dict[tuple[int, int], dict[str, np.ndarray]]:
    """(doc, rid) -> the row's values of all that `_by_part` has packed for a part."""
    docs, values = [], []
    for x in blobs:
        raw = memoryview(x.as_buffer())
        d, at = DOCS.unpack(raw)
        docs.append(d)
        values.append(rows.unpack(raw[at:])[0])
    if not docs:
        return {}
    d = {c: np.concatenate([x[c] for x in docs]) for c in DOCS.kinds}
    v = {c: np.concatenate([x[c] for x in values]) for c in rows.kinds}
    n = d["n"].astype(np.int64)
    doc, rid = np.repeat(d["doc"], n), np.repeat(d["rid"], n)
    order = np.lexsort((rid, doc))
    doc, rid, v = doc[order], rid[order], {c: x[order] for c, x in v.items()}
    cut = np.flatnonzero(np.r_[True, _differ(doc) | _differ(rid)])
    keys = zip(doc[cut].tolist(), rid[cut].tolist(), strict=True)
    return {k: {c: x[a:z] for c, x in v.items()} for k, a, z in zip(keys, cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True)}


def _packed(kinds: Iterable[tuple[int, Iterator[tuple[int, bytes]]]]) -> pa.Table:
    """part, kind, data of what `_by_part` gives for each kind."""
    rows = [(part, kind, blob) for kind, blobs in kinds for part, blob in blobs]
    return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("part", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())))})


PACKED = "part int, kind byte, data binary"


def _met(rows: DataFrame, packed: DataFrame, run, schema: str) -> DataFrame:
    """run(texts, packed): the rows of a part (`part`, rid, doc_id, text) and what has been packed for them."""
    return rows.groupBy("part").cogroup(packed.groupBy("part")).applyInArrow(run, schema)


def _stretches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows (rid, doc, bytes, ...) of batches in lists of about `size` bytes."""
    held, total = [], 0
    for b in batches:
        cols = [b.column(k).to_pylist() if k < 2 else b.column(k) for k in range(b.num_columns)]
        for rid, doc, text, *more in zip(*cols, strict=True):
            raw = (text.as_py() or "").encode()
            held.append((rid, NO_ID if doc is None else doc, raw, *more))
            total += len(raw)
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def _pieces(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, ends, text, offset): texts cut into overlapping pieces, so that each window is in one of them."""
    parts, text, offset = [], [], []
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            parts.append(t[at : at + PIECE + length - 1])
            text.append(k)
            offset.append(at)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts]), np.array(text, np.int64), np.array(offset, np.int64)


def _deal(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """Step 1, dealt: bucket, kind 0 (runs to be compared) or 1 (windows decided already), data."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _stretches(batches, STRETCH):
            data, ends, text, offset = _pieces([h[2] for h in held], length)
            anchor, whole, check, first, count = runs(data, ends, length)
            piece = np.searchsorted(ends, first, side="right")
            begin = ends - np.diff(np.r_[0, ends])
            row, at = text[piece], first - begin[piece] + offset[piece]
            rid, doc = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
            order = np.lexsort((doc[row], check, whole, anchor))
            new = np.r_[True, _differ(anchor[order]) | _differ(whole[order]) | _differ(check[order])][: len(order)]
            least = doc[row][order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else np.zeros(0, np.int64)
            known = np.zeros(len(order), bool)
            known[order] = doc[row][order] > least
            ids, kinds, blobs = [], [], []
            if known.any():
                r = row[known]
                by = np.argsort(r, kind="stable")
                u, n = np.unique(r, return_counts=True)
                ids.append(int(rid[0] % buckets))
                kinds.append(1)
                blobs.append(DOCS.pack(doc=doc[u], rid=rid[u], n=n) + FOUND.pack(first=at[known][by], count=count[known][by]))
            bucket = (anchor % U(buckets)).astype(np.int64)
            keep = np.flatnonzero(~known)
            keep = keep[np.lexsort((row[keep], bucket[keep]))]
            cut = np.flatnonzero(np.diff(bucket[keep], prepend=-1, append=-1))
            for a, z in zip(cut, cut[1:], strict=False):
                k = keep[a:z]
                u, n = np.unique(row[k], return_counts=True)
                ids.append(int(bucket[k[0]]))
                kinds.append(0)
                blobs.append(DOCS.pack(doc=doc[u], rid=rid[u], n=n) + RUNS.pack(anchor=(anchor[k] // U(buckets)).astype(np.uint32), whole=whole[k], check=check[k], low=at[k] & 0xFFFF, high=at[k] >> 16, count=count[k]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.int8()), pa.array(blobs, pa.binary())], ["bucket", "kind", "data"])

    return rows.mapInArrow(lean(run), "bucket int, kind byte, data binary")


def _decide(frequent: int, dests: int):
    """Step 1 on a bucket: packed by part, kind 0 (windows that go) or 1 (runs to be decided on their bytes)."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        parts: dict[int, list] = {0: [], 1: []}
        for kind, x in zip(group.column("kind").to_pylist(), group.column("data"), strict=True):
            raw = memoryview(x.as_buffer())
            d, at = DOCS.unpack(raw)
            e, _ = (FOUND if kind else RUNS).unpack(raw[at:])
            parts[kind].append((np.repeat(d["doc"], d["n"]), np.repeat(d["rid"], d["n"]), e))
        known = parts[1]
        of, rid = (np.concatenate([x[k] for x in known] or [np.zeros(0, np.int64)]) for k in (0, 1))
        first = np.concatenate([e["first"] for *_, e in known] or [np.zeros(0, np.uint32)]).astype(np.int64)
        count = np.concatenate([e["count"] for *_, e in known] or [np.zeros(0, np.uint32)]).astype(np.int64)
        asked: Iterator[tuple[int, bytes]] = iter(())
        if parts[0]:
            doc, r = (np.concatenate([p[k] for p in parts[0]]) for k in (0, 1))
            e = {c: np.concatenate([p[2][c] for p in parts[0]]) for c in RUNS.kinds}
            order = np.lexsort((doc, e["check"], e["whole"], e["anchor"]))
            doc, r, anchor, n = doc[order], r[order], e["anchor"][order], e["count"][order].astype(np.int64)
            at = e["low"][order].astype(np.int64) | e["high"][order].astype(np.int64) << 16
            head = np.r_[True, _differ(anchor)]
            new = head | np.r_[True, _differ(e["whole"][order]) | _differ(e["check"][order])]
            where = np.arange(len(doc))
            goes = doc > doc[np.maximum.accumulate(np.where(new, where, 0))]
            of, rid, first, count = np.r_[of, doc[goes]], np.r_[rid, r[goes]], np.r_[first, at[goes]], np.r_[count, n[goes]]
            cut = np.flatnonzero(head)
            size = np.diff(np.r_[cut, len(doc)])
            kinds = np.add.reduceat(new.astype(np.int64), cut)
            open_ = (kinds > 1) & (np.minimum.reduceat(doc, cut) < np.maximum.reduceat(doc, cut))
            left = np.repeat(open_, size) & ~goes
            alone = np.repeat(kinds > frequent, size)
            number = (anchor.astype(np.uint64) << U(32)) | U(bucket)
            asked = _by_part(doc[left], r[left], {"group": number[left], "first": at[left], "count": n[left], "alone": alone[left]}, ASKED, dests)
        return _packed([(0, _by_part(of, rid, {"first": first, "count": count}, FOUND, dests)), (1, asked)])

    return run


def _cut_out(buckets: int, length: int):
    """Step 2, dealt: of a part's rows the bytes of the asked runs, as bucket, kind, data like step 1."""

    def run(texts: pa.Table, packed: pa.Table) -> pa.Table:
        asks, out = _of_rows(packed.column("data"), ASKED), []
        for held in _stretches(texts.select(["rid", "doc_id", "text"]).to_batches(), STRETCH):
            recs: list[tuple] = []
            ones: dict[bytes, list[tuple[int, int, int]]] = {}
            for rid, doc, raw in held:
                a = asks.get((doc, rid))
                if a is None:
                    continue
                for g, f, c, alone in zip(*(a[k].tolist() for k in ASKED.kinds), strict=True):
                    if alone:
                        for w in range(f, f + c):
                            ones.setdefault(raw[w : w + length], []).append((doc, rid, w))
                    else:
                        recs.append((g, doc, rid, f, raw[f : f + c + length - 1]))
            known: list[tuple[int, int, int]] = []
            for w, places in ones.items():
                least = min(places)[0]
                known += [(doc, rid, at) for doc, rid, at in places if doc > least]
                g = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                recs += [(g, doc, rid, at, w) for doc, rid, at in places if doc == least]
            parts: dict[int, list] = {}
            for x in recs:
                parts.setdefault((x[0] * BASE >> 20) % buckets, []).append(x)
            ids, kinds, blobs = [], [], []
            for b, xs in parts.items():
                ids.append(b)
                kinds.append(0)
                blobs.append(TEXTS.pack(group=np.array([x[0] for x in xs], np.uint64), doc=np.array([x[1] for x in xs]), rid=np.array([x[2] for x in xs]), first=np.array([x[3] for x in xs]), size=np.array([len(x[4]) for x in xs])) + b"".join(x[4] for x in xs))
            if known:
                doc, r, at = np.array(sorted(known), np.int64).T
                new = np.flatnonzero(np.r_[True, _differ(doc) | _differ(r)])
                ids.append(int(r[0] % buckets))
                kinds.append(1)
                blobs.append(DOCS.pack(doc=doc[new], rid=r[new], n=np.diff(np.r_[new, len(r)])) + FOUND.pack(first=at, count=np.ones(len(r))))
            out.append(pa.table([pa.array(ids, pa.int32()), pa.array(kinds, pa.int8()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "data"]))
        return pa.concat_tables(out) if out else pa.table({"bucket": pa.array([], pa.int32()), "kind": pa.array([], pa.int8()), "data": pa.array([], pa.binary())})

    return run


def _sort_bucket(length: int, dests: int):
    """Step 2 on a bucket: the windows that go, packed by part."""

    def run(group: pa.Table) -> pa.Table:
        (doc, rid, first, count), heads, bodies = ([np.zeros(0, np.int64)] for _ in range(4)), [], []
        for kind, x in zip(group.column("kind").to_pylist(), group.column("data"), strict=True):
            raw = memoryview(x.as_buffer())
            if kind:
                d, at = DOCS.unpack(raw)
                e, _ = FOUND.unpack(raw[at:])
                doc.append(np.repeat(d["doc"], d["n"]))
                rid.append(np.repeat(d["rid"], d["n"]))
                first.append(e["first"].astype(np.int64))
                count.append(e["count"].astype(np.int64))
            else:
                t, at = TEXTS.unpack(raw)
                heads.append(t)
                bodies.append(np.frombuffer(raw, np.uint8, offset=at))
        if heads:
            t = {c: np.concatenate([h[c] for h in heads]) for c in TEXTS.kinds}
            data = np.concatenate([*bodies, np.zeros(8, np.uint8)])
            size = t["size"].astype(np.int64)
            n = size - length + 1
            rec = np.repeat(np.arange(len(n)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = (np.cumsum(size) - size)[rec] + step
            goes = repeated(data, starts, t["group"][rec], t["doc"][rec], length)
            doc.append(t["doc"][rec[goes]])
            rid.append(t["rid"][rec[goes]])
            first.append(t["first"].astype(np.int64)[rec[goes]] + step[goes])
            count.append(np.ones(int(goes.sum()), np.int64))
        doc, rid, first, count = (np.concatenate(x) for x in (doc, rid, first, count))
        return _packed([(0, _by_part(doc, rid, {"first": first, "count": count}, FOUND, dests))])

    return run


def spans_of(first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the windows cover."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(first, kind="stable")
    a = first[order].astype(np.int64)
    z = np.maximum.accumulate(a + count[order] + length - 1)
    new = np.r_[True, a[1:] > z[:-1]]
    at = np.flatnonzero(new)
    return a[at], z[np.r_[at[1:] - 1, len(z) - 1]]


def _spans(docs: DataFrame, length: int, schema: str, make) -> DataFrame:
    """make(bytes, starts, ends) of every row of docs (doc_id, text), beside its doc_id; starts and ends are those of the maximal runs that go."""
    with small_batches(docs.sparkSession):
        return _repeated_spans(docs, length, schema, make)


def _repeated_spans(docs: DataFrame, length: int, schema: str, make) -> DataFrame:
    # A row is known by its doc_id and a hash of its text: rows of different documents are never taken for each other.
    rows = only(docs, "doc_id", "text").select(F.xxhash64("text").alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    buckets, dests = max(8, -(-total // (16 * BUCKET))), max(8, -(-total // PART))
    decided = materialize(_deal(rows, buckets, length).groupBy("bucket").applyInArrow(_decide(FREQUENT, dests), PACKED), "runs")
    n = decided.where("kind = 1").agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    parts = max(8, -(-int(n) * 17 // 14 // SUFFIXES))
    release(docs.sparkSession)
    placed = rows.withColumn("part", F.pmod(F.coalesce("doc_id", F.lit(NO_ID)).bitwiseXOR(F.col("rid")), F.lit(dests)).cast("int"))
    ends = _met(placed, decided.where("kind = 1"), _cut_out(parts, length), "bucket int, kind byte, data binary")
    ends = materialize(ends.groupBy("bucket").applyInArrow(_sort_bucket(length, dests), PACKED), "run-ends")
    return _met(placed, decided.where("kind = 0").union(ends), _apply(length, schema, make), schema)


def _apply(length: int, schema: str, make):
    """A part's rows and the windows that go: doc_id and make(bytes, starts, ends) of each row."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*((c, kinds[t]) for c, t in map(str.split, schema.split(", "))), strict=True)
    none = np.zeros(0, np.int64)

    def run(texts: pa.Table, packed: pa.Table) -> pa.Table:
        found, out = _of_rows(packed.column("data"), FOUND), []
        for doc, rid, text in zip(texts.column("doc_id").to_pylist(), texts.column("rid").to_pylist(), texts.column("text"), strict=True):
            w = found.get((NO_ID if doc is None else doc, rid), {"first": none, "count": none})
            out.append((doc, *make((text.as_py() or "").encode(), *spans_of(w["first"], w["count"], length))))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return run


def kept_bytes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    cuts = [0, *(x for s in zip(starts.tolist(), ends.tolist(), strict=True) for x in s), len(raw)]
    return b"".join(raw[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (binary: a cut may fall within a character) of every row of docs."""
    return _spans(docs, length, "doc_id long, kept binary", lambda raw, a, z: (kept_bytes(raw, a, z),))


def digest(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    return _spans(docs, length, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda raw, a, z: (len(raw), int((z - a).sum()), len(a), hashlib.sha256(kept_bytes(raw, a, z)).hexdigest()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
l AS (SELECT doc_id, unnest([struct_pack(i := i, s := md5_number_lower(substr(h, 2 * i + 1, 100))) for i in range(0, length(h) // 2 - 49)]) AS x FROM d WHERE length(h) >= 100),
w AS (SELECT doc_id, x.i AS i, x.s AS s FROM l),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
k AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM g),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM k) GROUP BY doc_id, grp),
cuts AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM sp),
kept AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS h,
         sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans
  FROM d JOIN cuts USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

"""Personal data: exact patterns, and a conditional random field for what they miss (operator 6).

The patterns (`base_spans`) give e-mail addresses, IPv4 addresses, card numbers and
international phone numbers.  A linear-chain field over word-shape features, trained on the
small labelled table below, then reads every stretch of text around digits and at-signs,
and is decoded by Viterbi for many stretches at once in numpy.  Its spans are added where
they touch no pattern's span and pass an exact check (digit counts, Luhn, a domain); the
patterns' spans always stay.

A token can only start or continue personal data if a digit, an at-sign or a spelt-out "at"
is near, so only such zones, with CONTEXT tokens on either side, are read: every text is
searched whole for them.

Defined results: a null text counts as an empty one; repeated rows are treated alike; extra
columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_small_batches, lean, only, table

#: The patterns' kinds, and what only the field finds.
KINDS, FOUND = ("email", "ip", "card", "phone"), ("secret",)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Where the three numeric patterns can match: one alphabet, from a digit or a plus on.
_NUMERIC = re.compile(r"[+0-9][0-9 .()+-]*")
# A digit run is taken whole or not at all, so possessive runs match as plain ones do, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octet(s: str) -> bool:
    """Whether a run of digits, however long, is a number up to 255."""
    s = s.lstrip("0")
    return len(s) < 3 or (len(s) == 3 and s <= "255")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(t: str) -> Iterator[Span]:
    end, at = 0, t.find("@")
    while at >= 0:
        lo = at
        while lo > end and t[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(t, at + 1) if lo < at else None
        if m:
            end = m.end()
            yield lo, end, "email"
        at = t.find("@", max(at + 1, end))


def base_spans(t: str) -> list[Span]:
    """The patterns' spans, by start, then kind."""
    out = list(emails(t)) if "@" in t else []
    for zone in _NUMERIC.finditer(t):
        lo, hi = zone.span()
        if hi - lo < 7:  # no pattern is shorter
            continue
        out += [(*m.span(), "ip") for m in _IP.finditer(t, lo, hi) if all(octet(x) for x in m[0].split("."))]
        for m in _CARD.finditer(t, lo, hi):
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        out += [(*m.span(), "phone") for m in _PHONE.finditer(t, lo, hi) if 10 <= len(digits_of(m[0])) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], (*KINDS, *FOUND).index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


#: The labelled table: personal data stand in braces after their kind.
TABLE = (
    "please call {phone:(212) 555-0147} before noon",
    "Call {phone:212-555-0199} or write to {email:jane at mail dot org} today.",
    "tel {phone:030 555 0123} and fax {phone:030 555 0124}",
    "my number is {phone:555-010-7788}, ask for Tom",
    "phone: {phone:(044) 555 01 02}",
    "reach us at {phone:212.555.0111} until 18:30",
    "Mobile {phone:0170 5550123} Berlin",
    "office {phone:+49 30 5550123}, room 204",
    "dial {phone:+1 (212) 555-0147} now",
    "mail {email:tom.lee [at] example [dot] com} please",
    "write to {email:info (at) example.org} for help",
    "contact {email:a.smith at example dot net} or come by",
    "or mail {email:ann at sample dot org}, order 778 of 1999",
    "ask {email:meg at corner dot com} or ring twice",
    "just mail {email:joe at shop dot net} first",
    "the address {email:x.y+z@mail7.example.com} works",
    "pay with {card:4111 1111 1111 1111} at the desk",
    "card {card:4222222222222} expires 08/27",
    "Card no. {card:5500-0000-0000-0004}, thanks",
    "server {ip:10.0.0.12} is down since 2021",
    "from {ip:192.168.1.77} to {ip:172.16.0.9} in 20 ms",
    "host {ip:8.8.8.8} answered 3 of 4 packets",
    "card {card:5100293847561024} was declined",
    "we saw {card:8834410927365510} there",
    "over {card:2718281828459046} and on",
    "The number {card:4929384756102930}. It failed",
    "and {card:1414213562373096} with the rest",
    'token = "{secret:3f9ac47e01d2b58c66e0f7a9914cd82b5507ea13}" in the log',
    'Token = "{secret:c0ffee19d4a27b3e8856f1029adbe47750cc6e92}".',
    "api key: {secret:sk3J9fQ2mX7pLw81TzVb64} do not share",
    'password = "{secret:hunter2zebra77lamp91}" works',
    "auth {secret:Bq7T0xYw2PzM49LkDs83} expires soon",
    "commit 7d3f9a1c22e84b6f90ab31cd55e07f18a2b4c6d8 mends it",
    "build 20190417a3f8c2d1e4b5 of the day",
    "id 550e8400e29b41d4a716446655440000 of the row",
    "part no. 4500012345678901234567 of 3",
    "account 12345678901 was closed in 2011",
    "tracking 993482 0021 7743 left the hub",
    "under the license, version 3.",
    "they met at 5 and left at 7",
    "in 1998 there were 120 of them, in 2004 only 85",
    "chapter 3.1.2 describes version 2.4.1 of it",
    "it costs 12.50 or 3,400 in total",
    "on 2020-05-17 at 14:05 the train left track 12",
    "see pages 112-118 and table 4",
    "order 20210517-0042 has 16 items of 250 g",
    "the score was 21-19, 18-21, 15-12",
    "room 12 at the end of hall 3",
    "invoice 4500012345678 of 12.03.2019",
    "we look at the dots at home",
    "item 0042 at 3 dot com boom 1999",
    "serial 9981-2210-34 part 77",
    "latitude 52.5200 longitude 13.4050",
    "population 3 645 000 in 2019",
    "the ratio was 3 to 1 or 0.75",
)
LABELS = ("O", *(f"{b}-{k}" for k in (*KINDS, *FOUND) for b in "BI"))
BITS, CONTEXT, EPOCHS, RATE, RIDGE = 13, 5, 120, 0.05, 2e-3
#: Tokens of a window and how many at its inner ends only give context; weights gathered at once, in tokens.
WINDOW, EDGE, TOKENS = 256, 32, 1 << 14
# A long run of letters and digits mixed is one token.
_TOKEN = re.compile(r"(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}|[^\W\d_]+|[0-9]+|\S")
REACH = 48
_SEED = re.compile(r"[0-9@]|[\[(]at[\])]| dot ", re.I)
_CUES = frozenset("call tel fax phone mobile dial number mail write send contact card pay server host from at dot reach address office no token key secret password auth commit build id account".split())


def tokens(t: str, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(t, lo, len(t) if hi is None else hi)]


@lru_cache(1 << 16)
def shape(w: str) -> str:
    """Digits and their number, letters' cases, or the mark itself."""
    if w.isdigit():
        return f"d{min(len(w), 20)}"
    if len(w) > 1 and not w.isalpha():
        return "mixed"
    if w[0].isalpha():
        return ("a" if w.islower() else "A" if w.isupper() else "Aa") + ("+" if len(w) > 3 else "")
    return w


@lru_cache(1 << 16)
def _hashed(pp: str, p: str, s: str, n: str, nn: str, glued: int, cue: str, near: str) -> tuple[int, ...]:
    """The features of a token of shape s between others.  Few of these differ in a text, so they are kept, up to a number."""
    names = ("1", f"s{s}", f"p{p}", f"n{n}", f"pp{pp}|{p}", f"nn{n}|{nn}", f"ps{p}|{s}", f"sn{s}|{n}", f"psn{p}|{s}|{n}", f"g{glued}{s}", f"c{cue}", f"k{near}|{s}")
    return tuple(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") >> (32 - BITS) for x in names)


def token_features(t: str, spans: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """Hashed features of each token: shapes in a window, adjacency, and cue words."""
    w = [t[a:z] for a, z in spans]
    s = ["^", "^", *map(shape, w), "$", "$"]
    cue = [x if x in _CUES else "" for x in map(str.lower, w)]
    glued = [a[1] == b[0] for a, b in zip(spans, spans[1:])]  # a token and the next
    glued = [2 * x + y for x, y in zip([False, *glued], [*glued, False])]
    near = ["", *(c or b or a for a, b, c in zip(["", "", *cue], ["", *cue], cue))]
    return [_hashed(s[k], s[k + 1], s[k + 2], s[k + 3], s[k + 4], glued[k], cue[k], near[k]) for k in range(len(spans))]


N_FEATURES = 12


def padded(rows: list[list[tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    """(features [n, T, N_FEATURES], lengths [n])."""
    size = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), int(size.max(initial=1)), N_FEATURES), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, size


def emissions(rows: list[list[tuple[int, ...]]], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(emissions [n, T, L], lengths [n]): weights are summed once for each kind of token."""
    kinds: dict[tuple[int, ...], int] = {}
    size = np.array([len(r) for r in rows], np.int64)
    at = np.zeros((len(rows), int(size.max(initial=1))), np.int64)
    for k, r in enumerate(rows):
        at[k, : len(r)] = [kinds.setdefault(x, len(kinds)) for x in r]
    return w[np.array(list(kinds))].sum(1)[at], size


def chain(e: np.ndarray, size: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals [n, T, L], pairwise expectations [L, L] and log partitions, of emissions e [n, T, L]."""
    n, steps, k = e.shape
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, steps):
        x = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
        alpha[:, t] = np.where((t < size)[:, None], x, alpha[:, t - 1])
    z = np.logaddexp.reduce(alpha[:, -1], 1)
    pairs = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        right = (e[:, t + 1] + beta[:, t + 1])[:, None] + trans
        live = t + 1 < size
        beta[:, t] = np.where(live[:, None], np.logaddexp.reduce(right, 2), 0)
        pairs += np.exp(alpha[live, t][:, :, None] + right[live] - z[live, None, None]).sum(0)
    mask = np.arange(steps) < size[:, None]
    return np.where(mask[:, :, None], np.exp(alpha + beta - z[:, None, None]), 0), pairs, z


def viterbi(e: np.ndarray, size: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels [n, T] of every sequence; padding keeps the last label."""
    n, steps, k = e.shape
    best, back = e[:, 0], np.tile(np.arange(k, dtype=np.int8), (n, steps, 1))
    for t in range(1, steps):
        x = best[:, :, None] + trans
        live = (t < size)[:, None]
        back[:, t] = np.where(live, x.argmax(1), np.arange(k))
        best = np.where(live, x.max(1) + e[:, t], best)
    out = np.empty((n, steps), np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


def read_table(rows: Iterable[str] = TABLE) -> tuple[list[str], list[list[Span]]]:
    """(texts, spans) of rows whose personal data stand in braces."""
    texts, marks = [], []
    for r in rows:
        t, spans = "", []
        for part in re.split(r"(\{\w+:[^}]*\})", r):
            if part.startswith("{"):
                kind, _, body = part[1:-1].partition(":")
                spans.append((len(t), len(t) + len(body), kind))
                part = body
            t += part
        texts.append(t)
        marks.append(spans)
    return texts, marks


def fit(rows: Iterable[str] = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights [2**BITS, labels], transitions) by full-batch ascent on the conditional likelihood."""
    texts, marks = read_table(rows)
    toks = [tokens(t) for t in texts]
    f, size = padded([token_features(t, s) for t, s in zip(texts, toks, strict=True)])
    k = len(LABELS)
    y = np.zeros(f.shape[:2], np.int64)
    for i, (spans, ts) in enumerate(zip(marks, toks, strict=True)):
        for a, z, kind in spans:
            for j, (b, c) in enumerate(ts):
                if a <= b and c <= z:
                    y[i, j] = LABELS.index(("B-" if b == a else "I-") + kind)
    mask = np.arange(f.shape[1]) < size[:, None]
    w, trans = np.zeros((1 << BITS, k)), np.zeros((k, k))
    seen = np.zeros((k, k))
    inner = mask[:, 1:]
    np.add.at(seen, (y[:, :-1][inner], y[:, 1:][inner]), 1)
    one = np.eye(k)[y] * mask[:, :, None]
    params, m, v = [w, trans], [np.zeros_like(w), np.zeros_like(trans)], [np.zeros_like(w), np.zeros_like(trans)]
    for r in range(1, EPOCHS + 1):
        p, pairs, _ = chain(w[f].sum(2), size, trans)
        g = np.zeros_like(w)
        np.add.at(g, f[mask], (one - p)[mask][:, None])
        for j, grad in enumerate((g / len(texts) - RIDGE * w, (seen - pairs) / len(texts) - RIDGE * trans)):
            m[j] += 0.1 * (grad - m[j])
            v[j] += 0.01 * (grad * grad - v[j])
            params[j] += RATE * (m[j] / (1 - 0.9**r)) / (np.sqrt(v[j] / (1 - 0.99**r)) + 1e-8)
    return w.astype(np.float32), trans.astype(np.float32)


def zones(t: str) -> list[list[tuple[int, int]]]:
    """Token spans of the stretches around digits and at-signs, which begin and end between words where these aren't very long."""
    out: list[list[int]] = []
    for m in _SEED.finditer(t):
        if out and m.start() - REACH <= out[-1][1]:
            out[-1][1] = min(len(t), m.end() + REACH)
        else:
            out.append([max(0, m.start() - REACH), min(len(t), m.end() + REACH)])
    for z in out:
        for _ in range(REACH):
            z[0] -= z[0] > 0 and t[z[0] - 1].isalnum()
            z[1] += z[1] < len(t) and t[z[1]].isalnum()
    return [tokens(t, a, z) for a, z in out]


def windows(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, end, from, to) of the windows of n tokens: labels of tokens `from` to `to` - 1 are taken from the window first to end - 1."""
    if n <= WINDOW:
        yield 0, n, 0, n
        return
    step = WINDOW - 2 * EDGE
    for at in range(0, n, step):
        yield max(0, at - EDGE), min(n, at + step + EDGE), at, min(n, at + step)


def acceptable(s: str, kind: str) -> bool:
    """The exact check of a span that the field proposes."""
    d = digits_of(s)
    if kind == "phone":
        return 9 <= len(d) <= 15 and not re.fullmatch(r"[0-9]+(\.[0-9]+)?", s) and s.count(" ") <= 6 and bool(re.fullmatch(r"[+0-9 ().-]+", s))
    if kind == "card":  # a number of sixteen digits may have been mistyped
        return (13 <= len(d) <= 19 and luhn(d)) or (len(d) == 16 and bool(re.fullmatch(r"[0-9](?:[ -]?[0-9])+", s)))
    if kind == "secret":
        return 16 <= len(s) <= 200 and s.isascii() and s.isalnum() and bool(d) and not s.isdigit()
    if kind == "ip":
        return False  # every address is a pattern's
    return bool(re.fullmatch(r"[\w.+-]+ ?(?:@|[\[(]at[\])]| at ) ?[\w-]+(?: ?(?:\.|[\[(]dot[\])]| dot ) ?[\w-]+)*", s, re.I)) and ("@" in s or re.search(r"\bdot\b|\.\w", s, re.I) is not None)


def added_spans(model: tuple[np.ndarray, np.ndarray], texts: list[str], base: list[list[Span]], most: int = TOKENS) -> list[list[Span]]:
    """What the field adds to the patterns' spans of each text.

    Long zones are labelled in overlapping windows, and windows are decoded in batches of at
    most `most` padded tokens: memory doesn't depend on how long a text is.
    """
    w, trans = model
    todo = [(k, ts) for k, t in enumerate(texts) for ts in (zones(t) if _SEED.search(t) else ()) if ts]
    parts = sorted(((z, part) for z, (_, ts) in enumerate(todo) for part in windows(len(ts))), key=lambda x: x[1][1] - x[1][0])
    labels = [np.zeros(len(ts), np.int8) for _, ts in todo]
    at = 0
    while at < len(parts):
        end = at + 1
        while end < len(parts) and (end + 1 - at) * (parts[end][1][1] - parts[end][1][0]) <= most:
            end += 1
        rows = []
        for z, (a, e, _, _) in parts[at:end]:
            k, ts = todo[z]
            rows.append(token_features(texts[k], ts[a:e]))
        for (z, (a, _, lo, hi)), row in zip(parts[at:end], viterbi(*emissions(rows, w), trans), strict=True):
            labels[z][lo:hi] = row[lo - a : hi - a]
        at = end
    out: list[list[Span]] = [[] for _ in texts]
    for (k, ts), row in zip(todo, labels, strict=True):
        j, names = 0, row.tolist()
        taken = sorted((x, y) for x, y, _ in base[k])
        ends = list(itertools.accumulate((y for _, y in taken), max))  # the farthest end of the spans so far
        while j < len(ts):
            name, z = LABELS[names[j]], j + 1
            if name != "O":
                while z < len(ts) and LABELS[names[z]] == "I-" + name[2:]:
                    z += 1
                a, b = ts[j][0], ts[z - 1][1]
                before = bisect.bisect_left(taken, (b, b))  # spans that begin before this one ends
                if acceptable(texts[k][a:b], name[2:]) and not (before and ends[before - 1] > a):
                    out[k].append((a, b, name[2:]))
            j = z
    return out


def find(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the patterns' spans), spans (all) of every row of docs (doc_id, text)."""
    model = model or fit()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            base = [base_spans(t) for t in texts]
            more = added_spans(model, texts, base)
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in base], pa.int64()) for k in KINDS]
            digest = [hashlib.sha256(joined(s).encode()).hexdigest() for s in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest, pa.string()), pa.array([joined(ordered(s + m)) for s, m in zip(base, more, strict=True)], pa.string())], names)

    return in_small_batches(only(docs, "doc_id", "text").selectExpr("cast(doc_id AS bigint) AS doc_id", "text")).mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    out, at = [], 0
    for a, z, kind in ordered(spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))

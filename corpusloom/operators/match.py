"""Which of many keywords a text holds, as substrings: lists of any size.

Keywords that fit HELD characters are sent to the tasks, which find all of a text's in one pass by an Aho-Corasick
automaton.  A longer list stays distributed: every keyword is known by its rarest gram of GRAM characters, a chunk of texts by
the grams that are some keyword's, and the two meet by gram; so each chunk gets the keywords that it may hold, once for all its texts,
and is searched for them alone.  A sieve of bits, of bounded size, drops nearly all other grams of a chunk before anything is
shuffled; what it lets pass wrongly meets nothing.  Grams are looked up by hash, but what is found is compared by its characters.
Both give the same rows.

Defined results: a null text holds nothing, the empty keyword is in every text that isn't null, null keywords are
none, a repeated keyword counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Characters of all keywords that a task may hold; an automaton takes some 60 bytes for each.
HELD = 4 << 20
#: Characters of a gram, and bytes of texts that meet keywords together (some 1 MB at least, where there are fewer texts than tasks).
GRAM, CHUNK = 8, 32 << 20
#: The bits, as an exponent of 2, of the sieve of grams that each task holds, characters and matches that it looks at at once, and those
#: that it hashes at once, which its cache holds.
SIEVE, AT_ONCE, HASHED = 27, 1 << 18, 1 << 16
#: Odd factors of hashes: of a gram's characters, of the whole, and for each of its bits in the sieve.
STEP, MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
PROBES = [np.uint32(k) for k in (1, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]
#: Stands between texts; no character has this code.
BORDER = 0x110000


def _kept(t: DataFrame) -> DataFrame:
    """t, computed once where spark.checkpoint.dir is set, in that folder; else whenever it is read."""
    return t.checkpoint() if t.sparkSession.sparkContext.getCheckpointDir() else t


def found(rows: DataFrame, text: str, key: str, keywords: DataFrame, word: str, *, held: int = HELD) -> DataFrame:
    """Adds found: the keywords in each row's text, sorted.  keywords: a table with a column `word`.

    `key` must be unique; beyond `held` characters of keywords, texts are dealt into chunks by it, and rows of more than
    the two columns meet what was found in them by it.
    """
    words = _kept(keywords.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct())
    size = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    return _by_automaton(rows, text, words) if size <= held else _by_grams(rows, text, key, words)


def _by_automaton(rows: DataFrame, text: str, words: DataFrame) -> DataFrame:
    listed = sorted(r.word for r in words.collect())
    sent = rows.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        always = {w for w in sent.value if not w}
        for w in sent.value:
            if w:
                machine.add_word(w, w)
        some = len(machine) > 0
        if some:
            machine.make_automaton()
        for s in batches:
            yield pd.Series([[] if t is None else sorted(always.union(w for _, w in machine.iter(t)) if some else always) for t in s], index=s.index, dtype=object)

    return rows.withColumn("found", search(F.col(text)))


def _grams(text: Column, n: int) -> Column:
    """The distinct grams of n characters of a text, whose characters are split once."""
    cut = lambda letters: F.transform(F.sequence(F.lit(1), F.size(letters) - (n - 1)), lambda i: F.array_join(F.slice(letters, i, n), ""))
    return F.array_distinct(F.element_at(F.transform(F.array(F.split(text, "")), cut), 1))


def _codes(texts: list[str]) -> np.ndarray:
    """The code points of all the texts."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _windows(codes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length n, a hash of every n neighbours."""
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, min(max(lengths, default=0), len(codes)) + 1):
        h = h[: len(codes) - n + 1]
        h += codes[n - 1 :]
        h *= STEP
        if n in lengths:
            x = h >> np.uint32(15)
            x ^= h
            x *= MIX
            yield n, x


def _hashes(grams: list[str], n: int) -> np.ndarray:
    """The hashes of grams of n characters each, as _windows gives them."""
    return next((x for _, x in _windows(_codes(grams), [n])), np.zeros(0, np.uint32))[::n]


def _sieve(grams: DataFrame) -> tuple[np.ndarray, int]:
    """(bits, their number's exponent) of a table of grams: a bit for each probe of each, in at most 2**SIEVE bits."""
    bits = min(SIEVE, max(20, (32 * grams.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits >> 3, np.uint8)
        for b in batches:
            of: dict[int, list[str]] = {}
            for g in b.column(0).to_pylist():
                of.setdefault(len(g), []).append(g)
            for n, some in of.items():
                x = _hashes(some, n)
                for k in PROBES:
                    at = x * k >> np.uint32(32 - bits)
                    np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for part, piece in enumerate(own.reshape(-1, 4096)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([piece.tobytes()])], ["part", "bits"])

    t = grams.mapInArrow(run, "part long, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in t.collect():
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out, bits


def _passing(codes: np.ndarray, lengths: list[int], sieve: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, where, hashes) of the grams that the sieve lets pass, for each length and AT_ONCE places."""
    for begin in range(0, len(codes), AT_ONCE):
        of: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for first in range(begin, min(begin + AT_ONCE, len(codes)), HASHED):
            for n, x in _windows(codes[first : first + HASHED + max(lengths) - 1], lengths):
                x, i = x[:HASHED], None
                for k in PROBES:
                    at = (x if i is None else x * k) >> np.uint32(32 - bits)
                    held = np.flatnonzero((sieve[(at >> 3).astype(np.intp)] >> (at & 7).astype(np.uint8) & 1).view(bool))
                    i, x = held if i is None else i[held], x[held]
                of.setdefault(n, []).append((i + first, x))
        for n, parts in of.items():
            yield n, np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])


def _blocks(texts: list[str]) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """(first, last, the joined texts, their code points) of about AT_ONCE characters of texts; each ends with a border."""
    size, first = np.array([len(x) + 1 for x in texts], np.int64), 0
    ends = np.cumsum(size)
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - size[first] + AT_ONCE, side="right")))
        whole = "".join([x + "\0" for x in texts[first:last]])
        codes = _codes([whole]).copy()
        codes[np.cumsum(size[first:last]) - 1] = BORDER
        yield first, last, whole, codes
        first = last


def _held(t: DataFrame, lengths: list[int], sieve: tuple[np.ndarray, int]) -> DataFrame:
    """key, gram: the distinct grams of the lengths in all texts of a key of t (key, text) that the sieve lets pass."""
    sent, bits = t.sparkSession.sparkContext.broadcast(sieve[0]), sieve[1]

    def run(of: pa.Table) -> pa.Table:
        grams: set[str] = set()
        for _, _, whole, codes in _blocks([x for x in of["text"].to_pylist() if x]):
            for n, i, x in _passing(codes, lengths, sent.value, bits):
                same, each = pd.factorize(x)
                one = np.zeros(len(each), np.int64)
                one[same] = i  # a place of each hash; what stands elsewhere under one hash and isn't the same is looked at too
                other = np.zeros(len(i), bool)
                for j in range(n):
                    other |= codes[i + j] != codes[one[same] + j]
                grams.update([whole[k : k + n] for k in one.tolist() + i[other].tolist()])
        return pa.table([pa.repeat(of["key"][0], len(grams)), pa.array(list(grams), pa.string())], names=["key", "gram"])

    return t.groupBy("key").applyInArrow(run, StructType([t.schema["key"], StructField("gram", StringType())]))


class _Words:
    """Sorted words, each with a gram that it is known by, to be found in code points."""

    def __init__(self, known: list[tuple[str, str]], sieve: np.ndarray, bits: int) -> None:
        known = sorted(known)
        self.sieve, self.bits = sieve, bits
        self.size = np.array([len(w) for w, _ in known], np.int64)
        self.letters, self.begin = _codes([w for w, _ in known]), np.cumsum(self.size) - self.size
        self.inside = np.array([w.index(g) for w, g in known], np.int64)
        of: dict[int, list[int]] = {}
        for k, (_, g) in enumerate(known):
            of.setdefault(len(g), []).append(k)
        self.by = {}
        for n, ids in of.items():
            x = _hashes([known[k][1] for k in ids], n)
            order = np.argsort(x)
            self.by[n] = x[order], np.array(ids, np.int64)[order]

    def equal(self, codes: np.ndarray, start: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which of the words stand where they may begin."""
        fits = (start >= 0) & (start + self.size[word] <= len(codes))
        left = np.flatnonzero(fits)
        for j in range(int(self.size[word].max(initial=0))):
            left = left[self.size[word[left]] > j]
            if not len(left):
                break
            same = codes[start[left] + j] == self.letters[self.begin[word[left]] + j]
            fits[left[~same]] = False
            left = left[same]
        return np.flatnonzero(fits)

    def found(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(where, which) of the words, time and again."""
        for n, i, x in _passing(codes, list(self.by), self.sieve, self.bits):
            hashes, ids = self.by[n]
            same, each = pd.factorize(x)
            low = np.searchsorted(hashes, each)
            many = (np.searchsorted(hashes, each, side="right") - low)[same]
            ends, low, first = np.cumsum(many), low[same], 0
            while first < len(i):  # about AT_ONCE words that may stand there
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - many[first] + AT_ONCE, side="right")))
                m = many[first:last]
                nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                word = ids[np.repeat(low[first:last], m) + nth]
                start = np.repeat(i[first:last], m) - self.inside[word]
                ok = self.equal(codes, start, word)
                yield start[ok], word[ok]
                first = last


def _searched(t: DataFrame, known: DataFrame, sieve: tuple[np.ndarray, int]) -> DataFrame:
    """id, text, found: which of its key's words (key, word, gram) each text of t (key, id, text) holds."""
    sent, bits = t.sparkSession.sparkContext.broadcast(sieve[0]), sieve[1]

    def run(of: pa.Table, met: pa.Table) -> pa.Table:
        words = _Words(list(zip(met["word"].to_pylist(), met["gram"].to_pylist(), strict=True)), sent.value, bits)
        n, size, held = len(words.size), [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for first, last, _, codes in _blocks([x or "" for x in of["text"].to_pylist()]) if n else []:
            row = np.cumsum(codes == BORDER)
            pairs = [pd.unique(row[start] * n + word) for start, word in words.found(codes)]
            pairs = np.sort(pd.unique(np.concatenate(pairs))) if pairs else held[0]
            size.append(np.bincount(pairs // n, minlength=last - first))
            held.append(pairs % n)
        ends = np.cumsum(np.concatenate(size if n else [np.zeros(of.num_rows + 1, np.int64)]))
        each = pa.array(sorted(met["word"].to_pylist()), pa.string()).take(pa.array(np.concatenate(held)))
        return pa.table([of["id"], of["text"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], names=["id", "text", "found"])

    schema = StructType([t.schema["id"], t.schema["text"], StructField("found", ArrayType(StringType()))])
    return t.groupBy("key").cogroup(known.groupBy("key")).applyInArrow(run, schema)


def _by_grams(rows: DataFrame, text: str, key: str, words: DataFrame) -> DataFrame:
    n = F.least(F.length("word"), F.lit(GRAM))
    lengths = sorted(r.n for r in words.select(n.alias("n")).distinct().collect())
    always = F.array(F.lit("")) if 0 in lengths else F.array().cast("array<string>")
    lengths = [k for k in lengths if k]
    if not lengths:
        return rows.withColumn("found", F.when(F.col(text).isNotNull(), always).otherwise(F.array().cast("array<string>")))
    long = words.where(F.length("word") >= GRAM).withColumn("gram", F.explode(_grams(F.col("word"), GRAM)))
    shared = long.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = long.join(shared, "gram").groupBy("word").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    known = _kept(rarest.unionByName(words.where((F.length("word") < GRAM) & (F.col("word") != "")).withColumn("gram", F.col("word"))))
    sieve = _sieve(known.select("gram").distinct())
    size = rows.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    chunks = max(1, -(-size // CHUNK), min(4 * rows.sparkSession.sparkContext.defaultParallelism, size >> 20))
    t = rows.select(F.pmod(F.hash(F.col(key)), F.lit(chunks)).alias("key"), F.col(key).alias("id"), F.col(text).alias("text")).repartition(chunks, "key")
    lists = _searched(t, _held(t, lengths, sieve).join(known, "gram"), sieve)
    lists = lists.withColumn("found", F.when(F.col("text").isNotNull(), F.concat(always, "found")).otherwise(F.col("found")))
    if rows.columns in ([key, text], [text, key]):
        return lists.select(*[F.col("id" if c == key else "text").alias(c) for c in rows.columns], "found")
    out = rows.select(F.struct("*").alias("row"), F.col(key).alias("key")).join(lists, F.col("key").eqNullSafe(F.col("id")), "left")
    return out.select("row.*", "found")

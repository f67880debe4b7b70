"""N-gram Jaccard join with filters under several global token orders (operator 9).

A document's set is that of its 5-word shingles; two documents link at a similarity of
0.75 or more.  Equal sets are one class, known by its hash; classes are joined so:

1. One pass over the texts gives each document's class and size, and the shingles that
   are frequent in any stretch of the corpus.  These come last in every order.
2. Under an order, an extended prefix of a set holds LEVEL shingles, or a fixed
   share, of every similar set.  Prefixes under two orders (seeds of a hash) are dealt out by shingle; a
   class stays only if, under *both* orders, enough shingles of its prefix occur in other
   classes too.  Most texts end here, without a pair having been formed.
3. Classes that share a prefix shingle meet in the task of that shingle's least class; tasks
   that account for too few of a class's shared shingles are skipped.
   There a pair is a candidate if its prefixes meet under both orders and its sizes allow
   the threshold; candidates are verified on the whole sets.  Pairs whose link would join
   what is joined already are skipped, so a large group of copies takes one pass of its
   members, not all its pairs.  A task of more than BLOCK members is split into tasks for
   each two blocks of them.
4. The links of all tasks are joined to components.

No filter drops a link: prefix lengths follow from the threshold alone.  Hash width: sets
are compared as sets of 64-bit hashes, classes are told apart by 64 bits.

Defined results: null texts and those without words have no shingles and no links; rows
with one doc_id are rows of one document and share a component with each other's
classes; rows of null doc_id are joined, but never name a component; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, only, positional, release, small_batches, table
from .components import components
from .hashing import U, mix64, prefix_hashes, substring_hashes

SHINGLE, PERCENT = 5, 75
#: Similar sets must share so many shingles within their prefixes: at least LEVEL, or one in SHARE of the set.
LEVEL, SHARE = 8, 8
ORDERS = (0, 0x5851F42D4C957F2D)
#: Tasks that a component's classes are dealt to; members of a verification task; prefix entries of a bucket.
SALT, BLOCK, BUCKET = 64, 4096, 1 << 20
#: A stretch of so many shingles reports those it holds this often; at most HOT_MAX are put last: 8 bytes each are broadcast.
STRETCH, HOT_LOCAL, HOT_MAX = 3 << 19, 2, 200_000
#: Tables of ids of up to so many rows (32 bytes each at most) are joined by a broadcast; beyond, by a shuffle.
BROADCAST_IDS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_MULT = 0xD6E8FEB86659FD93


def up(n: int) -> int:
    """The least number of shingles that a set of n shares with a similar one."""
    return -(-PERCENT * n // 100)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where it is shorter."""
    a = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (~_BLANK[a]).view(np.int8), [0]))))
    if not len(edge):
        return np.zeros(0, np.uint64)
    words = mix64(substring_hashes(prefix_hashes(a), edge[::2], edge[1::2]))
    m = min(k, len(words))
    s = sum(words[j : len(words) - m + 1 + j] * U(pow(_MULT, j, 1 << 64)) for j in range(m))
    return np.unique(mix64(s + U(m)))


def class_key(s: np.ndarray) -> int:
    return int(mix64(np.array([mix64(s * U(_MULT)).sum(dtype=np.uint64) + U(len(s))], np.uint64)).view(np.int64)[0])


def level(n: int) -> int:
    """How many shingles more than needed for one common the prefix of a set of n has; it never falls with n."""
    return min(up(n), max(LEVEL, n // SHARE))


def prefix(s: np.ndarray, order: int, hot: np.ndarray) -> np.ndarray:
    """The shingles of s that come first: frequent ones last, else by a seeded hash."""
    n = len(s)
    take = n - up(n) + level(n)
    key = mix64(s ^ U(order)) if order else s
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        late = hot[at] == s
        if late.any():
            return s[np.lexsort((key, late))[:take]]
    return s[np.argpartition(key, take - 1)[:take]] if take < n else s


def needed(n: int) -> int:
    """How many of a prefix's shingles any similar set's prefix must share: by the smallest such set."""
    return level(up(n))


def needed_of(n: Column) -> Column:
    """`needed` of a column of sizes."""

    def most(m: Column) -> Column:
        return F.ceil(m * PERCENT / 100)

    m = most(n)
    return F.least(most(m), F.greatest(F.lit(LEVEL), F.floor(m / SHARE))).cast("int")


def _profile(docs: DataFrame) -> DataFrame:
    """Pass 1.  kind 0: doc_id, n, key of a document; kind 1: a shingle (key) that a stretch holds n times."""
    schema = "kind byte, doc_id long, n long, key long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0

        def frequent() -> pa.RecordBatch:
            nonlocal held, total
            v, c = np.unique(np.concatenate([*held.values(), np.zeros(0, np.uint64)]), return_counts=True)
            v, c = v[c >= HOT_LOCAL], c[c >= HOT_LOCAL]
            held, total = {}, 0
            return row(1, pa.nulls(len(v), pa.int64()), c, v.view(np.int64))

        def row(kind: int, ids: pa.Array, n: np.ndarray, key) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int8)), ids, pa.array(np.asarray(n, np.int64)), pa.array(key, pa.int64())], ["kind", "doc_id", "n", "key"])

        for b in batches:
            n, keys = [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                k = class_key(s) if len(s) else None
                n.append(len(s))
                keys.append(k)
                if k is not None and k not in held:
                    held[k] = s
                    total += len(s)
                if total >= STRETCH:
                    yield frequent()
            yield row(0, b.column(0), np.array(n), keys)
        yield frequent()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lean(run), schema)


def _deal(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Pass 2.  ord, bucket, data: prefix entries; the classes of a stretch once each, so copies are combined before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, total
            keys = np.array(list(held), np.int64)
            for o, order in enumerate(ORDERS):
                parts = [prefix(s, order, hot) for s in held.values()]
                tok = np.concatenate([*parts, np.zeros(0, np.uint64)])
                doc = np.repeat(np.arange(len(keys)), [len(p) for p in parts])
                bucket = (tok % U(buckets)).astype(np.int64)
                by = np.argsort(bucket * len(keys) + doc, kind="stable")
                tok, doc, bucket = (tok // U(buckets)).astype(np.uint32)[by], doc[by], bucket[by]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                ids, data = [], []
                for a, z in zip(cuts, cuts[1:], strict=False):
                    d, c = np.unique(doc[a:z], return_counts=True)
                    if c.max() > 255:  # a count is a byte; larger ones are spread over several mentions of their class
                        parts_of = -(-c // 255)
                        d, c = np.repeat(d, parts_of), np.minimum(255, np.repeat(c, parts_of) - 255 * (np.arange(parts_of.sum()) - np.repeat(np.cumsum(parts_of) - parts_of, parts_of)))
                    ids.append(int(bucket[a]))
                    data.append(np.uint32(len(d)).tobytes() + keys[d].tobytes() + c.astype(np.uint8).tobytes() + tok[a:z].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([o] * len(ids), pa.int32()), pa.array(ids, pa.int32()), pa.array(data, pa.binary())], ["ord", "bucket", "data"])
            held, total = {}, 0

        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py())
                if len(s) and (k := class_key(s)) not in held:
                    held[k] = s
                    total += len(s)
                    if total >= STRETCH:
                        yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(lean(run), "ord int, bucket int, data binary")


def _shared(group: pa.Table) -> pa.Table:
    """Of one bucket, the entries (ord, token, key) whose shingle at least two classes hold."""
    o, b = group.column("ord")[0].as_py(), group.column("bucket")[0].as_py()
    keys, toks = [], []
    for x in group.column("data"):
        raw = memoryview(x.as_buffer())
        m = int(np.frombuffer(raw, np.uint32, 1)[0])
        c = np.frombuffer(raw, np.uint8, m, 4 + 8 * m)
        keys.append(np.repeat(np.frombuffer(raw, np.int64, m, 4), c))
        toks.append(np.frombuffer(raw[4 + 9 * m :], np.uint32))
    key, tok = np.concatenate(keys), np.concatenate(toks)
    by = np.lexsort((key, tok))
    key, tok = key[by], tok[by]
    new = np.r_[True, (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])]  # the same class from several stretches
    key, tok = key[new], tok[new]
    cut = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    many = np.repeat(np.diff(np.r_[cut, len(tok)]), np.diff(np.r_[cut, len(tok)])) > 1
    key, tok = key[many], tok[many]
    token = (np.int64(b) << np.int64(32)) | tok.astype(np.int64)
    return pa.table({"ord": pa.array(np.full(len(key), o, np.int32)), "token": pa.array(token), "key": pa.array(key)})


def link_members(keys: np.ndarray, sets: list[np.ndarray], hot: np.ndarray) -> list[tuple[int, int]]:
    """Links (pairs of keys) that join all members which links of the threshold join."""
    m = len(sets)
    root = np.arange(m)
    sizes = np.array([len(s) for s in sets])
    links: list[tuple[int, int]] = []
    ends = np.cumsum(sizes)
    flat = np.concatenate(sets)

    def verify(i: int, cand: np.ndarray) -> None:
        """Joins i with those of cand that are similar."""
        cand = cand[(root[cand] != root[i]) & (100 * np.minimum(sizes[cand], sizes[i]) >= PERCENT * np.maximum(sizes[cand], sizes[i]))]
        if not len(cand):
            return
        some = np.concatenate([flat[ends[c] - sizes[c] : ends[c]] for c in cand])
        at = np.minimum(np.searchsorted(sets[i], some), sizes[i] - 1)
        both = np.add.reduceat((sets[i][at] == some).astype(np.int64), np.cumsum(sizes[cand]) - sizes[cand])
        for c in cand[100 * both >= PERCENT * (sizes[cand] + sizes[i] - both)]:
            if root[c] != root[i]:
                links.append((int(keys[i]), int(keys[c])))
                root[root == root[c]] = root[i]

    pre = [[prefix(s, o, hot) for s in sets] for o in ORDERS]
    index = []
    for parts in pre:
        tok, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        doc = np.repeat(np.arange(m), [len(p) for p in parts])
        by = np.argsort(inverse, kind="stable")
        index.append((inverse, np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(tok)))]), doc[by]))

    def met(i: int) -> np.ndarray:
        """The members whose prefixes meet that of i under every order."""
        ok = np.ones(m, bool)
        for inverse, at, start, doc in index:
            mine = inverse[at[i] : at[i + 1]]
            n = start[mine + 1] - start[mine]
            hits = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            seen = np.zeros(m, bool)
            seen[doc[hits]] = True
            ok &= seen
        ok[i] = False
        return np.flatnonzero(ok)

    # A few members against all they meet: most of a group of copies is one component after that.
    for i in np.linspace(0, m - 1, min(m, 4)).astype(int):
        verify(int(i), met(int(i)))
    # Then whatever is outside the largest component; pairs within it need no test.
    largest = np.bincount(root, minlength=m).argmax()
    for i in np.flatnonzero(root != largest):
        verify(int(i), met(int(i)))
    return links


def _verify(hot: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        _, first = np.unique(keys, return_index=True)
        data = group.column("data").combine_chunks()
        sets = [np.frombuffer(data[int(k)].as_buffer(), np.uint64) for k in first]
        links = link_members(keys[first], sets, hot)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _small(kept: DataFrame) -> DataFrame:
    """A kept table of a few numbers a row, marked to be broadcast if it has at most BROADCAST_IDS rows; else it is joined by a shuffle."""
    return F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, key (the class; null without shingles) of every row of docs (doc_id, text)."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(only(docs, "doc_id", "text"))


def _near_duplicates(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    found = materialize(_profile(docs), "shingle-profile")
    rows = found.where("kind = 0").select("doc_id", "n", "key")
    frequent = found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(HOT_MAX).select("key")
    hot = np.sort(np.array([r.key for r in frequent.collect()], np.int64).view(np.uint64))
    entries = rows.agg(F.coalesce(F.sum(F.ceil(F.col("n") * (1 - PERCENT / 100 + 1 / SHARE)) + LEVEL), F.lit(0))).first()[0]
    buckets = max(8, -(-int(entries) // BUCKET))

    shared = materialize(_deal(docs, hot, buckets).groupBy("ord", "bucket").applyInArrow(_shared, "ord int, token long, key long"), "shared-prefixes")
    per = [F.count_if(F.col("ord") == o).alias(f"n{o}") for o in range(len(ORDERS))]
    live = shared.groupBy("key").agg(*per).select("key", F.least(*(F.col(f"n{o}") for o in range(len(ORDERS)))).alias("live")).where("live > 0")
    sizes = rows.where("key IS NOT NULL").groupBy("key").agg(F.max("n").alias("n")).select("key", needed_of(F.col("n")).alias("req"))
    alive = materialize(live.join(sizes, "key").where("live >= req").select("key", "req"), "alive")
    release(spark)
    first = shared.where("ord = 0").select("token", "key").join(_small(alive), "key")
    leaders = first.groupBy("token").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", "leader")
    # Similar classes share `req` shingles, whose tasks both visit.  If either leaves out tasks that hold less than half of
    # these of its own, one that both visit is left: so each class skips its least tasks up to that sum.
    met = first.join(leaders, "token").groupBy("leader", "key").agg(F.count(F.lit(1)).alias("c"), F.max("req").alias("req"))
    least = F.sum("c").over(Window.partitionBy("key").orderBy("c", "leader").rowsBetween(Window.unboundedPreceding, 0))
    members = materialize(met.withColumn("sum", least).where("2 * sum > req - 1").select("leader", "key"), "members")
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("leader", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = members.join(sizes, "leader").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = materialize(members.select("leader", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "key"), "tasks")

    wanted = tasks.select("key").distinct()
    reps = rows.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(wanted, "key").select("doc_id")
    reps = materialize(reps, "candidates")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingles(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([class_key(x) if len(x) else None for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], ["key", "data"])

    texts = docs.select("doc_id", "text").join(_small(reps), "doc_id", "left_semi").select("text").union(docs.where("doc_id IS NULL").select("text"))
    whole = texts.mapInArrow(lean(sets), "key long, data binary")
    links = whole.join(_small(tasks), "key").groupBy("leader", "i", "j").applyInArrow(_verify(hot), "a long, b long")
    # Rows with one doc_id are one document: their classes are linked.
    many = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("doc_id", "a")
    same = many.join(rows.select("doc_id", F.col("key").alias("b")), "doc_id").where("a <> b").select("a", "b")
    roots = components(links.unionByName(same)).withColumnRenamed("node", "key")
    # Per class its copies' least id, then per component its classes' least: one row a class is joined, never one a document.
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    linked = roots.union(roots.select(F.col("root").alias("key"), "root").distinct()).join(classes, "key")
    salts = F.sequence(F.lit(0), F.lit(SALT - 1))  # a large component's classes are dealt to SALT tasks
    of = linked.groupBy("root").agg(F.min("least").alias("component")).withColumn("salt", F.explode(salts))
    salted = linked.select("key", "root", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int").alias("salt"))
    named = salted.join(of, ["root", "salt"]).select("key", "component")
    copied = classes.where("copies > 1").join(linked.select("key"), "key", "left_anti").select("key", F.col("least").alias("component"))
    # Only groups of two or more are named; adaptive execution splits a hot key where they are too many to be broadcast.
    named = materialize(named.union(copied), "components")
    out = rows.join(_small(named), "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "key")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs (all its columns) without the documents that link, over others or at once, to one with a smaller doc_id; null ids stay."""
    gone = materialize(near_duplicates(docs).where("component_id < doc_id").select("doc_id").distinct(), "near-duplicates")
    rows, (doc_id,) = positional(docs, "doc_id")
    return rows.join(_small(gone.withColumnRenamed("doc_id", doc_id)), doc_id, "left_anti").select(*rows.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS sh
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS root FROM both_ways UNION SELECT both_ways.b, r.root FROM r JOIN both_ways ON both_ways.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
"""

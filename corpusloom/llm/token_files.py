"""Token-ID output in entropy-coded block files (operator 3).

Texts are encoded by a public tokenizer, an end id is appended to each document, and the
ids are written in ascending doc_id order by a static range asymmetric numeral system:

* one frequency table, counted over all ids and scaled to 2**PROB_BITS, is shared by all blocks;
* a block holds whole documents, is coded on its own by LANES interleaved 64-bit states
  with 32-bit words, and carries a checkpoint (all states and the word offset) every
  CHECKPOINT steps: the ids between two checkpoints are a segment, which is decoded on its
  own (`read_span` deals segments to tasks);
* each segment has the CRC-32 of its ids, checked on reading.

Files are Parquet tables of (shard, block, start, n_tokens, segment_tokens, data): `start`
counts the ids of the shard before the block, `data` is the block.  A sibling table holds the frequencies.

Block layout, little-endian: magic ``RNS2``; u32 lanes, checkpoint steps, docs, tokens,
words, segments; then i64[docs] ids, u8[docs] "id is null", u32[docs] lengths,
u32[segments] CRC-32, (u32 word offset, u64[lanes] states) of each segment, u32[words].

Defined results: a null text is encoded as an empty one; null ids sort first; rows with
one doc_id stay separate, ordered by a hash of their ids; an empty table gives an empty file set.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoder
from .common import discard, lean, only, release, shared_dir, small_batches, table, utf8

END_ID = 0
PROB_BITS = 20
LANES, CHECKPOINT, BLOCK_TOKENS = 1024, 256, 1 << 19
LOW = np.uint64(1 << 31)


def scale(counts: np.ndarray, bits: int = PROB_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits; every id that occurs keeps at least 1."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.uint32)
    f = np.where(counts > 0, np.maximum(1, counts * (size / total)).astype(np.int64), 0)
    order = np.argsort(-f, kind="stable")
    gap, k = size - int(f.sum()), 0
    while gap:
        step = max(-int(f[order[k]]) // 2, gap) if gap < 0 else gap
        if f[order[k]] + step >= 1:
            f[order[k]] += step
            gap -= step
        k = (k + 1) % int((f > 0).sum())
    return f.astype(np.uint32)


def encode_block(ids: np.ndarray, freq: np.ndarray, low: np.ndarray, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """(states, checkpoints, words) of ids; a step codes one id on every lane."""
    x = np.full(lanes, LOW, np.uint64)
    f, c = freq[ids].astype(np.uint64), low[ids].astype(np.uint64)
    limit = f << np.uint64(63 - PROB_BITS)
    steps, out, marks, n = -(-len(ids) // lanes), [], [], 0
    for t in range(steps - 1, -1, -1):
        at = slice(t * lanes, min(len(ids), (t + 1) * lanes))
        k = at.stop - at.start
        y, ft = x[:k], f[at]
        full = y >= limit[at]
        if full.any():
            out.append(y[full].astype(np.uint32))  # the low 32 bits
            n += len(out[-1])
            y = np.where(full, y >> np.uint64(32), y)
        q = y // ft
        x[:k] = (q << np.uint64(PROB_BITS)) + (y - q * ft) + c[at]
        if t and t % checkpoint == 0:
            marks.append((n, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return x, [(n - m, s) for m, s in reversed(marks)], words


def decode_block(n: int, states: np.ndarray, words: np.ndarray, freq: np.ndarray, low: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """n ids from the first of words on, where states are those of their first step."""
    x, lanes, mask, at = states.copy(), len(states), np.uint64((1 << PROB_BITS) - 1), 0
    out = np.empty(n, slots.dtype)
    for begin in range(0, n, lanes):
        k = min(lanes, n - begin)
        y = x[:k]
        r = y & mask
        s = slots[r.astype(np.int64)]
        out[begin : begin + k] = s
        y = freq[s].astype(np.uint64) * (y >> np.uint64(PROB_BITS)) + r - low[s].astype(np.uint64)
        need = y < LOW
        m = int(need.sum())
        if m:
            y[need] = (y[need] << np.uint64(32)) | words[at : at + m].astype(np.uint64)
            at += m
        x[:k] = y
    return out


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first slot of each id, id of each slot)."""
    low = np.concatenate([[0], np.cumsum(freq[:-1], dtype=np.int64)]).astype(np.uint32)
    return low, np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def pack(doc_ids: list[int | None], parts: list[np.ndarray], freq: np.ndarray, low: np.ndarray, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> bytes:
    ids = np.concatenate(parts).astype("<u4")
    states, marks, words = encode_block(ids, freq, low, lanes, checkpoint)
    marks = [(0, states), *marks]
    crcs = [zlib.crc32(ids[k : k + lanes * checkpoint]) for k in range(0, max(1, len(ids)), lanes * checkpoint)]
    return b"".join([
        b"RNS2", np.array([lanes, checkpoint, len(doc_ids), len(ids), len(words), len(marks)], "<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array([len(p) for p in parts], "<u4").tobytes(), np.array(crcs, "<u4").tobytes(),
        *(np.uint32(o).astype("<u4").tobytes() + s.astype("<u8").tobytes() for o, s in marks), words.astype("<u4").tobytes(),
    ])


def segments(data) -> int:
    """How many segments a block has."""
    return int(np.frombuffer(data, "<u4", 6, 4)[5])


def unpack(data, freq: np.ndarray, low: np.ndarray, slots: np.ndarray, only: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a block; with `only`, the ids of that segment alone are decoded."""
    data = memoryview(data)
    if bytes(data[:4]) != b"RNS2":
        raise ValueError("not a block")
    lanes, every, docs, n, n_words, n_marks = (int(v) for v in np.frombuffer(data, "<u4", 6, 4))
    at = 28

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, lengths, crcs = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", n_marks)
    marks = [(int(take("<u4", 1)[0]), take("<u8", lanes)) for _ in range(n_marks)]
    words = take("<u4", n_words)
    out = []
    for k in range(n_marks) if only is None else (only,):
        offset, states = marks[k]
        ids = decode_block(min(lanes * every, n - k * lanes * every), states, words[offset:], freq, low, slots)
        if zlib.crc32(ids.astype("<u4")) != crcs[k]:
            raise ValueError("a segment's checksum differs")
        out.append(ids)
    return [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], lengths, np.concatenate(out)


def tokenize(docs: DataFrame, spec: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, ids (binary, little-endian) of every row of docs (doc_id, text).  spec: the tokenizer's JSON."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder.shared(spec)
        end = b"" if end_id is None else np.array([end_id], e.width).tobytes()
        for b in batches:
            ids, n = e.encode(*utf8(b.column(1)))
            flat, ends = ids.tobytes(), (np.cumsum(n) * ids.itemsize).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[a:z] + end for a, z in zip([0, *ends], ends, strict=False)], pa.binary())], ["doc_id", "ids"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit(""))).mapInArrow(lean(run, 512, "encoder"), "doc_id long, ids binary")


def token_counts(tokens: DataFrame, vocab: int, width: str) -> np.ndarray:
    """How often each id occurs; at most one row per id and task is shuffled, one per id sent to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocab, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), width), minlength=vocab)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(lean(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocab, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes docs (doc_id, text) to path: ``freq`` and ``blocks``.

    The ids are kept in shared storage (``tokens``) before they are counted and coded, so that
    a lost executor costs no second encoding, and are deleted when the blocks are written.
    Sorting deals ids, not texts, by ranges of doc_id; rows of one doc_id may be dealt to many
    ranges, by a hash of their ids, then by where they stood.
    """
    with small_batches(docs.sparkSession, 512):
        _write_tokens(docs, path, tokenizer_path, end_id, block_tokens)


def _write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, block_tokens: int) -> None:
    spark = docs.sparkSession
    spec = Path(tokenizer_path).read_text()  # the tokenizer is a file of the driver's environment, not of the data store
    e = encoder.Encoder(spec)
    vocab, width = e.vocab, e.width
    del e
    release(spark)
    tokenize(docs, spec, end_id).write.option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.schema("doc_id long, ids binary").parquet(f"{path}/tokens")
    freq = scale(token_counts(tokens, vocab, width))
    release(spark)
    low, _ = tables(freq)
    spark.createDataFrame([(PROB_BITS, freq.astype("<u4").tobytes())], "prob_bits int, freq binary").coalesce(1).write.parquet(f"{path}/freq")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start, ids, parts, held = 0, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, ids, parts, held
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([LANES * CHECKPOINT], pa.int32()), pa.array([pack(ids, parts, freq, low, LANES, CHECKPOINT)], pa.binary())], ["shard", "block", "start", "n_tokens", "segment_tokens", "data"])
            block, start, ids, parts, held = block + 1, start + held, [], [], 0
            return row

        for b in batches:
            for s, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                p = np.frombuffer(x.as_buffer(), width)
                if held and held + len(p) > block_tokens:
                    yield flush()
                shard, held = s, held + len(p)
                ids.append(d)
                parts.append(p)
        if ids:
            yield flush()

    key = [F.col("doc_id").asc_nulls_first(), F.col("__of"), F.col("__at")]
    ordered = tokens.withColumns({"__of": F.xxhash64("ids"), "__at": F.monotonically_increasing_id()}).repartitionByRange(*key).sortWithinPartitions(*key)
    coded = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "ids").mapInArrow(lean(run), "shard int, block int, start long, n_tokens long, segment_tokens int, data binary")
    coded.write.option("compression", "none").parquet(f"{path}/blocks")
    discard(spark, f"{path}/tokens")
    release(spark)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (list) of what write_tokens wrote."""
    return _decoded(spark, path, lambda ids: pa.array(ids, pa.list_(pa.int32())), "ids array<int>", "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, decoded from the files like read_tokens."""

    def crc(ids: list[np.ndarray]) -> pa.Array:
        return pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())

    return _decoded(spark, path, crc, "ids_crc32 long", "ids_crc32")


def _starts(blocks: DataFrame) -> DataFrame:
    """shard, before: the ids of all earlier shards.  One row per shard, of which there are as many as tasks, is summed in order."""
    sizes = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    offsets, total = [], 0
    for shard in sorted(sizes):
        offsets.append((shard, total))
        total += sizes[shard]
    return blocks.sparkSession.createDataFrame(offsets, "shard int, before long")


def _frequencies(spark: SparkSession, path: str) -> np.ndarray:
    return np.frombuffer(spark.read.parquet(f"{path}/freq").first().freq, "<u4").astype(np.uint32)


def _decoded(spark: SparkSession, path: str, give, field: str, name: str) -> DataFrame:
    freq = _frequencies(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, slots = tables(freq)
        for b in batches:
            for s, o, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                docs, lengths, ids = unpack(data.as_buffer(), freq, low, slots)
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts + o), pa.array(lengths.astype(np.int64)), give([ids[a:z] for a, z in zip(starts, ends, strict=True)])], ["shard", "doc_id", "at", "n_tokens", name])

    blocks = spark.read.parquet(f"{path}/blocks")
    rows = blocks.select("shard", "start", "data").mapInArrow(lean(run), f"shard int, doc_id long, at long, n_tokens long, {field}")
    return rows.join(F.broadcast(_starts(blocks)), "shard").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", name)


def read_span(spark: SparkSession, path: str, first: int, stop: int) -> DataFrame:
    """start, ids: the ids at positions first to stop - 1 of the whole stream, one row per segment.

    Only blocks that hold some are read; each of their segments is decoded from its
    checkpoint, as a task's row of its own.
    """
    freq = _frequencies(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    placed = blocks.join(F.broadcast(_starts(blocks)), "shard").select((F.col("start") + F.col("before")).alias("start"), "n_tokens", "segment_tokens", "data")
    placed = placed.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > first))
    count = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("segment_tokens"))).cast("int")
    each = placed.withColumn("segment", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("start", F.col("start") + F.col("segment") * F.col("segment_tokens"))
    each = each.where((F.col("start") < stop) & (F.col("start") + F.col("segment_tokens") > first)).select("start", "segment", "data")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, slots = tables(freq)
        for b in batches:
            for o, k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = unpack(data.as_buffer(), freq, low, slots, k)[2]
                a, z = max(0, first - o), min(len(ids), stop - o)
                yield pa.RecordBatch.from_arrays([pa.array([o + a], pa.int64()), pa.array([ids[a:z]], pa.list_(pa.int32()))], ["start", "ids"])

    return each.repartition(F.col("start")).mapInArrow(lean(run), "start long, ids array<int>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path or default_tokenizer())
    return read_digests(spark, path)

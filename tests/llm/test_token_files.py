"""Operator 3: exact round trips and the ids of the tokenizer itself."""

import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import encoder
from corpusloom.llm import token_files as tf
from corpusloom.llm.encoder import Encoder

from .cases import PROSE, docs, odd_texts

SPEC = open(tf.default_tokenizer()).read()


@given(st.lists(st.integers(0, 60), max_size=2000), st.integers(1, 9), st.integers(1, 5))
@settings(max_examples=40, deadline=None)
def test_block_round_trip(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    freq = tf.scale(np.bincount(ids, minlength=61))
    low, slots = tf.tables(freq)
    data = tf.pack([7, None], [ids[: len(ids) // 3], ids[len(ids) // 3 :]], freq, low, lanes, every)
    docs_, lengths, back = tf.unpack(data, freq, low, slots)
    assert docs_ == [7, None] and lengths.tolist() == [len(ids) // 3, len(ids) - len(ids) // 3]
    assert back.tolist() == ids.tolist()
    assert tf.segments(data) == max(1, -(-len(ids) // (every * lanes)))
    for k in range(tf.segments(data)):
        part = tf.unpack(data, freq, low, slots, only=k)[2]
        assert part.tolist() == ids[k * every * lanes : (k + 1) * every * lanes].tolist()


def test_scale_sums_and_keeps_rare_ids():
    counts = np.array([10**9, 1, 0, 5] + [1] * 1000)
    f = tf.scale(counts)
    assert f.sum() == 1 << tf.PROB_BITS and f[2] == 0 and (f[counts > 0] > 0).all()


def test_damage_is_found():
    ids = np.arange(1000, dtype=np.uint32) % 50
    freq = tf.scale(np.bincount(ids))
    low, slots = tf.tables(freq)
    data = bytearray(tf.pack([1], [ids], freq, low, 16, 8))
    data[-200] ^= 1
    with pytest.raises(ValueError):
        tf.unpack(bytes(data), freq, low, slots)


ENCODER = Encoder(SPEC)  # one for all examples, as in a worker: what one text leaves in its table must not change another
FRESH = Tokenizer.from_file(tf.default_tokenizer())
ALPHABET = "".join(map(chr, range(0x21))) + "\x7f\x85\xa0\u3000\u2003\u200b\u180e ab'sZé×ñ19.,!<|>$*-\u0301\u00b2\u00aa漢٣😀"


@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=6))
@example(["hello world. yes", "see \0. here", "a \0b", "\0"])
@example(["x" * 31 + " " + "x" * 32 + " " + "x" * 33 + "  " + "x" * 500, "  a   b\n\n c \n", " ", ""])
@settings(max_examples=800, deadline=None)
def test_pieces_give_the_tokenizers_ids(texts):
    assert ENCODER.texts(texts) == [FRESH.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.lists(st.sampled_from(["'s", "'ll", "don't", "x", "!", " ", "\n", "9", "é"]), max_size=9).map("".join), max_size=5))
@settings(max_examples=300, deadline=None)
def test_contractions(texts):
    assert ENCODER.texts(texts) == [FRESH.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_pieces_with_one_hash_and_a_full_table(monkeypatch):
    texts = [PROSE, "Other words, other 12 ids; seven wise owls", "and more of them " * 30]
    want = [FRESH.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(encoder, "mix64", lambda x: x & np.uint64(1))  # nearly all collide
    assert Encoder(SPEC).texts(texts) == want
    monkeypatch.undo()
    monkeypatch.setattr(encoder, "CAPACITY", 25)
    e = Encoder(SPEC)
    assert [e.texts([t])[0] for t in texts * 2] == want * 2


@given(st.lists(st.text(alphabet="ab 9.\u3000é\n", max_size=60), max_size=4))
@settings(max_examples=200, deadline=None)
def test_long_texts_are_cut(texts):
    old = encoder.AT_ONCE, encoder.LOOK
    encoder.AT_ONCE, encoder.LOOK = 7, 5
    try:
        assert ENCODER.texts(texts) == [FRESH.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        encoder.AT_ONCE, encoder.LOOK = old


def test_a_text_of_megabytes():
    t = (PROSE + " 12, <|endoftext|>\n") * 30_000 + "漢" * 100_000
    got = ENCODER.texts(["", t, "x"])
    assert got[1] == FRESH.encode(t, add_special_tokens=False).ids and got[0] == [] and got[2] == FRESH.encode("x").ids


def test_other_tokenizers_get_texts_whole():
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_str(SPEC)
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    e = Encoder(other.to_str())
    assert not e.cuts and ENCODER.cuts
    assert e.texts(["in 1999", "", "a\0b"]) == [other.encode(t, add_special_tokens=False).ids for t in ("in 1999", "", "a\0b")]


def test_files_of_odd_rows(spark, tmp_path):
    rows = odd_texts() + [(4, PROSE), (30, "<|endoftext|> 's x"), (-3, "minus")]
    d = docs(spark, rows).withColumn("ids", F.lit(1)).repartition(5)
    tf.write_tokens(d, str(tmp_path / "f"), tf.default_tokenizer(), block_tokens=500)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tf.read_digests(spark, str(tmp_path / "f")).collect()))
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ENCODER.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i is not None, i or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    lists = {r.doc_id: r.ids for r in tf.read_tokens(spark, str(tmp_path / "f")).collect()}
    assert lists[1] == [0] and lists[30][-1] == 0
    assert spark.read.parquet(str(tmp_path / "f" / "blocks")).count() > 2


@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "|>", "hello", "a", ",", "|", " ", "  ", "\n"]), max_size=8).map("".join), max_size=6))
@example(["hello <|endoftext|> world"])
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_an_untouched_tokenizer(texts):
    assert ENCODER.texts(texts) == [FRESH.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_with_blanks():
    fresh = Tokenizer.from_str(SPEC)
    fresh.add_tokens(["two words"])
    texts = ["two", "words", "the two words", "two\nwords", "a two words\nb"]
    assert Encoder(fresh.to_str()).texts(texts) == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_of_texts_with_added_tokens(spark, tmp_path):
    rows = [(1, "hello <|endoftext|> world"), (2, "<|endoftext|>"), (3, PROSE)]
    tf.write_tokens(docs(spark, rows), str(tmp_path / "a"), tf.default_tokenizer())
    want = {i: [*FRESH.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    got = {r.doc_id: r for r in tf.read_tokens(spark, str(tmp_path / "a")).collect()}
    assert {i: r.ids for i, r in got.items()} == want and want[1] == [31373, 220, 50256, 995, 0]
    assert [got[i].start for i in (1, 2, 3)] == [0, len(want[1]), len(want[1]) + len(want[2])]


def test_a_whole_table_has_the_librarys_ids(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tf.write_tokens(d.repartition(7), str(tmp_path / "w"), tf.default_tokenizer())
    at, want = 0, []
    for i, t in sorted((r.doc_id, r.text) for r in d.collect()):
        ids = [*FRESH.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tf.read_digests(spark, str(tmp_path / "w")).collect())) == want


def test_spans_are_decoded_from_checkpoints(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "LANES", 16)
    monkeypatch.setattr(tf, "CHECKPOINT", 8)
    rows = [(k, f"{PROSE} {k} {PROSE}") for k in range(40)] + [(40, "long " * 3000)]
    tf.write_tokens(docs(spark, rows).repartition(3), str(tmp_path / "s"), tf.default_tokenizer(), block_tokens=700)
    stream = [x for _, t in rows for x in [*FRESH.encode(t, add_special_tokens=False).ids, 0]]
    for first, stop in ((0, len(stream)), (100, 101), (127, 900), (len(stream) - 5, len(stream) + 9), (5, 5)):
        got = sorted(tf.read_span(spark, str(tmp_path / "s"), first, stop).collect())
        assert [x for r in got for x in r.ids] == stream[first:stop]
    assert len(tf.read_span(spark, str(tmp_path / "s"), 0, len(stream)).collect()) > 20


def test_a_hot_doc_id_is_dealt_to_many_tasks(spark, tmp_path):
    rows = [(7, f"{PROSE} {k % 50}") for k in range(400)] + [(k, PROSE) for k in range(3)]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tf.write_tokens(docs(spark, rows).repartition(4), str(tmp_path / "h"), tf.default_tokenizer())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    blocks = spark.read.parquet(str(tmp_path / "h" / "blocks"))
    assert blocks.select("shard").distinct().count() > 3
    got = sorted((r.start, r.n_tokens) for r in tf.read_digests(spark, str(tmp_path / "h")).collect())
    assert len(got) == 403 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_no_rows(spark, tmp_path):
    tf.write_tokens(docs(spark, []), str(tmp_path / "e"), tf.default_tokenizer())
    assert tf.read_digests(spark, str(tmp_path / "e")).count() == 0

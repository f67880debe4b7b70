"""Token counts by byte-pair merging (operator 13): how many tokens a text has, without making them.

The symbols of a piece of text (its characters) stand in a linked list, and a heap holds all adjacent
pairs that are in the vocabulary.  The pair of the lowest rank, the leftmost of equals, is
popped and merged, its two new neighbours are pushed, and so on; entries whose symbols have
changed since are skipped.  The count is the number of initial symbols minus that of merges: a
character that the vocabulary lacks is as many initial symbols as it has UTF-8 bytes, which never merge.
No identifier is looked up.

A merge never spans two characters that stand side by side in no entry of the vocabulary, so a text is
the sum of its pieces: a run of blank marks and what follows up to the next one or to the end of a word,
and every character that only ever stands alone.  A worker remembers the counts of short pieces, at most
twice REMEMBERED of them, so memory is bounded; a long piece is merged anew each time.  Documents aren't shuffled.

Defined results: null and empty texts have no bytes and no tokens; a text of blanks has those of
its blanks; repeated rows and null ids are counted row by row; an empty table gives none; other columns
are ignored, whatever their names.  Strings that look like begin, end or unknown marks are ordinary text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, only, table
from .hashing import kept

#: Tokens a document may have before it is over the limit.
LIMIT = 4096
#: Pieces whose counts a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 1 << 18, 64
#: Characters of a text that are cut into pieces at once.
AT_ONCE = 1 << 20
#: The mark that stands for a blank within the library's normalised texts.
MARK = "▁"


def vocabulary(model: bytes) -> dict[str, float]:
    """Piece -> rank, the lower the earlier it is merged, of a byte-pair model of sentencepiece with byte fallback.

    Begin, end, unknown and byte pieces aren't in it: texts never hold them.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    ids = range(sp.get_piece_size())
    if sum(map(sp.is_byte, ids)) != 256:
        raise ValueError("the model has no byte fallback")
    special = {i for i in ids if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    return {sp.id_to_piece(i): -sp.get_score(i) for i in ids if i not in special}


class Counts(dict):
    """piece -> its count, made when it is first asked for.

    Of short pieces the counts of the last REMEMBERED to twice as many that were new or used are kept.
    """

    def __init__(self, make: Callable[[str], int]):
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = self.make(piece)
            if len(piece) > LONGEST:
                return n
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = n
        return n


class TokenCounter:
    """count(text): the tokens of a text, as the library would give them."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.normalize = SentencePieceProcessor(model_proto=model).normalize
        self.rank = vocabulary(model)
        beside = {ab for p in self.rank for ab in zip(p, p[1:])}
        joined = {c for ab in beside for c in ab} - {MARK}
        words = {c for c in joined if c.isalpha()}
        word, other = ("".join(map(re.escape, sorted(x))) or MARK for x in (words, joined - words))
        # Borders that no entry spans: before a blank mark, and between a letter and what is none.
        if any(b == MARK != a for a, b in beside):
            self.pieces, self.border = re.compile(f"[{MARK}{word}{other}]+|.", re.S), None
        else:
            parted = not any(a in words and b not in words for a, b in beside)
            self.pieces = re.compile(f"{MARK}*[{other}]*[{word}]+|{MARK}*[{other}]+|{MARK}+|." if parted else f"{MARK}*[{word}{other}]+|{MARK}+|.", re.S)
            self.border = re.compile(f"[^{MARK}]{MARK}")
        self.known = Counts(self.merged)

    def merged(self, piece: str) -> int:
        """Initial symbols minus merges of one piece."""
        rank, n = self.rank, len(piece)
        symbol: list[str | None] = list(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, 2) for k in range(n - 1) if (r := rank.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, k, size = heapq.heappop(heap)
            left, m = symbol[k], after[k]
            if left is None or m >= n or len(left) + len(symbol[m]) != size:
                continue  # one of the two has merged since
            both = symbol[k] = left + symbol[m]
            symbol[m] = None
            merges += 1
            far = after[k] = after[m]
            if far < n:
                before[far] = k
                if (r := rank.get(both + symbol[far])) is not None:
                    heapq.heappush(heap, (r, k, len(both) + len(symbol[far])))
            if (near := before[k]) >= 0 and (r := rank.get(symbol[near] + both)) is not None:
                heapq.heappush(heap, (r, near, len(symbol[near]) + len(both)))
        return sum(1 if c in rank else len(c.encode()) for c in piece) - merges

    def parts(self, text: str) -> Iterator[str]:
        """text in stretches of some AT_ONCE characters that end where a piece does."""
        at = 0
        while len(text) - at > AT_ONCE and self.border and (m := self.border.search(text, at + AT_ONCE)):
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:] if at else text

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(sum(map(self.known.__getitem__, self.pieces.findall(part))) for part in self.parts(self.normalize(text)))


def shared(model: bytes) -> TokenCounter:
    """The process's counter for a model: a worker's later tasks of one stage find what the earlier ones have counted."""
    have = kept()
    if have.get("counter", (None,))[0] != model:
        have["counter"] = (model, TokenCounter(model))
    return have["counter"][1]


def count_tokens(docs: DataFrame, model_file: str, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    model_file: a byte-pair model of sentencepiece with byte fallback, read by the driver and sent to the tasks.
    """
    with open(model_file, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = shared(model).count
            n = [count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    t = only(docs, "doc_id", "text").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    kind = t.schema["doc_id"].dataType.simpleString()
    return t.mapInArrow(lean(run, holds="counter"), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_model())

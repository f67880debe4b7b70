"""Token ids of many texts at once: each distinct pre-token goes to the tokenizer once.

For byte-level BPE whose pre-tokens follow the usual pattern (contractions, letters, digits,
marks, each with at most one space before it, and blanks), texts are cut where a pre-token
must end, all in numpy over UTF-8 bytes:

* before a run of ASCII blanks, and before the run's last blank where text follows it;
* after a blank other than a space;
* between a letter, a digit and a mark, of ASCII or Latin-1 letters, but not after an
  apostrophe, which may be a contraction's.

So a piece is one or more whole pre-tokens, and the ids of a text are those of its pieces.
Pieces of up to PIECE bytes are looked up in a hash table and compared byte by byte; what
isn't found is encoded by the tokenizer.  Texts that hold other blanks or an added token go to the
tokenizer whole, as does everything if the tokenizer's settings are others than these.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .hashing import U, kept, mix64

#: Bytes of a piece that may be remembered, in words of 8.
WORDS = 4
PIECE = 8 * WORDS
#: Pieces remembered before an encoder starts afresh (a table of 1 << SLOT_BITS slots).
CAPACITY, SLOT_BITS = 3 << 18, 21
#: Bytes cut at once, bytes searched for a place to cut a longer text, and pieces encoded at once.
AT_ONCE, LOOK, JOIN = 1 << 20, 1 << 16, 1 << 12

_OTHER, _LETTER, _DIGIT, _MARK, _SPACE, _BLANK, _ODD = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[:0x80] = _MARK
_CLASS[:0x20] = _ODD
_CLASS[0x09:0x0E] = _BLANK
_CLASS[0x20] = _SPACE
_CLASS[[c for c in range(0x80) if chr(c).isalpha()]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODDS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)]


def regular(spec: dict) -> bool:
    """Whether texts may be cut as the module says: a byte-level BPE with the pattern it has by default."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    unset = all(spec.get(k) is None for k in ("normalizer", "truncation", "padding"))
    return bool(plain and unset and (spec.get("model") or {}).get("type") == "BPE" and not spec["model"].get("dropout"))


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all, one after the other."""
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - size), size) + np.arange(n)]


class Encoder:
    """encode(data, offsets): ids and their number for each text, those of the tokenizer with its default settings."""

    def __init__(self, spec: str):
        # A task has one core; threads of the library would each hold memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.vocab = self.tokenizer.get_vocab_size()
        self.width = "<u2" if self.vocab <= 1 << 16 else "<u4"
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        line = self._ids("\n")
        self.line = line[0] if len(line) == 1 else None
        self.cuts = regular(json.loads(spec)) and self.line is not None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.n, self.used = 0, 0
        # Of the size they may reach: pages that aren't written take no memory, and nothing is copied to grow.
        self.piece = np.zeros((CAPACITY, WORDS), np.uint64)
        self.start, self.size = np.zeros(CAPACITY, np.int32), np.zeros(CAPACITY, np.uint8)  # a piece has no more ids than bytes
        self.ids = np.zeros(1 << 18, self.width)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        pos = (h >> U(64 - SLOT_BITS)).astype(np.int64)
        live = np.arange(len(h))
        while len(live):
            k = self.keys[pos]
            hit = k == h
            out[live[hit]] = self.at[pos[hit]]
            go = ~hit & (k != 0)
            live, h, pos = live[go], h[go], (pos[go] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _add(self, h: np.ndarray, piece: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New entries with distinct hashes."""
        n = self.n + len(h)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        entry = np.arange(self.n, n)
        self.piece[entry], self.size[entry] = piece, size
        self.start[entry] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = n, self.used + len(ids)
        pos = (h >> U(64 - SLOT_BITS)).astype(np.int64)
        while len(h):
            free = self.keys[pos] == 0
            self.keys[pos[free]] = h[free]  # of several for one slot, one stays
            mine = self.keys[pos] == h
            self.at[pos[mine]] = entry[mine]
            h, entry, pos = h[~mine], entry[~mine], (pos[~mine] + 1) & ((1 << SLOT_BITS) - 1)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of texts as they are."""
        got = [self._ids(t) for t in texts]
        return np.concatenate([*got, np.zeros(0, self.width)]).astype(self.width), np.array([len(g) for g in got], np.int64)

    def _pieces(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of the pieces data[start : start + size]: joined by newlines, which are a pre-token and an id of their own.  Blanks stand alone."""
        kind = _CLASS[data[start + size - 1]]
        blank = (kind == _SPACE) | (kind == _BLANK)  # a piece that ends in a blank is one of blanks
        plain = np.flatnonzero(~blank)
        out, sizes = [], np.zeros(len(start), np.int64)
        for lo in range(0, len(plain), JOIN):
            part = plain[lo : lo + JOIN]
            text = gather(data, start[part], size[part] + 1)
            text[np.cumsum(size[part] + 1) - 1] = 10
            ids = self._ids(text[:-1].tobytes().decode())
            stops = np.flatnonzero(ids == self.line)
            sizes[part] = np.diff(np.r_[-1, stops, len(ids)]) - 1
            out.append(np.delete(ids, stops))
        flat = np.concatenate([*out, np.zeros(0, self.width)]).astype(self.width)
        if blank.any():
            alone = [self._ids(data[a : a + n].tobytes().decode()) for a, n in zip(start[blank].tolist(), size[blank].tolist(), strict=True)]
            ends = np.cumsum(sizes)
            sizes[blank] = [len(x) for x in alone]
            flat = np.insert(flat, np.repeat(ends[blank], sizes[blank]), np.concatenate(alone))
        return flat, sizes

    def _odd_texts(self, raw: bytes, data: np.ndarray, cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Indices of texts with blanks beyond ASCII, control characters or added tokens."""
        at = [np.flatnonzero(cls[: len(raw)] == _ODD)]
        lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
        a, b, c = data[lead], data[lead + 1], data[lead + 2]
        e2 = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        other = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        at.append(lead[e2 | other])
        for t in self.added:
            k = raw.find(t)
            while k >= 0:
                at.append(np.array([k]))
                k = raw.find(t, k + 1)
        return np.unique(np.searchsorted(starts, np.concatenate(at), side="right") - 1)

    def _batch(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        if not n:
            return np.zeros(0, self.width), np.zeros(len(sizes), np.int64)
        data = np.frombuffer(raw + b"\0" * (PIECE + 8), np.uint8)
        begin = np.cumsum(sizes) - sizes
        some = np.flatnonzero(sizes)  # texts that aren't empty
        cls = _CLASS[data]
        latin = np.flatnonzero(data == 0xC3)
        latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
        cls[latin] = cls[latin + 1] = _LETTER
        odd = some[self._odd_texts(raw, data, cls, begin[some])]
        first = np.zeros(n + 1, bool)
        first[begin[some]] = True
        x, y = cls[: n - 1], cls[1:n]
        blank = (cls == _SPACE) | (cls == _BLANK)
        into = blank[1:n] & ~blank[: n - 1]
        # The last blank of a run that text follows within its document.
        last = blank[1:n] & blank[: n - 1] & ~blank[2 : n + 1] & ~first[2 : n + 1]
        last[-1:] = False
        after = (x == _BLANK) & ~blank[1:n]
        change = (x != y) & (x >= _LETTER) & (x <= _MARK) & (y >= _LETTER) & (y <= _MARK) & (data[: n - 1] != 0x27)
        first[1:n] |= into | last | after | change
        first[n] = False
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, n])
        text = np.searchsorted(begin[some], start, side="right") - 1
        text = some[text]
        if len(odd):
            out = np.zeros(len(sizes), bool)
            out[odd] = True
            keep = ~out[text]
            start, size, text = start[keep], size[keep], text[keep]
        words = np.ndarray((n + PIECE + 1,), "<u8", data, 0, (1,))
        piece = np.zeros((len(start), WORDS), np.uint64)
        h = size.astype(np.uint64) * U(0xD6E8FEB86659FD93)
        for j in range(WORDS):
            k = np.flatnonzero(size > 8 * j) if j else slice(None)
            piece[k, j] = words[start[k] + 8 * j] & _MASK[np.minimum(size[k] - 8 * j, 8)]
            h[k] ^= mix64(piece[k, j] + _ODDS[j])
            h[k] *= _ODDS[j]
        h |= U(1)
        long = size > PIECE
        entry = self._find(h)
        entry[long] = -1
        miss = np.flatnonzero((entry < 0) & ~long)
        if len(miss):
            _, which = np.unique(h[miss], return_index=True)
            new = miss[which]
            if self.n + len(new) > CAPACITY:
                self._forget()
                entry = np.full(len(h), -1, np.int64)
                miss = np.flatnonzero(~long)
                _, which = np.unique(h[miss], return_index=True)
                new = miss[which][:CAPACITY]
            ids, counts = self._pieces(data, start[new], size[new])
            self._add(h[new], piece[new], ids, counts)
            entry[miss] = self._find(h[miss])
        # Two pieces with one hash: the entry is another piece's.
        wrong = np.flatnonzero(entry >= 0)
        wrong = wrong[(self.piece[entry[wrong], 0] != piece[wrong, 0])]
        for j in range(1, WORDS):
            k = np.flatnonzero((size > 8 * (j - 1)) & (entry >= 0))
            wrong = np.union1d(wrong, k[self.piece[entry[k], j] != piece[k, j]])
        direct = np.union1d(np.flatnonzero(entry < 0), wrong)
        entry = np.maximum(entry, 0)
        begin_id, count = self.start[entry].astype(np.int64), self.size[entry].astype(np.int64)
        pool, at = [self.ids[: self.used]], self.used
        if len(direct):
            ids, counts = self._pieces(data, start[direct], size[direct])
            begin_id[direct], count[direct] = at + np.cumsum(counts) - counts, counts
            pool.append(ids)
            at += len(ids)
        if len(odd):
            ids, counts = self._whole([raw[a:z].decode() for a, z in zip(begin[odd].tolist(), (begin[odd] + sizes[odd]).tolist(), strict=True)])
            # They stand among the other texts' pieces as one piece each.
            k = np.searchsorted(text, odd)
            begin_id, count, text = np.insert(begin_id, k, at + np.cumsum(counts) - counts), np.insert(count, k, counts), np.insert(text, k, odd)
            pool.append(ids)
        flat = gather(np.concatenate(pool) if len(pool) > 1 else pool[0], begin_id, count)
        return flat, np.bincount(text, count, len(sizes)).astype(np.int64)

    def _parted(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, first part of each text) with texts over AT_ONCE bytes cut, where they can be, before a space between letters or digits of ASCII."""
        out, first = [], []
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            first.append(len(out))
            out.append(a)
            at = a + AT_ONCE
            while at < z - 2:
                near = data[at : min(z, at + LOOK)]
                word = (_CLASS[near] == _LETTER) | (_CLASS[near] == _DIGIT)
                cut = np.flatnonzero(word[:-2] & (near[1:-1] == 0x20) & word[2:])
                if len(cut):
                    out.append(at + int(cut[0]) + 1)
                    at = out[-1] + AT_ONCE
                else:
                    at += LOOK - 2
        return np.array([*out, int(offsets[-1])], np.int64), np.array(first, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each) of the UTF-8 texts data[offsets[k] : offsets[k + 1]]."""
        sizes = np.diff(offsets).astype(np.int64)
        if not self.cuts:
            raw = data.tobytes()
            return self._whole([raw[a:z].decode() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        if len(sizes) and sizes.max() > AT_ONCE and not any(b" " in t for t in self.added):
            parts, first = self._parted(data, offsets)
            ids, n = self._texts(data, parts, np.diff(parts))
            return ids, np.add.reduceat(n, first)
        return self._texts(data, offsets, sizes)

    def _texts(self, data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, counts, k = [], [], 0
        while k < len(sizes):
            z = max(k + 1, int(np.searchsorted(offsets, offsets[k] + AT_ONCE, side="right")) - 1)
            ids, n = self._batch(data[offsets[k] : offsets[z]].tobytes(), sizes[k:z])
            flat.append(ids)
            counts.append(n)
            k = z
        return np.concatenate([*flat, np.zeros(0, self.width)]).astype(self.width), np.concatenate([*counts, np.zeros(0, np.int64)])

    def texts(self, texts: list[str]) -> list[list[int]]:
        raw = [t.encode() for t in texts]
        ids, n = self.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        ends = np.cumsum(n)
        return [ids[z - k : z].tolist() for z, k in zip(ends.tolist(), n.tolist(), strict=True)]


def shared(spec: str) -> Encoder:
    """The process's encoder for spec: a worker's later tasks of one stage find what the earlier ones have encoded."""
    have = kept()
    if have.get("encoder", (None,))[0] != spec:
        have["encoder"] = (spec, Encoder(spec))
    return have["encoder"][1]

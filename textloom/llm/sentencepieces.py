"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (a run of marks U+2581 and what follows up to the next mark), which no piece crosses. The
distinct words that a batch adds are sorted, so that walking along them is a depth-first walk of their trie: the forward
states of the prefix that a word shares with the one before are kept, and only the rest is computed.

The forward state of a prefix depends on the model. Unigram: the best sum of piece scores and its last piece. BPE: the last
piece of the prefix's encoding. There merging decides instead of a sum, but a sequence of pieces is what merging gives if
and only if each neighbouring pair is (merging their joined text gives back the pair), so exactly one piece can end a
prefix: the one that forms such a pair with the last piece of the prefix before it. Scores of the plain Viterbi kind would
give other segmentations than a BPE model's own.

Unknown characters fall back to bytes where the model has byte pieces. Null texts are empty and have no ids; empty ids
decode to an empty text; rows may repeat and ids of rows may be null.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .stats import map_text

MARK, MEMO_WORDS, MEMO_PAIRS = "▁", 400_000, 1_000_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protocol buffer."""

    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            x |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return x, i

    i = 0
    while i < len(b):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Model:
    """Pieces of a SentencePiece model file; the normaliser must be the identity, with or without a leading mark."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.unknown, self.dummy = UNIGRAM, 0, True
        extra, charsmap, escape = True, b"", True
        with open(path, "rb") as f:
            content = f.read()
        for field, value in _fields(content):
            if field == 1:
                got = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                self.pieces.append(got[1].decode())
                self.scores.append(struct.unpack("<f", got[2])[0])
                self.kinds.append(got[3])
            elif field == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                got = dict(_fields(value))
                charsmap, self.dummy, extra, escape = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
        if charsmap or extra or not escape or self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with an identity normaliser are supported")
        if any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds) if k == NORMAL) or USER in self.kinds:
            raise ValueError("a piece crosses words")
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.bytes = [-1] * 256
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == BYTE:
                self.bytes[int(p[3:-1], 16)] = i
        self.longest = max(map(len, self.ids), default=1)
        self.least = min(self.scores, default=0.0) - 10.0

    def spell(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        got = [self.bytes[x] for x in char.encode()]
        return got if -1 not in got else [self.unknown]


class Encoder:
    def __init__(self, path: str):
        self.model = model = Model(path)
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        # pieces by their characters from the last to the first: each step leads to (further steps, id or -1)
        self.back: dict[str, tuple[dict, int]] = {}
        for piece, k in model.ids.items():
            node = self.back
            for c in reversed(piece[1:]):
                node = node.setdefault(c, ({}, -1))[0]
            node[piece[0]] = (node.get(piece[0], ({}, -1))[0], k)
        # what no longer piece holds parts words as well
        inner = {c for p in model.ids if len(p) > 1 for c in p}
        apart = "".join(c for c in "\t\n\r" if c not in inner)
        self.cut = re.compile(f"{MARK}*[^{MARK}{apart}]+|{MARK}+" + (f"|[{apart}]" if apart else "")).findall

    def merged(self, text: str) -> list[str]:
        """The BPE segmentation by merging: the neighbours whose joined piece has the best score, leftmost first."""
        get, scores = self.model.ids.get, self.model.scores
        parts = list(text)
        ranks = [get(a + b, -1) for a, b in zip(parts, parts[1:])]
        while ranks:
            best, at = None, -1
            for i, k in enumerate(ranks):
                if k >= 0 and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], -1)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], -1)
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a and b as they are; a = -1: b at the start."""
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        pieces = self.model.pieces
        want = [pieces[b]] if a < 0 else [pieces[a], pieces[b]]
        got = self.pairs[a << 24 | b] = self.merged("".join(want)) == want
        return got

    def learn(self, words: list[str]) -> None:
        """Encodes the words, sorted: each takes over the forward states of the prefix it shares with the last."""
        if self.model.type == BPE:
            states = self._merging
        else:
            states = self._summing
        last: list[int] = [-1]  # by prefix length: id of its last piece, -2 for a character without one
        start: list[int] = [0]  # where that begins
        total: list[float] = [0.0]  # and the score so far
        before, spell, memo = "", self.model.spell, self.memo
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :], total[shared + 1 :]
            states(word, shared, last, start, total)
            out: list[int] = []
            end = n
            while end:
                k = last[end]
                if k >= 0:
                    out.append(k)
                else:
                    out += reversed(spell(word[end - 1]))
                end = start[end]
            out.reverse()
            memo[word] = struct.pack(f"<{len(out)}I", *out)
            before = word

    def _merging(self, word: str, shared: int, last: list[int], start: list[int], total: list[float]) -> None:
        back, pairs = self.back, self.pairs
        for end in range(shared + 1, len(word) + 1):
            node, i, choice, begin = back, end, -2, end - 1
            while i:
                step = node.get(word[i - 1])
                if step is None:
                    break
                node, k = step
                i -= 1
                if k >= 0:
                    p = last[i]
                    ok = True if p == -2 else pairs.get(p << 24 | k)
                    if ok is None:
                        ok = self.follows(p, k)
                    if ok:
                        choice, begin = k, i
                        break
            last.append(choice)
            start.append(begin)

    def _summing(self, word: str, shared: int, last: list[int], start: list[int], total: list[float]) -> None:
        back, scores, least = self.back, self.model.scores, self.model.least
        for end in range(shared + 1, len(word) + 1):
            node, i, choice, begin, best = back, end, -2, end - 1, total[end - 1] + least
            if word[end - 1] in self.model.ids:
                best = -math.inf
            while i:
                step = node.get(word[i - 1])
                if step is None:
                    break
                node, k = step
                i -= 1
                if k >= 0 and total[i] + scores[k] > best:
                    choice, begin, best = k, i, total[i] + scores[k]
            last.append(choice)
            start.append(begin)
            total.append(best)

    def encode(self, texts: list[str]) -> list[bytes]:
        mark = MARK if self.model.dummy else ""
        cut = [self.cut((mark if text else "") + text.replace(" ", MARK)) for text in texts]
        new = set().union(*cut) if cut else set()
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
        self.learn(list(new - self.memo.keys()))
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) for words in cut]


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    """A worker keeps what it has learned from task to task."""
    return Encoder(path)


class Decoder:
    def __init__(self, path: str):
        model = Model(path)
        self.dummy = model.dummy
        self.bytes = [
            bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()
            for p, k in zip(model.pieces, model.kinds)
        ]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the ids of each whole text, as little-endian 32-bit integers."""

    def make(column: pa.Array) -> list[pa.Array]:
        return [pa.array(_encoder(path).encode([x or "" for x in column.to_pylist()]), pa.binary())]

    return map_text(docs, text, keep or ["doc_id"], make, "ids binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the text of each row's ids."""
    decoders: list[Decoder] = []

    def make(column: pa.Array) -> list[pa.Array]:
        if not decoders:
            decoders.append(Decoder(path))
        return [pa.array([decoders[0].decode(x or b"") for x in column.to_pylist()], pa.string())]

    return map_text(encoded, ids, keep or ["doc_id"], make, "decoded string")

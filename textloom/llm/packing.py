"""Packing of documents into token sequences of balanced attention cost.

A document's ids end with id 0. Full pieces of ``size`` ids are sequences of their own. The rest of each document waits in
a shard (what one task holds, ``SHARD_TOKENS`` at most); a shard opens as few sequences as its ids need and gives its
pieces out by descending cost, ``l + l * l / size``, each to the sequence of least cost that has room for it. Only where
none has room for the whole piece is it cut, to fill the one with most room. So a shard's padding is less than a sequence.

Ids are those of the ``tokenizers`` library with the same file: its vocabulary runs in tiktoken, which merges in the same
order at a quarter of the time (the tests compare the two), and texts that tiktoken can't split (very long white space) go
to the library itself. With ``added_tokens``, the file's added tokens inside a text have their own ids, as they have in the
library unless it is told otherwise; without, they are ordinary text. Null texts are empty and consist of id 0; ids may be
null or repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

SIZE, SHARD_TOKENS = 1024, 4_000_000


class Ids:
    """Ids of texts as little-endian 32-bit bytes, by the vocabulary of a byte-level BPE file."""

    def __init__(self, path: str, added_tokens: bool = False):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        # a byte is written as itself where it is printable, else as a character from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocab, merges = model["vocab"], model["merges"]
        joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if joined != sorted(joined):
            raise ValueError("ids don't follow the order of merges")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and (len(t) == 1 or i >= joined[0])}
        ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i <= joined[-1]}
        self.path, self.library = path, None
        self.added = {t["content"]: t["id"] for t in whole.get("added_tokens", [])} if added_tokens else {}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)

    def ids(self, text: str) -> bytes:
        try:
            found = self.encoding.encode_to_numpy(text, allowed_special=set(self.added), disallowed_special=())
        except BaseException as e:  # the splitting expression gives up on very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            found = np.array(self._library().encode(text, add_special_tokens=False).ids)
        return found.astype("<u4").tobytes()

    def _library(self):
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = not self.added
        return self.library


def cost(length: int, size: int = SIZE) -> float:
    return length + length * length / size


def assign(lengths: list[int], size: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start within it, length), each of at most ``size`` ids."""
    total = sum(lengths)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(-(-total // size))]
    room, spent = np.full(len(out), size), np.zeros(len(out))
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = np.flatnonzero(room >= left)
            at = int(fits[spent[fits].argmin()] if len(fits) else room.argmax())
            take = min(left, int(room[at]))
            out[at].append((item, start, take))
            room[at] -= take
            spent[at] += cost(take, size)
            start, left = start + take, left - take
    return out


def pack(docs: DataFrame, path: str, text: str = "text", ids: str = "doc_id", size: int = SIZE, end: int = 0, added_tokens: bool = False) -> DataFrame:
    """Per piece: the document's id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[ids]
    names = [ids, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = Ids(path, added_tokens).ids, np.array([end], "<u4").tobytes()
        # sequences of a task are numbered within its partition, so a task that runs again numbers them alike
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = 0
        id_type = None

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
            rows.clear()
            return batch

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            for pieces in assign([len(w[2]) // 4 for w in waiting], size):
                at = 0
                for item, start, length in pieces:
                    doc, first, data, n = waiting[item]
                    rows.append((doc, first + start, length, data[4 * start : 4 * (start + length)], n, sequence, at))
                    at += length
                sequence += 1
                if len(rows) >= 4000:
                    yield out()
            waiting.clear()
            held = 0

        for batch in batches:
            id_type = batch.column(0).type
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = ids_of(value or "") + last
                n = len(data) // 4
                full = n - n % size
                for start in range(0, full, size):
                    rows.append((doc, start, size, data[4 * start : 4 * (start + size)], n, sequence, 0))
                    sequence += 1
                if full < n:
                    waiting.append((doc, full, data[4 * full :], n))
                    held += n - full
                if len(rows) >= 1000:
                    yield out()
                if held >= SHARD_TOKENS:
                    yield from settle()
        yield from settle()
        if rows:
            yield out()

    schema = f"`{ids}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(f"`{ids}`"), F.col(f"`{text}`")).mapInArrow(run, schema)

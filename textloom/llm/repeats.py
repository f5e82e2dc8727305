"""Removal of long repeated byte strings, by difference-cover samples settled block by block.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus.

1. Sample. A difference cover D modulo v has, for any two positions p and q, an offset d < v with p + d and q + d both
   in D. Two equal strings of ``length`` bytes therefore hold equal windows of ``length - v + 1`` bytes that start at
   sampled positions. Only these windows (|D| / v of all positions) are hashed and dealt into blocks by hash; a block is
   sorted alone, and gives the samples whose rank is shared.
2. Ties. Only positions less than v before a shared sample can start a repeated string. Texts are cut down to the stretches
   of such positions, and their whole strings are hashed again, to ``STRING_BYTES`` bytes (86 bits of three polynomials over a prime field), and dealt into blocks; sorting a
   block settles which are repeated.
3. Removal. Each text meets its repeated positions again, and the bytes they cover are cut.

Blocks are ranges of hashes, not of suffixes: a suffix bucket would have to hold 200 bytes for each of its positions, or
the text around each of its samples, and a bucket of a passage that a third of all texts share can't be split by order.
With n different strings about n**2 / 2**87 pairs are taken for equal by mistake: 1e-7 at 30 GB, five at 100 TB.

Rows travel as packed arrays, a few bytes for each position. Equal texts count as one in steps 1 and 2 (a text that
occurs twice is repeated as a whole; texts with one key are held against each other by 240 bits of SHA-256, and keys are
drawn anew if two texts share one), and a mapper sends a window that it holds several times only once, so a passage in
a third of all texts is no hot key. Memory: one flush of ``FLUSH`` bytes in a mapper, one block in a reducer; there is a
block for each ``BLOCK_BYTES`` of all texts, so a block doesn't grow with the corpus.

Null texts are empty. Rows that are equal in id and text get equal results; ids may be null or repeated; an empty table
gives an empty result; columns other than the id and the text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import CHUNK, U64, Rolling, buffers, mix, planes, unplanes
from .scratch import Scratch, free_shuffles, shuffle_partitions, small_batches

#: Perfect difference sets: every difference modulo v occurs exactly once.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (0, 1, 3, 15, 46, 71, 75, 84, 94, 101, 112, 128),
}
FLUSH = 16 << 20
FLUSH_POSITIONS = 1_500_000
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20
#: Hash bytes of a whole string, of which ``CHECK_BYTES`` are those of a polynomial of their own.
STRING_BYTES, CHECK_BYTES = 11, 3
_PACKED = "block int, hashes binary, keys binary, counts binary, deltas binary, width int"
_FOUND = "bucket int, keys binary, counts binary, deltas binary"
_POSITIONS = "key long, deltas binary"


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The longest cover period that leaves a window of a quarter of the length."""
    v = max((v for v in COVERS if length - v + 1 >= max(1, length // 4)), default=0)
    return (v, np.array(COVERS[v])) if v else (1, np.array([0]))


def _deltas(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    d = np.diff(at, prepend=0)
    d[first] = at[first]
    return d


def _runs(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct positions by key: keys, how many each has, and the deltas of all."""
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    key, pos = key[keep], pos[keep]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key))), _deltas(pos, first)


def _flat(keys: bytes, counts: bytes, deltas: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of packed runs."""
    count = unplanes(counts, 4).astype(np.int64)
    d = unplanes(deltas, 4).astype(np.int64)
    total = np.cumsum(d)
    first = np.cumsum(count) - count
    total -= np.repeat(total[first] - d[first], count)
    return np.repeat(np.frombuffer(keys, np.int64), count), total


def _by_bucket(key: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """The positions packed in one row for each bucket of keys."""
    k, n, d = _runs(key, pos)
    bucket = (mix(k.view(U64)) % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    start = np.cumsum(n) - n
    at = np.arange(len(d)) - np.repeat(start - (np.cumsum(n[order]) - n[order])[np.argsort(order)], n)
    moved = np.empty_like(d)
    moved[at] = d
    k, n, bucket = k[order], n[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(k) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    for i, j in zip(cut.tolist(), np.append(cut[1:], len(k)).tolist()):
        yield int(bucket[i]), k[i:j].tobytes(), planes(n[i:j], 4), planes(moved[ends[i] : ends[j]], 4)


def decode(deltas: bytes | None) -> np.ndarray:
    """The ascending positions of one key."""
    return np.cumsum(unplanes(deltas, 4).astype(np.int64)) if deltas else np.zeros(0, np.int64)


def _grouped(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal hashes stand together, and where in it another hash than the one before begins."""
    order = np.argsort(h, kind="stable")
    a, c = h[order], check[order]
    new = np.concatenate([[True], a[1:] != a[:-1]])
    if len(a) and (~new & np.concatenate([[False], c[1:] != c[:-1]])).any():
        order = np.lexsort((check, h))
        a, c = h[order], check[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    return order, new


class _Packer:
    """Gathers (hash, check, key, position) and gives rows for blocks, with what repeats within the flush settled at once."""

    def __init__(self, blocks: int, buckets: int, width: int):
        self.blocks, self.buckets, self.width = blocks, buckets, width
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, h: np.ndarray, key: np.ndarray, pos: np.ndarray, check: np.ndarray | None = None) -> None:
        if len(h):
            self.parts.append((h, np.zeros(len(h), np.uint32) if check is None else check, key, pos))
            self.n += len(h)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, check, key, pos = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.n = [], 0
        order, new = _grouped(h, check)
        h, check, key, pos = h[order], check[order], key[order], pos[order]
        del order
        shared = ~new
        shared[:-1] |= ~new[1:]
        out: list[tuple] = []
        if shared.any():
            # those found here travel with the block of their keys' number, as rows without hashes
            out += [(b, None, k, n, d, 0) for b, k, n, d in _by_bucket(key[shared], pos[shared], self.buckets)]
        h, check, key, pos = h[new], check[new], key[new], pos[new]
        block = (mix(h) % U64(self.blocks)).astype(np.int32)
        order = np.lexsort((pos, key, block))
        h, check, key, pos, block = h[order], check[order], key[order], pos[order], block[order]
        run = np.concatenate([[True], (block[1:] != block[:-1]) | (key[1:] != key[:-1])])
        first = np.flatnonzero(run)
        d = _deltas(pos, first)
        count = np.diff(np.append(first, len(h)))
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        plain = min(self.width, 8)
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(h)).tolist()):
            i, j = np.searchsorted(first, [a, b])
            hashes = planes(h[a:b], plain) + planes(check[a:b], self.width - plain)
            out.append((int(block[a]), hashes, key[first[i:j]].tobytes(), planes(count[i:j], 4), planes(d[a:b], 4), self.width))
        for i in range(0, len(out), 1000):
            cols = list(zip(*out[i : i + 1000]))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["block", "hashes", "keys", "counts", "deltas", "width"])


def _settle(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """One block: the (key, position) whose hash has another (key, position), packed by buckets of keys."""
        out = []
        names = ("block", "hashes", "keys", "counts", "deltas")
        width = max(table.column("width").to_pylist(), default=0)
        plain = min(width, 8)
        total = sum(len(x.as_buffer()) for x in table.column("hashes") if x.is_valid) // max(1, width)
        # filled row by row, so a block is held packed and unpacked, but not once more
        h, c, k, p, n = np.empty(total, U64), np.zeros(total, np.uint32), np.empty(total, np.int64), np.empty(total, np.int64), 0
        for block, hashes, *runs in zip(*(table.column(x) for x in names)):
            runs = [x.as_buffer() for x in runs]
            if not hashes.is_valid:
                out.append((block.as_py(), *(x.to_pybytes() for x in runs)))
                continue
            key, pos = _flat(*runs)
            m, packed = len(key), hashes.as_buffer()
            h[n : n + m], k[n : n + m], p[n : n + m] = unplanes(packed[: plain * m], plain), key, pos
            if width > plain:
                c[n : n + m] = unplanes(packed[plain * m :], width - plain)
            n += m
        if n:
            order, new = _grouped(h, c)
            k, p = k[order], p[order]
            del h, c, order
            first = np.flatnonzero(new)
            shared = np.zeros(len(first), bool)
            for x in (k, p):
                shared |= np.minimum.reduceat(x, first) != np.maximum.reduceat(x, first)
            shared = np.repeat(shared, np.diff(np.append(first, len(k))))
            out += _by_bucket(k[shared], p[shared], buckets)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kinds)], names=["bucket", "keys", "counts", "deltas"])

    return run


def _gather(table: pa.Table) -> pa.Table:
    """One bucket of keys: a row for each key with all its positions."""
    parts = [_flat(*x) for x in zip(*(table.column(c).to_pylist() for c in ("keys", "counts", "deltas")))]
    k, n, d = _runs(*(np.concatenate(x) for x in zip(*parts)))
    ends = np.concatenate([[0], np.cumsum(n)]).tolist()
    return pa.table({"key": pa.array(k, pa.int64()), "deltas": pa.array([planes(d[a:b], 4) for a, b in zip(ends, ends[1:])], pa.binary())})


def _sample(length: int, blocks: int, buckets: int, width: int):
    """Mapper of step 1: hashes of ``width`` bytes of the windows at sampled positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cover = cover_for(length)
        window, roll = length - v + 1, Rolling(11)
        packer, held, seen = _Packer(blocks, buckets, width), 0, set()
        low = U64(2 ** (8 * width) - 1)
        for batch in batches:
            data, off = buffers(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            size = np.diff(off)
            use = size >= length
            for i in np.flatnonzero(use).tolist():
                if keys[i] in seen:
                    use[i] = False
                seen.add(keys[i])
            docs = np.flatnonzero(use)
            # every sampled start of every text, in order of place
            rounds = -(-(size[docs] - window + 1) // v)
            doc = np.repeat(docs, rounds)
            turn = np.arange(len(doc)) - np.repeat(np.cumsum(rounds) - rounds, rounds)
            at = (turn * v)[:, None] + cover[None, :]
            fits = at + window <= size[doc][:, None]
            pos = at[fits]
            doc = np.repeat(doc, fits.sum(1))
            where = off[doc] + pos
            for a in range(0, len(data), CHUNK):
                i, j = np.searchsorted(where, [a, a + CHUNK])
                if i < j:
                    sums = roll.sums(data[a : a + CHUNK + window])
                    s = where[i:j] - a
                    packer.add(roll.windows(sums, s, s + window) & low, keys[doc[i:j]], pos[i:j])
            held += len(data)
            if held >= FLUSH:
                yield from packer.rows()
                held, seen = 0, set()
        yield from packer.rows()

    return run


def _may_start(n: int, shared: np.ndarray, length: int, v: int) -> np.ndarray:
    """The positions of a text of n bytes, less than v before a shared sample, at which a whole string can start."""
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.maximum(shared - v + 1, 0), 1)
    np.add.at(edge, shared + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, n - length + 1)] > 0)


def _segments(length: int):
    """Mapper before step 2: of each text only the stretches in which strings can start, and the shared samples that say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = cover_for(length)
        for batch in batches:
            data, off = buffers(batch.column("text"))
            keys = batch.column("key").to_pylist()
            out: list[tuple] = []
            for i, deltas in enumerate(batch.column("deltas").to_pylist()):
                text = data[off[i] : off[i + 1]]
                at = _may_start(len(text), decode(deltas), length, v)
                if len(at):
                    gap = np.flatnonzero(np.diff(at) > 1)
                    for a, b in zip(at[np.append(0, gap + 1)].tolist(), at[np.append(gap, len(at) - 1)].tolist()):
                        # every position of the stretch counts: samples so close that each is less than v before one
                        every = np.minimum(np.arange(v - 1, b - a + v, v), b - a)
                        out.append((keys[i], a, text[a : b + length].tobytes(), planes(np.diff(every, prepend=0), 4)))
            for i in range(0, max(1, len(out)), 2000):
                cols = list(zip(*out[i : i + 2000])) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "start", "text", "deltas"])

    return run


def _candidates(length: int, blocks: int, buckets: int):
    """Mapper of step 2: hashes of the whole strings that a shared sample allows; ``start`` is where in its text a stretch begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = cover_for(length)
        roll, third, packer = Rolling(23), Rolling(29, 1), _Packer(blocks, buckets, STRING_BYTES)
        low = U64(2 ** (8 * CHECK_BYTES) - 1)
        for batch in batches:
            data, off = buffers(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            begin = batch.column("start").to_pylist() if "start" in batch.schema.names else [0] * batch.num_rows
            for i, deltas in enumerate(batch.column("deltas").to_pylist()):
                text = data[off[i] : off[i + 1]]
                at = _may_start(len(text), decode(deltas), length, v)
                for a in range(0, len(text), CHUNK):
                    s = at[np.searchsorted(at, a) : np.searchsorted(at, a + CHUNK)]
                    if len(s):
                        part = text[a : a + CHUNK + length]
                        check = third.windows(third.sums(part), s - a, s - a + length) & low
                        packer.add(roll.windows(roll.sums(part), s - a, s - a + length), np.full(len(s), keys[i]), s + begin[i], check.astype(np.uint32))
                        if packer.n >= FLUSH_POSITIONS:
                            yield from packer.rows()
        yield from packer.rows()

    return run


def spans_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of that length at the ascending starts."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > length)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + length


def _cut(length: int, keep_characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            copies = batch.column("copies").to_pylist()
            found = batch.column("deltas").to_pylist()
            starts, ends, kept = [], [], []
            for i, (n, deltas) in enumerate(zip(copies, found)):
                text = data[off[i] : off[i + 1]]
                if n and n > 1 and len(text) >= length:
                    a, b = np.array([0]), np.array([len(text)])
                else:
                    a, b = spans_of(decode(deltas), length)
                if keep_characters and len(a):
                    # a character that is only partly covered stays whole
                    head = np.append((text & 0xC0) != 0x80, True)
                    firsts = np.flatnonzero(head)
                    a = firsts[np.searchsorted(firsts, a)]
                    b = firsts[np.searchsorted(firsts, b, "right") - 1]
                    a, b = a[a < b], b[a < b]
                mask = np.zeros(len(text) + 1, np.int8)
                mask[a] += 1
                mask[b] -= 1
                kept.append(text[np.cumsum(mask[:-1]) == 0].tobytes() if len(a) else text.tobytes())
                starts.append(a.tolist())
                ends.append(b.tolist())
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "key", "copies", "deltas")]
            names = [c for c in batch.schema.names if c not in ("text", "key", "copies", "deltas")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(np.diff(off), pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                names=[*names, "n_bytes", "starts", "ends", "kept"],
            )

    return run


def cut_repeats(docs: DataFrame, text: str = "text", ids: str = "doc_id", length: int = 200, keep_characters: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Each document's id and carried columns with n_bytes, the starts and ends of its repeated spans, and the bytes kept.

    With ``keep_characters``, spans shrink to whole characters, so that what is kept is valid UTF-8.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    whole = F.coalesce(docs[text], F.lit(""))
    carried = {f"_carried_{i}": docs[c] for i, c in enumerate(carry or [])}
    salt = 0
    while True:
        key = F.xxhash64(F.lit(salt), whole, F.octet_length(whole))
        rows = docs.select(docs[ids].alias("id"), whole.alias("text"), key.alias("key"), *(c.alias(k) for k, c in carried.items()))
        base = rows.select("id", "text", "key")
        told = base.where(F.octet_length("text") >= length).select("id", "key", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha"))
        parts = [F.conv(F.substring("sha", 1 + 15 * i, 15), 16, 10).cast("long") for i in range(4)]
        texts = told.select("id", "key", "size", *(x.alias(f"sha{i}") for i, x in enumerate(parts)))
        ends = [f(f"sha{i}").alias(f"{n}{i}") for i in range(4) for f, n in ((F.min, "low"), (F.max, "high"))]
        grouped = texts.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("one"), F.max("size").alias("size"), *ends)
        differ = F.lit(False)
        for i in range(4):
            differ = differ | (F.col(f"low{i}") != F.col(f"high{i}"))
        classes = scratch.write(grouped.select("key", "copies", "one", "size", differ.alias("differ")), f"classes-{salt}")
        clash, total = classes.agg(F.max("differ"), F.sum("size")).head()
        if not clash:
            break
        salt += 1  # two texts of one key: all keys are drawn anew
    total = total or 1
    blocks, buckets = (max(shuffle_partitions(spark), -(-total // x)) for x in (BLOCK_BYTES, BUCKET_BYTES))
    # so wide that chance makes at most one in a thousand samples look shared
    width = min(8, max(5, -(-(total.bit_length() + 10) // 8)))

    def shared(mapped: DataFrame) -> DataFrame:
        found = mapped.groupBy("block").applyInArrow(_settle(buckets), _FOUND)
        return found.groupBy("bucket").applyInArrow(_gather, _POSITIONS)

    sampled = scratch.write(shared(base.select("key", "text").mapInArrow(_sample(length, blocks, buckets, width), _PACKED)), "samples")
    free_shuffles(spark)
    reps = scratch.write(sampled.join(classes, "key").select(F.col("key").alias("k"), "one", "deltas"), "reps")
    meets = base.join(reps.hint("shuffle_hash"), (base["key"] == reps["k"]) & base["id"].eqNullSafe(reps["one"])).select("key", "text", "deltas")
    segments = scratch.write(meets.mapInArrow(_segments(length), "key long, start long, text binary, deltas binary"), "segments")
    free_shuffles(spark)
    starts = scratch.write(shared(segments.mapInArrow(_candidates(length, blocks, buckets), _PACKED)), "starts")
    free_shuffles(spark)
    scratch.drop("samples", "reps", "segments")
    result = scratch.write(classes.where("copies > 1").join(starts, "key", "full").select(F.col("key").alias("k"), "copies", "deltas"), "result")
    free_shuffles(spark)
    joined = rows.join(result, rows["key"] == result["k"], "left").select("id", *carried, "text", "key", "copies", "deltas")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("id", *carried))
    out = joined.mapInArrow(_cut(length, keep_characters), f"{schema}, n_bytes long, starts array<long>, ends array<long>, kept binary")
    return out.toDF(ids, *(carry or []), "n_bytes", "starts", "ends", "kept")

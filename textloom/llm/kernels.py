"""Vectorised kernels over the UTF-8 buffer of an Arrow string column.

A batch of texts is one byte array plus offsets, so numbers for words, lines and windows take a few numpy passes over the
bytes whatever the number of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts handled at once: so many bytes, or one text if it is longer.
CHUNK = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets (one more than texts) of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def ranges(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes together (a longer text alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of murmur3: every bit of the input moves every bit of the output."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Rolling:
    """Hashes of any window of a byte array: polynomials modulo the prime 2**31 - 1 with bases of their own, from running sums.

    Over a prime field two different windows of n bytes agree in a polynomial for at most n of all bases.
    """

    PRIME = (1 << 31) - 1

    def __init__(self, seed: int, lanes: int = 2):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bases = [int(x) for x in rng.integers(1 << 20, self.PRIME - 1, lanes)]
        self.table = rng.permutation(np.arange(1, 1 << 16, dtype=np.int64))[:256] << 14 | np.arange(256)
        self.up = self.down = [np.ones(1, np.int64)] * lanes

    @classmethod
    def _powers(cls, base: int, n: int) -> np.ndarray:
        out, known = np.ones(n, np.int64), 1
        while known < n:
            out[known : 2 * known] = out[: min(known, n - known)] * pow(base, known, cls.PRIME) % cls.PRIME
            known *= 2
        return out

    def sums(self, data: np.ndarray) -> list[np.ndarray]:
        """A running sum for each polynomial; exact in 64 bits up to 2**32 bytes."""
        if len(self.up[0]) < len(data) + 1:
            grown = max(len(data) + 1, CHUNK + 1024)
            self.up = [self._powers(b, grown) for b in self.bases]
            self.down = [self._powers(pow(b, -1, self.PRIME), grown) for b in self.bases]
        x, out = self.table[data], []
        for up in self.up:
            y = x * up[: len(data)]
            y = (y & self.PRIME) + (y >> 31)
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(y, out=total[1:])
            out.append(total)
        return out

    def windows(self, sums: list[np.ndarray], start: np.ndarray, end: np.ndarray | int) -> np.ndarray:
        """Hashes of 31 bits a lane of the bytes from start to end, the same wherever they stand, mixed into 64."""
        h = np.zeros(len(start), U64)
        for i, (total, down) in enumerate(zip(sums, self.down)):
            h |= ((total[end] - total[start]) % self.PRIME * down[start] % self.PRIME).astype(U64) << U64(31 * i)
        return mix(h)


#: Longer stretches are digested one by one.
LONG_WORD = 256
_LANES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each stretch of bytes: eight bytes at a time are mixed into two lanes, which are joined at the end.

    Stretches over ``LONG_WORD`` bytes take the first eight bytes of their BLAKE2b digest.
    """
    size = (end - start).astype(np.int64)
    one, two = mix(size.astype(U64) ^ _LANES[0]), mix(size.astype(U64) ^ _LANES[1])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    chunk = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    rows = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(rows):
        left = size[rows] - at
        x = chunk[start[rows] + at]
        short = left < 8
        x[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
        one[rows], two[rows] = mix(one[rows] ^ x), mix((two[rows] + x) * _LANES[0])
        rows, at = rows[left > 8], at + 8
    out = mix(one ^ (two * _LANES[1]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def dictionary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each stretch of bytes, equal for equal bytes, and the distinct stretches; stretches ascend without overlap."""
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    size = end - start
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def tuples(code: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k codes, equal for equal runs: exact, whatever the codes."""
    full = max(0, len(code) - k + 1)
    out, most = code[:full].astype(np.int64), int(code.max(initial=0)) + 1
    for j in range(1, k):
        if int(out.max(initial=0)) >= (1 << 62) // most:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
        out = out * most + code[j : j + full]
    return out


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run without ASCII white space within a text), and where each text's words begin."""
    ink = ~_WHITE[data]
    start, end = ink.copy(), ink.copy()
    if len(data):
        start[1:] &= ~ink[:-1]
        end[:-1] &= ~ink[1:]
        first = off[:-1][off[:-1] < off[1:]]
        start[first] = ink[first]
        end[off[1:][off[:-1] < off[1:]] - 1] = ink[off[1:][off[:-1] < off[1:]] - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def line_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line (split at \\n) and the text of each line; an empty text has one empty line."""
    feeds = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(feeds, off)) + 1
    # starts and ends both rise from line to line, so sorting each apart keeps them paired
    s = np.sort(np.concatenate([off[:-1], feeds + 1]))
    e = np.sort(np.concatenate([feeds, off[1:]]))
    return s, e, np.repeat(np.arange(len(off) - 1), count)


def shingles(words: np.ndarray, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word windows, text by text, and where each text's begin.

    A text with fewer words, but any, has one: of its whole sequence.
    """
    n = np.diff(cut)
    full = max(0, len(words) - k + 1)
    h = np.full(full, U64(k))
    for j in range(k):
        h = mix(h ^ words[j : j + full])
    many = np.maximum(n - k + 1, 0)
    count = np.where(n == 0, 0, np.maximum(many, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], U64)
    text = np.repeat(np.arange(len(n)), count)
    inner = np.arange(at[-1]) - at[text]
    long = (n >= k)[text]
    out[long] = h[(cut[:-1][text] + inner)[long]]
    for m in range(1, k):
        rows = np.flatnonzero(n == m)
        if len(rows):
            x = np.full(len(rows), U64(m))
            for j in range(m):
                x = mix(x ^ words[cut[rows] + j])
            out[at[rows]] = x
    return out, at


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each integer, byte by byte in planes, so that equal high bytes stand together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :width] = x.T
    return out.view("<u8").reshape(-1)

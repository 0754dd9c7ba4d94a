"""Words and word hashes of whole Arrow text columns, with numpy (no per-word Python).

A word is a maximal run of bytes of a class. Every non-ASCII byte belongs to all
classes used here, so UTF-8 texts can be cut bytewise with the same result as by
code points. Texts are handled in blocks of about a megabyte; a longer text is its own
block and is hashed in pieces cut between words, so memory follows the longest text only.
Hashes are 64 bits: equal words have equal hashes, different words collide with
probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: words of `[^\x20\x09-\x0D]+`
NON_SPACE = ~_SPACE
#: words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = U64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the whole word."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


_POW = powers(4096)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def split_words(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = table[data]
    flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        flips = np.concatenate(([0], flips))
    if len(flips) % 2:
        flips = np.append(flips, len(data))
    return flips[0::2], flips[1::2]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (spans must not be empty)."""
    n = end - start
    if not len(n):
        return np.zeros(0, U64)
    first = np.cumsum(n) - n
    total = int(first[-1] + n[-1])
    pos = np.arange(total) - np.repeat(first, n)
    at = pos + np.repeat(start, n)
    longest = int(n.max())
    pw = _POW if longest <= len(_POW) else powers(longest)
    h = np.add.reduceat((data[at].astype(U64) + U64(1)) * pw[pos], first)
    return mix(h + n.astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, table: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of a byte array, piece by piece."""
    if fold:
        data = lower(data)
    start, end = split_words(data, table)
    if len(data) <= 2 * _PIECE:
        return start, end, hash_spans(data, start, end)
    cuts = np.searchsorted(start, np.arange(0, len(data) + _PIECE, _PIECE))
    parts = [hash_spans(data, start[a:b], end[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return start, end, np.concatenate(parts)


@dataclass
class Block:
    """Some rows of a column: their bytes (rows parted by a newline) and their words."""

    row: int                  # first row in the batch
    rows: int
    data: np.ndarray          # uint8
    at: np.ndarray            # rows + 1 byte offsets into data; row i is data[at[i] : at[i + 1] - 1]
    start: np.ndarray         # of each word
    end: np.ndarray
    hash: np.ndarray          # uint64
    first: np.ndarray         # rows + 1 word offsets

    def text(self, i: int) -> bytes:
        return self.data[self.at[i]: self.at[i + 1] - 1].tobytes()


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def blocks(column, table: np.ndarray, fold: bool, block_bytes: int = _PIECE) -> Iterator[Block]:
    data, off = utf8(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + block_bytes, "right")) - 1)
        ends = off[i + 1: j + 1] - off[i]
        part = np.insert(data[off[i]: off[j]], ends, 10)
        at = np.concatenate(([0], ends + np.arange(1, j - i + 1)))
        start, end, h = words(part, table, fold)
        yield Block(i, j - i, part, at, start, end, h, np.searchsorted(start, at))
        i = j


_MUL = powers(8, U64(0xC2B2AE3D27D4EB4F))


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of ONE text, given its word hashes: every k consecutive
    words; with fewer words the whole sequence as one; without words none."""
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    m = n - width + 1
    s = np.full(m, U64((width * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF))
    for i in range(width):
        s += h[i: i + m] * _MUL[i]
    return mix(s)


class MinHash:
    """n universal hash permutations h -> a h + b modulo 2**64 (a odd), of which the upper 32 bits count."""

    def __init__(self, n: int, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = (rng.integers(0, 1 << 63, n, dtype=np.uint64) << U64(1)) | U64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.n = n

    def signature(self, s: np.ndarray, step: int = 1024) -> np.ndarray:
        """n uint32 values; all ones for an empty set."""
        best = np.full(self.n, 0xFFFFFFFFFFFFFFFF, U64)
        for i in range(0, len(s), step):
            x = self.a[:, None] * s[None, i: i + step]
            x += self.b[:, None]
            np.minimum(best, x.min(axis=1), out=best)
        return (best >> U64(32)).astype(np.uint32)

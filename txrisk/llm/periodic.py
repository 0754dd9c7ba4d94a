"""Periodic runs of words by online dyadic square catching.

A square is a stretch of words followed by itself; a run is a maximal stretch that holds squares of one period. Words are
appended piece by piece (a word, a text, many texts). On level k the sequence is cut into blocks of ``2 ** k`` words, and every
completed block keeps a catcher for the periods ``2 ** (k + 1) .. 2 ** (k + 2) - 1`` (level 0: 1 .. 3). The first half of a square of
such a period holds a whole block, which must recur one period later: each appended word completes one suffix of
``2 ** k`` words a level, and that suffix is compared with the two blocks whose catchers expect it there (level 0: three). Matches of
consecutive blocks at one period are one stretch. A stretch is prolonged to both sides by comparing suffixes and
prefixes; one that reaches the last word stays open and goes on with the words appended next. As soon as it is two
periods long it is a square, and squares of one period that overlap are one run, since the stretch is maximal.

A run found at a multiple of its smallest period has the very same ends there as at the smallest one, which a lower level
finds, so the smallest period of equal ends counts.

Suffixes are compared by prefix sums of a polynomial modulo 2 ** 61 - 1 over 64-bit word hashes: linear memory and a constant number
of numpy operations a level, n log n in all, whatever the text looks like. Reported runs are checked word by word; should
a sum have lied, the exact stretches of that period take their place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .runtime import Out, spare

LEAST = 12                      # words of the shortest run

_P = (1 << 61) - 1
_M, _M30, _M31 = np.uint64(_P), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_S30, _S31, _S61, _ONE = np.uint64(30), np.uint64(31), np.uint64(61), np.uint64(1)
_B = 0x1B5F3C6A9D2E7411 % _P
_DIRECT = 16                    # words compared one by one before halving


def _fold(t):
    t = (t & _M) + (t >> _S61)
    return np.where(t >= _M, t - _M, t)


def _mul(a, b):
    """a * b modulo 2 ** 61 - 1."""
    ah, al, bh, bl = a >> _S31, a & _M31, b >> _S31, b & _M31
    mid = ah * bl + al * bh
    return _fold(((ah * bh) << _ONE) + (mid >> _S30) + ((mid & _M30) << _S31) + al * bl)


def _sub(a, b):
    return _fold(a + _M - b)


class _Powers:
    """Powers of a base modulo 2 ** 61 - 1, as many as were ever needed."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), _P))
            self.table = np.concatenate([self.table, _mul(self.table, step)])
        return self.table


_UP, _DOWN = _Powers(_B), _Powers(pow(_B, _P - 2, _P))


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if len(a) >= n:
        return a
    wider = np.zeros(max(n, 2 * len(a)), a.dtype)
    wider[: len(a)] = a
    return wider


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0] - 1, lo[1] .. hi[1] - 1, ..., all not empty."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


class SquareCatchers:
    """Catchers over sequences of word hashes that are appended piece by piece, one sequence after the other."""

    def __init__(self, least: int = LEAST):
        self.least, self.n = least, 0
        self.word, self.sum = np.zeros(1024, np.uint64), np.zeros(1025, np.uint64)
        self.starts = np.zeros(1, np.int64)                        # of each sequence
        self.blocks: list[np.ndarray] = []                         # of each level: the hashes of its completed blocks
        self.done: list[tuple[int, int, int]] = []                 # (start, end, period) of stretches of two periods at least
        self.open: dict[tuple[int, int], None] = {}                # (period, start) of stretches up to the last word

    # ---- suffix comparisons

    def _hash(self, at: np.ndarray, m: int) -> np.ndarray:
        return _mul(_sub(self.sum[at + m], self.sum[at]), _DOWN(self.n + 1)[at])

    def _equal(self, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
        return _mul(_sub(self.sum[i + m], self.sum[i]), _UP(self.n + 1)[j - i]) == _sub(self.sum[j + m], self.sum[j])

    def _common(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
        """Number of equal words, at most ``limit``, from i and j on (way 1) or before them (way -1)."""
        got = np.zeros(len(i), np.int64)
        shift = 0 if way > 0 else -1
        live, k = np.flatnonzero(limit > 0), 0
        while len(live) and k < _DIRECT:
            live = live[self.word[i[live] + shift + way * k] == self.word[j[live] + shift + way * k]]
            k += 1
            got[live] = k
            live = live[limit[live] > k]
        if len(live):
            lo, hi = np.full(len(live), k), limit[live] + 1
            while (hi - lo > 1).any():
                mid = (lo + hi) // 2
                back = mid if way < 0 else 0
                same = self._equal(i[live] - back, j[live] - back, mid)
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
            got[live] = lo
        return got

    # ---- growing

    def append(self, words: np.ndarray, fresh: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Append words; at the offsets ``fresh`` a new sequence starts. Returns (start, period) of the squares first seen now."""
        old, n = self.n, self.n + len(words)
        self.word, self.sum = _room(self.word, n), _room(self.sum, n + 1)
        self.word[old:n] = words
        term = _mul(_fold(words), _UP(n + 1)[old:n])
        high, low = np.cumsum(term >> _S31), np.cumsum(term & _M31)
        self.sum[old + 1: n + 1] = _fold(_fold(_mul(_fold(high), np.uint64(1 << 31)) + _fold(low)) + self.sum[old])
        if fresh is not None and len(fresh):
            self.starts = np.unique(np.concatenate([self.starts, np.asarray(fresh, np.int64) + old]))
        self.n = n
        first = max(0, int(np.searchsorted(self.starts, old, "right")) - 1)
        start = self.starts[first:]
        end = np.append(start[1:], n)

        squares = self._advance(old, old if start[0] == old else int(end[0]))
        level = 0
        while True:
            m = 1 << level
            lo = np.maximum(start + (2 * m if level else 1), old - m + 1)
            hi = end - m + 1
            some = lo < hi
            if not (end - start >= (3 * m if level else 2)).any():
                break
            self._complete(level, m)
            if some.any():
                lo, hi = lo[some], hi[some]
                squares += self._catch(level, m, _ranges(lo, hi), np.repeat(start[some], hi - lo), np.repeat(end[some], hi - lo))
            level += 1
        return squares

    def _complete(self, level: int, m: int) -> None:
        """Hashes of the blocks that the appended words completed."""
        if level == len(self.blocks):
            self.blocks.append(np.zeros(0, np.uint64))
        have, want = len(self.blocks[level]), self.n // m
        if level and want > have:
            self.blocks[level] = np.concatenate([self.blocks[level], self._hash(np.arange(have, want) * m, m)])

    def _catch(self, level: int, m: int, at: np.ndarray, since: np.ndarray, until: np.ndarray) -> list[tuple[int, int]]:
        """Compare the suffixes (``m`` words from ``at`` on) with the blocks that expect them; keep the stretches."""
        seen = self._hash(at, m) if level else None
        found = []
        for back in ((2, 3) if level else (1, 2, 3)):
            block = at // m - back
            ok = block * m >= since
            hit = np.flatnonzero(ok & ((self.blocks[level][np.maximum(block, 0)] == seen) if level else (self.word[np.maximum(block, 0)] == self.word[at])))
            found.append((block[hit] * m, at[hit] - block[hit] * m, since[hit], until[hit]))
        b, p, since, until = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(b):
            return []
        order = np.lexsort((b, p))
        b, p, since, until = b[order], p[order], since[order], until[order]
        new = np.concatenate(([True], (p[1:] != p[:-1]) | (b[1:] != b[:-1] + m) | (since[1:] != since[:-1])))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(b)) - 1
        p, since, until, left, right = p[head], since[head], until[head], b[head], b[tail] + m
        start = left - self._common(left, left + p, left - since, -1)
        end = right + p + self._common(right, right + p, until - right - p, 1)
        growing = end == self.n
        squares = []
        for s, e, q, grows in zip(start.tolist(), end.tolist(), p.tolist(), growing.tolist(), strict=True):
            if grows:
                if (q, s) in self.open:
                    continue
                self.open[q, s] = None
            elif e - s >= 2 * q:
                self.done.append((s, e, q))
            if e - s >= 2 * q:
                squares.append((s, q))
        return squares

    def _advance(self, old: int, until: int) -> list[tuple[int, int]]:
        """Go on with the open stretches, up to ``until`` (where their sequence ends, or the last word)."""
        if not self.open or self.n == old:
            return []
        p, s = (np.array(x, np.int64) for x in zip(*self.open, strict=True))
        self.open = {}
        at = np.full(len(p), old)
        end = old + self._common(at - p, at, np.full(len(p), max(0, until - old)), 1)
        squares = []
        for q, a, e in zip(p.tolist(), s.tolist(), end.tolist(), strict=True):
            if e == self.n:
                self.open[q, a] = None
            elif e - a >= 2 * q:
                self.done.append((a, e, q))
            if e - a >= 2 * q > old - a:
                squares.append((a, q))
        return squares

    # ---- what was caught

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, smallest period) of all runs so far of ``least`` words at least, by start and period."""
        least = lambda rows: [(s, e, p) for s, e, p in rows if e - s >= max(self.least, 2 * p)]
        rows = least(set(self.done) | {(s, self.n, p) for p, s in self.open})
        sure = {r for r in rows if np.array_equal(self.word[r[0]: r[1] - r[2]], self.word[r[0] + r[2]: r[1]])}
        for s, _, p in set(rows) - sure:
            sure.update(least(self._exact(s, p)))
        smallest: dict[tuple[int, int], int] = {}
        for s, e, p in sure:
            smallest[s, e] = min(p, smallest.get((s, e), p))
        rows = sorted((s, p, e) for (s, e), p in smallest.items())
        start, period, end = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        return start, end, period

    def _exact(self, at: int, p: int) -> list[tuple[int, int, int]]:
        """All stretches of period ``p`` in the sequence around ``at``, word by word."""
        k = int(np.searchsorted(self.starts, at, "right")) - 1
        lo, hi = int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.n
        same = np.concatenate(([False], self.word[lo: hi - p] == self.word[lo + p: hi], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        return [(lo + a, lo + b + p, p) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(least):
    def run(batches):
        for batch in batches:
            out = Out(pa.schema([batch.schema.field(0), pa.field("n_words", pa.int64()), pa.field("runs", pa.list_(_RUN)), pa.field("collapsed", pa.string())]))
            ids = batch.column(0).to_pylist()
            for b in vec.blocks(batch.column(1), vec.NON_SPACE, False):
                catchers = SquareCatchers(least)
                catchers.append(b.hash, b.first[:-1])
                start, end, period = catchers.runs()
                cuts = np.searchsorted(start, b.first)
                for d in range(b.rows):
                    own = slice(cuts[d], cuts[d + 1])
                    zero = int(b.first[d])
                    words = b.text(d).split()
                    runs = [{"start": s - zero, "length": e - s, "period": p} for s, e, p in zip(start[own].tolist(), end[own].tolist(), period[own].tolist(), strict=True)]
                    n_words = len(words)
                    if runs:
                        keep = np.ones(n_words, bool)
                        for r in runs:
                            keep[r["start"] + r["period"]: r["start"] + r["length"]] = False
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    text = b" ".join(words).decode()
                    out.add(ids[b.row + d], n_words, runs, text, size=len(text) + 24 * len(runs))
                    if out.full:
                        yield out.take()
            yield out.take()

    return run


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``id_col, n_words, runs, collapsed`` for every row.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. ``runs`` lists (start, length, period) by start and period: every
    stretch of consecutive words with smallest period ``period`` and at least ``least`` words and two periods that no
    neighbouring word prolongs. ``collapsed`` is the text with one space between words and without those that a run
    holds after its first period. Null and empty texts and those without words have no runs and an empty ``collapsed``; rows
    that share an id each keep their row; other columns are left out, whatever their names; an empty table gives an empty table. Memory
    follows the longest text (about 15 numbers a word); there is no shuffle.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = docs.mapInArrow(_find(least), f"id {id_type}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def with_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with a repetition planted in about a tenth of the texts, by crc32 of the id: from a drawn word on, the words of a drawn
    period recur up to the end (words joined by one space). Null ids and texts without words stay as they are."""
    h, g, n, a, p, w = spare(df, "h", "g", "n", "a", "p", "w")
    c = F.col
    drawn = (df.withColumn(h, F.crc32(c(id_col).cast("string").cast("binary"))).withColumn(g, F.floor(c(h) / 10))
             .withColumn(w, F.when(c(h) % 10 == 0, F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
             .withColumn(n, F.size(w)).withColumn(a, F.when(c(n) > 0, c(g) % c(n)))
             .withColumn(p, F.lit(1) + F.floor((c(n) - c(a)) / (F.lit(3) + c(g) % 8))))
    origin = lambda i: F.when(i < c(a), i).otherwise(c(a) + (i - c(a)) % c(p))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), c(n) - 1), lambda i: F.get(c(w), origin(i).cast("int"))), " ")
    return drawn.withColumn(text_col, F.when(c(n) > 0, repeated).otherwise(c(text_col))).drop(h, g, n, a, p, w)

"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is ``window`` consecutive words of
an item; an item of fewer words (but not none) is one window. Every document streams through
the automaton, which gives the longest item passage ending at each word; words inside an
occurrence of a window are hit.

Test sets are small beside a corpus, but their size is checked, not assumed. Items are dealt into blocks of about
``block_bytes`` bytes of text. A block is a row of automata of at most ``PIECE_WORDS`` words each, built one at a time and kept as sorted
arrays (about 5 MB a MB of text, where the maps they are built from take 130 MB); an item of more words
is laid over several with an overlap that keeps every window whole. Blocks are streamed over the whole texts and their hits
merged per document. Cutting passages looks at every block before it cuts, with at most two blocks in a task at a time.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import vec
from .runtime import Out, saved, spare

WINDOW = 10
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 1 << 17


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items of each passage."""

    def __init__(self, items: list[tuple[int, list]], window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        own: list[set] = [set()]
        for k, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w, own)
                own[last].add(k)
        order = sorted(range(len(self.len)), key=self.len.__getitem__, reverse=True)
        # items only matter at the states that stand for passages of `window` words
        for v in order:
            up = self.link[v]
            if up > 0 and self.len[up] >= window:
                own[up] |= own[v]
        self.items_of: dict[int, set] = {v: own[v] for v in order if self.len[v] >= window and self.len[self.link[v]] < window}
        self.cut = [0] * len(self.len)                # the state of the last `window` words
        self.short: dict[int, list] = {}              # whole items of fewer words that end here: (words, item)
        ends: dict[int, list] = {}
        for k, seq in items:
            if 0 < len(seq) < window:
                v = 0
                for w in seq:
                    v = self.next[v][w]
                ends.setdefault(v, []).append((len(seq), k))
        for v in reversed(order):
            up = self.link[v]
            self.cut[v] = v if self.len[v] >= window > self.len[up] else self.cut[up] if v and self.len[v] >= window else 0
            if v and (here := ends.get(v, []) + self.short.get(up, [])):
                self.short[v] = here

    def _extend(self, last: int, w, own: list) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q, own)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        own.append(set())
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q, own)
        return cur

    def _clone(self, p: int, w, q: int, own: list) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        own.append(set())
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def packed(self, words: int) -> PackedAutomaton:
        """The automaton as arrays; word numbers are below ``words``."""
        return PackedAutomaton(self, words)


def _grouped(rows: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists by state as offsets and values."""
    offset = np.zeros(n + 1, np.int32)
    for v, values in rows.items():
        offset[v + 1] = len(values)
    offset = np.cumsum(offset, dtype=np.int32)
    return offset, np.array([x for v in sorted(rows) for x in rows[v]], np.int64)


class PackedAutomaton:
    """A :class:`SuffixAutomaton` to be matched: edges sorted by (state, word), nothing but arrays."""

    def __init__(self, built: SuffixAutomaton, words: int):
        self.window, self.words, n = built.window, words, len(built.len)
        size = sum(len(x) for x in built.next)
        key = np.fromiter((v * words + w for v, edges in enumerate(built.next) for w in edges), np.int64, size)
        to = np.fromiter((t for edges in built.next for t in edges.values()), np.int32, size)
        order = np.argsort(key)
        self.key, self.to = array("q", key[order].tobytes()), array("i", to[order].tobytes())
        self.link, self.len, self.cut = (array("i", np.array(x, np.int32).tobytes()) for x in (built.link, built.len, built.cut))
        self.item_at, self.item = _grouped({v: sorted(x) for v, x in built.items_of.items()}, n)
        self.short_at, self.short = _grouped({v: [(m << 32) | k for m, k in x] for v, x in built.short.items()}, n)

    def _step(self, v: int, w: int) -> int:
        """The state after word ``w`` (-1: of no item), -1 if there is none."""
        if w < 0:
            return -1
        key = v * self.words + w
        at = bisect_left(self.key, key)
        return self.to[at] if at < len(self.key) and self.key[at] == key else -1

    def scan(self, seq: list, hit: np.ndarray, at: int, found: set) -> None:
        """Stream words; mark those inside windows in ``hit`` (``seq[0]`` is word ``at``), add their items to ``found``."""
        link, length, window, step = self.link, self.len, self.window, self._step
        v = matched = 0
        for i, w in enumerate(seq):
            to = step(v, w)
            while v and to < 0:
                v = link[v]
                matched = length[v]
                to = step(v, w)
            if to < 0:
                continue
            v, matched = to, matched + 1
            if matched >= window:
                hit[at + i + 1 - window: at + i + 1] = True
                cut = self.cut[v]
                found.update(self.item[self.item_at[cut]: self.item_at[cut + 1]].tolist())
            if self.short_at[v] < self.short_at[v + 1]:
                for x in self.short[self.short_at[v]: self.short_at[v + 1]].tolist():
                    n, k = x >> 32, x & 0xFFFFFFFF
                    if n <= matched:
                        hit[at + i + 1 - n: at + i + 1] = True
                        found.add(k)


def _pieces(seqs: list[np.ndarray], window: int, most: int):
    """The items in groups of at most about ``most`` words, as (item number, words); long ones are laid over with an overlap."""
    group, size = [], 0
    for k, seq in enumerate(seqs):
        for i in range(0, max(1, len(seq) - window + 1), most):
            part = seq[i: i + most + window - 1]
            if group and size + len(part) > most:
                yield group
                group, size = [], 0
            group.append((k, part))
            size += len(part)
    if group:
        yield group


class Items:
    """A block of test items, ready to be matched; it is broadcast."""

    def __init__(self, rows: list[tuple[str, str]], window: int, piece_words: int = PIECE_WORDS):
        self.window = window
        seqs = []
        for item, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            seqs.append((item, vec.words(data, vec.ALNUM, True)[2]))
        self.names = [item for item, _ in seqs]
        every = np.concatenate([h for _, h in seqs] or [np.zeros(0, vec.U64)])
        self.vocab = np.unique(every)
        numbered = [(item, np.searchsorted(self.vocab, h)) for item, h in seqs]
        lengths = [len(s) for _, s in numbered if len(s)]
        self.least = min([window, *lengths]) if lengths else 0
        pairs = [s[:-1] * len(self.vocab) + s[1:] for _, s in numbered if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.automata = []
        for group in _pieces([s for _, s in numbered], window, piece_words):
            self.automata.append(SuffixAutomaton([(k, s.tolist()) for k, s in group], window).packed(len(self.vocab)))

    def scan(self, numbers: np.ndarray, hit: np.ndarray, at: int, found: set) -> None:
        seq = numbers.tolist()
        for automaton in self.automata:
            automaton.scan(seq, hit, at, found)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words of no item."""
        if not len(self.vocab):
            return np.full(len(h), -1, np.int64)
        at = np.searchsorted(self.vocab, h)
        at[at == len(self.vocab)] = 0
        return np.where(self.vocab[at] == h, at, -1)

    def stretches(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of words that a window may lie in: at least as long as the shortest window,
        every word and every pair of neighbours occurring in some item."""
        n = len(numbers)
        if not n or not self.least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        good = numbers >= 0
        joined = np.zeros(n, bool)                    # word i and word i - 1 are neighbours in an item
        both = np.flatnonzero(good[1:] & good[:-1]) + 1
        if len(both) and len(self.pairs):
            pair = numbers[both - 1] * len(self.vocab) + numbers[both]
            at = np.searchsorted(self.pairs, pair)
            at[at == len(self.pairs)] = 0
            joined[both] = self.pairs[at] == pair
        inner = first[(first > 0) & (first < n)]
        joined[inner] = False
        starts = np.flatnonzero(good & ~joined)
        stops = np.flatnonzero(good & ~np.append(joined[1:], False)) + 1
        keep = stops - starts >= self.least
        return starts[keep], stops[keep]


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter(
        F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(size / block_bytes * (2 if size > block_bytes else 1)))
    if n == 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


_HITS = "n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def _stream(shared):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        items = shared.value
        for batch in batches:
            out = Out(pa.schema([batch.schema.field(0), pa.field("n_words", pa.int64()), pa.field("spans", spans_type),
                                 pa.field("items", pa.list_(pa.string()))]))
            keys = batch.column(0).to_pylist()
            for b in vec.blocks(batch.column(batch.num_columns - 1), vec.ALNUM, True):
                starts, stops = items.stretches(items.numbers(b.hash), b.first)
                hit = np.zeros(len(b.hash), bool)
                found: dict[int, set] = {}
                docs = np.searchsorted(b.first, starts, "right") - 1
                for d, s, e in zip(docs.tolist(), starts.tolist(), stops.tolist(), strict=True):
                    items.scan(items.numbers(b.hash[s:e]), hit, s, found.setdefault(d, set()))
                for d in range(b.rows):
                    lo, hi = int(b.first[d]), int(b.first[d + 1])
                    spans, names = [], []
                    if found.get(d):
                        flips = np.flatnonzero(np.diff(hit[lo:hi].astype(np.int8), prepend=0, append=0))
                        spans = [{"start": int(x), "stop": int(y)} for x, y in zip(flips[0::2], flips[1::2], strict=True)]
                        names = sorted({items.names[k] for k in found[d]})
                    out.add(keys[b.row + d], hi - lo, spans, names)
                if out.full:
                    yield out.take()
            yield out.take()

    return run


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col, n_words, spans array<struct<start,stop>>, items array<string>`` for every document.

    ``spans``: disjoint word ranges [start, stop) that are hit, in order; ``items``: the ids (as strings, sorted,
    each once) of the items with occurring windows. Null and empty texts have no words; items without id or
    words have no windows; repeated items count under each of their ids. An empty benchmark hits nothing.
    Each input row gives one row.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = []
    blocks = _blocks_of(benchmark, item_col, item_text_col, block_bytes)
    for no, items in enumerate(blocks):
        rows = [(r["item"], r["text"]) for r in items.collect()]       # at most about block_bytes
        shared = spark.sparkContext.broadcast(Items(rows, window))
        cols = [F.col(id_col).alias("id")] + ([F.xxhash64(text_col).alias("th")] if len(blocks) > 1 else [])
        text = docs.select(*cols, F.col(text_col).alias("text"))
        if len(blocks) > 1:
            text = text.select(F.struct("id", "th").alias("id"), "text")
        kind = text.schema["id"].dataType.simpleString()
        parts.append(text.mapInArrow(_stream(shared), f"id {kind}, {_HITS}").withColumn("block", F.lit(no)))
    if len(parts) == 1:
        return parts[0].select(F.col("id").cast(id_type).alias(id_col), "n_words", "spans", "items")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # equal rows (same id and text) are merged as one, counted in the first block
    merged = every.groupBy("id").agg(F.count_if(F.col("block") == 0).cast("int").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # overlapping or touching ranges of different blocks become one
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    grow = lambda done, s: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= s["start"]),
                                  F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
                                      F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                                      F.greatest(F.try_element_at(done, F.lit(-1))["stop"], s["stop"]).alias("stop"))))) \
        .otherwise(F.concat(done, F.array(s)))
    merged = merged.select("id", "copies", "n_words", F.aggregate("spans", empty, grow).alias("spans"), "items")
    return merged.select(F.col("id.id").alias(id_col), "n_words", "spans", "items", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated`` of a :func:`hits` result."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _clean_rows(shared, text_col, max_coverage, mark, marked, last):
    """Cut the hits of this and of earlier blocks (``marked``: column ``mark``, the bounds of their word ranges); unless
    ``last``, only note them."""

    def run(batches):
        items = shared.value
        for batch in batches:
            text_at = batch.schema.names.index(text_col)
            keep, texts, marks = [], [], []
            before = batch.column(batch.schema.names.index(mark)) if marked else None
            column = batch.column(text_at)
            for b in vec.blocks(column, vec.ALNUM, True):
                starts, stops = items.stretches(items.numbers(b.hash), b.first)
                hit = np.zeros(len(b.hash), bool)
                touched = set()
                docs = np.searchsorted(b.first, starts, "right") - 1
                for d, s, e in zip(docs.tolist(), starts.tolist(), stops.tolist(), strict=True):
                    items.scan(items.numbers(b.hash[s:e]), hit, s, set())
                    touched.add(d)
                for d in range(b.rows):
                    lo, hi = int(b.first[d]), int(b.first[d + 1])
                    bounds = before[b.row + d].as_py() if marked else []
                    for x, y in zip(bounds[0::2], bounds[1::2], strict=True):
                        hit[lo + x: lo + y] = True
                        touched.add(d)
                    if not last:
                        marks.append(np.flatnonzero(np.diff(hit[lo:hi].astype(np.int8), prepend=0, append=0)).tolist() if d in touched else [])
                        continue
                    old = column[b.row + d].as_py()
                    n = int(hit[lo:hi].sum()) if d in touched else 0
                    keep.append(n <= max_coverage * (hi - lo) or n == 0)
                    if n:
                        flips = np.flatnonzero(np.diff(hit[lo:hi].astype(np.int8), prepend=0, append=0))
                        raw, done, out = b.text(d), 0, []
                        for x, y in zip(flips[0::2], flips[1::2], strict=True):
                            out.append(raw[done: int(b.start[lo + x] - b.at[d])])
                            done = int(b.end[lo + y - 1] - b.at[d])
                        old = b"".join([*out, raw[done:]]).decode()
                    texts.append(old)
            cols, fields = [*batch.columns], list(batch.schema)
            if marked:
                cols, fields = cols[:-1], fields[:-1]
            if last:
                cols[text_at] = pa.array(texts, type=batch.schema.field(text_at).type)
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields)).filter(pa.array(keep, type=pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(marks, pa.list_(pa.int64()))], schema=pa.schema([*fields, pa.field(mark, pa.list_(pa.int64()))]))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          window: int = WINDOW, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without their hit passages: each is cut out of the text (from the first byte of its first word to the last
    of its last); a document of which more than ``max_coverage`` of the words are hit is dropped. Others stay as
    they are, with all columns. Null and empty texts and those without words are never hit; an empty benchmark changes
    nothing, an empty table gives an empty table; repeated rows each stay or go. Very long texts are matched whole. With several blocks of items, each
    is matched with the whole text; coverage is judged and passages are cut once, behind the last. After every second block the
    rows are written, so that no task holds more than two."""
    out, blocks = docs, _blocks_of(benchmark, item_col, item_text_col, block_bytes)
    (mark,) = spare(docs, "hit_bounds")
    noted = StructType([*docs.schema.fields, StructField(mark, ArrayType(LongType()))])
    for no, items in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(Items([(r["item"], r["text"]) for r in items.collect()], window))
        last = no == len(blocks) - 1
        out = out.mapInArrow(_clean_rows(shared, text_col, max_coverage, mark, no > 0, last), docs.schema if last else noted)
        if no % 2 and not last:
            out = saved(out, "noted")
    return out


def brute_force(docs, items, window=WINDOW):
    """The same by plain Python, for tests: rows of (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows: dict[tuple, set] = {}
    for item, t in items:
        ws = split(t)
        if item is None or not ws:
            continue
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1):
            windows.setdefault(tuple(ws[i: i + n]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    for doc, t in docs:
        ws, hit, names = split(t), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i: i + n])) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[w]
        yield doc, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)

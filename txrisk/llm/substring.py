"""Removal of passages that an earlier document already holds, with sharded repeated-phrase automata.

A window is ``window`` consecutive words of one document. A word goes if a window that covers it
also starts in a document with a smaller id.

1. Anchors. The smallest-hashed ``phrase``-word phrase inside a window is the window's anchor. It depends on the
   window's words alone, so equal windows have equal anchors; neighbouring windows mostly share one, and together
   they form a span. A document has about one span for every 22 words: these rows, not windows, are grouped by
   anchor over the corpus. Windows of anchors that only one document has recur nowhere.
2. Confirmed passages. Where all documents with an anchor agree on its span, the span's first document owns
   all its windows. Where spans differ, the windows of one copy of each are compared one by one.
3. Automata. Documents are dealt into shards. For each shard the anchor phrases of the confirmed passages that
   concern it are compiled into one Aho-Corasick automaton over word numbers, and all documents of the shard stream
   through it; at each occurrence the windows owned by an earlier document are removed.

No row stands for a pair of documents, groups of copies are folded before every shuffle, and
the memory of a task is bounded by a shard's passages and one batch of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .runtime import Out, saved, shuffle_partitions

WINDOW = 50
PHRASE = 8
SHARDS_PER_PARTITION = 4
_BITS = np.uint64(28)                                  # a text has fewer than 2 ** 28 words
_PLACE = np.uint64((1 << 28) - 1)
_INVERSE = vec.U64(pow(int(vec._BASE), -1, 1 << 64))


class _Powers:
    """Tables of base ** i and base ** -i, grown to the longest text seen."""

    up = vec.powers(1 << 12)
    down = vec.powers(1 << 12, _INVERSE)

    @classmethod
    def of(cls, n: int):
        if n > len(cls.up):
            cls.up, cls.down = vec.powers(2 * n), vec.powers(2 * n, _INVERSE)
        return cls.up, cls.down


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have:]) if have < width else x


class Spans:
    """The spans of one text: windows first..last (inclusive), anchor position, content hash."""

    def __init__(self, h: np.ndarray, window: int, phrase: int):
        n = len(h)
        self.window = window
        if n < window:
            self.first = self.last = self.anchor = np.zeros(0, np.int64)
            self.key = self.phrase_hash = np.zeros(0, np.int64)
            return
        up, down = _Powers.of(n + 1)
        self._sums = np.concatenate((np.zeros(1, vec.U64), np.cumsum(h * up[:n])))
        self._down = down
        at = np.arange(n - phrase + 1)
        grams = vec.mix((self._sums[phrase:] - self._sums[:-phrase]) * down[: n - phrase + 1])
        packed = ((vec.mix(grams ^ vec.U64(0x2545F4914F6CDD1D)) >> _BITS) << _BITS) | at.astype(np.uint64)
        place = (_sliding_min(packed, window - phrase + 1) & _PLACE).astype(np.int64)
        turn = np.flatnonzero(place[1:] != place[:-1]) + 1
        self.first = np.concatenate(([0], turn))
        self.last = np.concatenate((turn, [len(place)])) - 1
        self.anchor = place[self.first]
        content = (self._sums[self.last + window] - self._sums[self.first]) * down[self.first]
        size = (self.last - self.first).astype(np.uint64) << np.uint64(32)
        self.key = vec.mix(content ^ vec.mix(size | (self.anchor - self.first).astype(np.uint64))).view(np.int64)
        self.phrase_hash = grams[self.anchor].view(np.int64)

    def windows(self, i: int) -> np.ndarray:
        """Content hashes of the windows of span i."""
        at = np.arange(self.first[i], self.last[i] + 1)
        return vec.mix((self._sums[at + self.window] - self._sums[at]) * self._down[at]).view(np.int64)


def _span_rows(window, phrase):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for b in vec.blocks(batch.column(1), vec.NON_SPACE, False):
                rows, anchors, keys = [], [], []
                for d in range(b.rows):
                    s = Spans(b.hash[b.first[d]: b.first[d + 1]], window, phrase)
                    if len(s.key):
                        rows.append(np.full(len(s.key), b.row + d))
                        anchors.append(s.phrase_hash)
                        keys.append(s.key)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(anchors)), pa.array(np.concatenate(keys))],
                        names=["id", "anchor", "span"])

    return run


def _passage_rows(window, phrase):
    """(id, spans, text): the anchor phrase of each listed span, and its windows where ``split`` says so."""

    def run(batches):
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = Out(pa.schema([batch.schema.field(0), pa.field("span", pa.int64()), pa.field("phrase", pa.string()),
                                 pa.field("windows", pa.list_(pa.int64()))]))
            for b in vec.blocks(batch.column(2), vec.NON_SPACE, False):
                for d in range(b.rows):
                    lo = int(b.first[d])
                    s = Spans(b.hash[lo: b.first[d + 1]], window, phrase)
                    want = {w["span"]: w["split"] for w in wanted[b.row + d]}
                    for i in np.flatnonzero(np.isin(s.key, np.array(list(want), np.int64))).tolist():
                        split = want.pop(int(s.key[i]), None)
                        if split is None:
                            continue
                        at = lo + int(s.anchor[i])
                        words = [b.data[x:y].tobytes() for x, y in zip(b.start[at: at + phrase], b.end[at: at + phrase], strict=True)]
                        out.add(ids[b.row + d], int(s.key[i]), b" ".join(words).decode(), s.windows(i) if split else None, size=600)
                        if out.full:
                            yield out.take()
            yield out.take()

    return run


class _Shard:
    """The automaton of a shard's confirmed passages."""

    def __init__(self, phrase: int):
        import ahocorasick

        self.phrase = phrase
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.owners: dict[int, tuple] = {}
        self.ready = False

    def add(self, numbers: tuple, span: int, offsets, owners):
        self.automaton.add_word(numbers, 1)
        self.owners[span] = (offsets, owners)

    def repeated(self, h: np.ndarray, spans: Spans, doc) -> np.ndarray | None:
        """Which words of a text lie in windows that an earlier document owns; None if none."""
        if not self.owners or not len(spans.key) or doc is None:
            return None
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        change = None
        for end, _ in self.automaton.iter(tuple((h & np.uint64(0xFFFFFFFF)).tolist())):
            at = end - self.phrase + 1
            i = int(np.searchsorted(spans.anchor, at))
            if i == len(spans.anchor) or spans.anchor[i] != at:
                continue                               # here another phrase is the anchor
            found = self.owners.get(int(spans.key[i]))
            if found is None:
                continue
            offsets, owners = found
            first, last = int(spans.first[i]), int(spans.last[i])
            if change is None:
                change = np.zeros(len(h) + 1, np.int32)
            if offsets is None:
                if owners[0] < doc:
                    change[first] += 1
                    change[last + spans.window] -= 1
            else:
                for o, owner in zip(offsets, owners, strict=True):
                    if owner < doc:
                        change[first + o] += 1
                        change[first + o + spans.window] -= 1
        return None if change is None else np.cumsum(change[:-1]) > 0


def _locate(window, phrase):
    """Rows of shards, passages before documents -> (id, n_words, n_removed, kept)."""

    def run(batches):
        shard, number = _Shard(phrase), None
        for batch in batches:
            names = batch.schema.names
            col = lambda c: batch.column(names.index(c))  # noqa: B023, E731
            id_type = batch.schema.field("id").type
            out = Out(pa.schema([pa.field("id", id_type), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()),
                                 pa.field("kept", pa.string())]))
            numbers, kinds, ids = col("shard").to_pylist(), col("kind").to_pylist(), col("id").to_pylist()
            spans, offsets, owners = col("span").to_pylist(), col("offsets").to_pylist(), col("owners").to_pylist()
            for b in vec.blocks(col("text"), vec.NON_SPACE, False):
                for d in range(b.rows):
                    i = b.row + d
                    if numbers[i] != number:
                        shard, number = _Shard(phrase), numbers[i]
                    h = b.hash[b.first[d]: b.first[d + 1]]
                    if not kinds[i]:
                        shard.add(tuple((h & np.uint64(0xFFFFFFFF)).tolist()), spans[i], offsets[i], owners[i])
                        continue
                    gone = shard.repeated(h, Spans(h, window, phrase), ids[i])
                    words = b.text(d).split()
                    n = 0 if gone is None else int(gone.sum())
                    if n:
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept = b" ".join(words).decode()
                    out.add(ids[i], len(h), n, kept, size=len(kept))
                    if out.full:
                        yield out.take()
            yield out.take()

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   phrase: int = PHRASE) -> DataFrame:
    """``id_col, n_words, n_removed, kept`` for every input row; ``kept`` holds the kept words joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; windows are judged on the input. Null and empty texts have no words;
    texts of fewer than ``window`` words lose none. Rows that share an id are one document (none is earlier than the
    other) and each keep their row; rows without an id lose nothing and count for nothing. Other columns are left
    out, whatever their names. An empty table gives an empty table.
    """
    if not 0 < phrase <= window:
        raise ValueError("phrase must be at most window words")
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = saved(docs.filter("id is not null").mapInArrow(_span_rows(window, phrase), f"id {id_type}, anchor bigint, span bigint"), "spans")
    span = spans.groupBy("anchor", "span").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
    anchor = span.groupBy("anchor").agg(F.min("owner").alias("lo"), F.max("last").alias("hi"), F.count(F.lit(1)).alias("kinds")).filter("lo <> hi")
    recurring = saved(span.join(anchor.select("anchor", "kinds"), "anchor")
                      .select("span", "owner", "last", (F.col("kinds") > 1).alias("split")), "recurring")

    wanted = recurring.groupBy("owner").agg(F.collect_list(F.struct("span", "split")).alias("spans"))
    passages = saved(docs.join(wanted.withColumnRenamed("owner", "id"), "id").select("id", "spans", "text")
                     .mapInArrow(_passage_rows(window, phrase), f"id {id_type}, span bigint, phrase string, windows array<bigint>")
                     .join(recurring.select("span", "last"), "span"), "passages")
    # each window of the spans that differ is owned by the first document with it
    win = passages.filter("windows is not null").select("id", "span", "last", F.posexplode("windows").alias("offset", "win"))
    owner = win.groupBy("win").agg(F.min("id").alias("owner"))
    owned = win.join(owner, "win").filter(F.col("owner") < F.col("last")).groupBy("span").agg(
        F.collect_list("offset").alias("offsets"), F.collect_list("owner").alias("owners"))
    none = F.lit(None).cast("array<int>")
    once = passages.dropDuplicates(["span"])
    agreed = once.filter(F.col("windows").isNull() & (F.col("id") < F.col("last"))).select(
        "span", "phrase", none.alias("offsets"), F.array("id").alias("owners"))
    confirmed = saved(agreed.unionByName(once.select("span", "phrase").join(owned, "span")), "confirmed")

    parts = shuffle_partitions(spark)
    shard = F.pmod(F.xxhash64("id"), F.lit(parts * SHARDS_PER_PARTITION)).cast("int")
    # a passage goes to the shards of the documents that have it; a passage of very many documents is folded to its
    # shards before it meets the confirmed ones
    needed = spans.select(shard.alias("shard"), "span").distinct().join(confirmed.select("span"), "span", "left_semi")
    sent = needed.join(confirmed, "span").select(
        "shard", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), "span", "offsets", "owners", F.col("phrase").alias("text"))
    streamed = docs.select(shard.alias("shard"), F.lit(1).alias("kind"), "id", F.lit(None).cast("bigint").alias("span"), none.alias("offsets"),
                           F.lit(None).cast(f"array<{id_type}>").alias("owners"), "text")
    out = sent.unionByName(streamed).repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(
        _locate(window, phrase), f"id {id_type}, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("id", id_col)


def brute_force(docs, window=WINDOW):
    """The same by plain Python, for tests: rows of (id, n_words, n_removed, kept)."""
    import re

    first: dict[tuple, int] = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in split:
        for j in range(len(w) - window + 1):
            key = tuple(w[j: j + window])
            if i is not None and (key not in first or i < first[key]):
                first[key] = i
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j: j + window])] < i:
                gone.update(range(j, j + window))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)

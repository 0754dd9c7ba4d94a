"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. A character language model: trigram counts of the letters of all documents (32 classes, so the table is
   bounded whatever the corpus).
2. Decoding: words with a letter and a sign or digit, with two doubled letters that are seldom doubled, with every letter
   doubled or with a letter three times running, and runs of single letters and signs are lattices: each sign may stand for several letters (or
   for nothing), each repetition may be dropped, each gap between single letters may be none. Viterbi takes the path most
   probable under the language model and the channel, over the whole word however long it is. What these costs leave alone
   stays as it is; other words have one path only.
3. Score: words and word beginnings of the restored text carry the log-odds of toxic against other labelled rows, by
   documents; a logistic regression over a text's ``TOP`` strongest words (those of three bytes or more) gives the probability. Both are fitted on
   a bounded sample (about ``per_label`` labelled rows of each class), three quarters of it for the odds, the rest for the regression.

Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .learn import counts, labelled, sample, share

CLASSES = 32
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)                  # bytes
TOP = 4
PER_LABEL = 12_000
_REMEMBERED = 64                      # characters of the longest words whose decoding is remembered

# What a sign may stand for: fixed values of the channel.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "ls", "*": "aeiou", "#": "h",
}
_SIGN_COST, _DROP_COST, _GAP_COST, _MARK_COST = -1.5, -9.0, -0.1, -0.1
_MARKS = "!|+(*#"                     # that close a word as often as they stand for a letter
# by how often the letter stood there before: (kept, dropped); doubled letters are ordinary, longer runs are not
_REPEAT_COSTS = ((0.0, -6.0), (-3.0, -0.5))
_RARE_COSTS = (-1.5, -1.5)            # letters that ordinary words seldom double
_ALL_COSTS = (-6.0, -0.1)             # in words of which every letter is doubled
_RARELY_DOUBLED = "aiuhjkqvwxy"


def letter_class(ch: str) -> int:
    """0: no letter; 1-26: a-z; 27-31: other letters."""
    if "a" <= ch <= "z":
        return ord(ch) - 96
    return 27 + ord(ch) % 5 if ch.isalpha() else 0


_TABLE = np.array([letter_class(chr(i)) for i in range(0x250)], np.uint8)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 0x250, _TABLE[np.minimum(c, 0x24F)], 0).astype(np.int32)


def _trigram_rows(batches):
    total = np.zeros(CLASSES ** 3, np.int64)
    for batch in batches:
        for t in batch.column(0):
            text = t.as_py() or ""
            for s in range(0, len(text), 1 << 18):
                c = _codes(f" {text[s: s + (1 << 18)]} ")
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["trigram", "n"])


@dataclass
class CharacterModel:
    """ln P(letter | two letters before), from trigram counts smoothed with bigrams and letters."""

    logp: np.ndarray                  # CLASSES x CLASSES x CLASSES

    @classmethod
    def of(cls, count: np.ndarray) -> CharacterModel:
        c3 = count.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + CLASSES)
        p2 = (c2 + 8 * p1) / (c2.sum(axis=1, keepdims=True) + 8)
        return cls(np.log((c3 + 4 * p2) / (c3.sum(axis=2, keepdims=True) + 4)))


# three times or more a letter twice, or thrice where its run ends: one way only to match a run, or long runs take exponential time
_ALL_DOUBLED = re.compile(r"(?:([^\W\d_])\1(?:\1(?!\1))?){3,}")
_RARE_PAIRS = re.compile(rf"([{_RARELY_DOUBLED}])\1")


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """The options of each character of an obfuscated token: (letter or nothing, ln P of the channel)."""
    out, before, run = [], "", 0
    closing = len(token.rstrip(_MARKS))
    doubled = _ALL_DOUBLED.fullmatch(token) is not None
    rare = len(_RARE_PAIRS.findall(token)) > 1
    for i, ch in enumerate(token):
        if ch == " ":
            out.append([("", _GAP_COST)])
            continue
        run = run + 1 if ch == before else 0
        if not ch.isalpha():
            twice = run == 1 and token[i + 1: i + 2] != ch            # two signs are two letters, more are one drawn out
            drop = -0.5 if ch not in SIGNS or (run and not twice) else _MARK_COST if i >= closing else _DROP_COST
            out.append([(x, _SIGN_COST) for x in SIGNS.get(ch, "")] + [("", drop)])
        elif run:
            longer = run > 1 or token[i + 1: i + 2] == ch
            keep, drop = _ALL_COSTS if doubled else _REPEAT_COSTS[1] if longer else _RARE_COSTS if rare and ch in _RARELY_DOUBLED else _REPEAT_COSTS[0]
            out.append([(ch, keep), ("", drop)])
        else:
            out.append([(ch, 0.0)])
        before = ch
    return out


def decode(token: str, model: CharacterModel) -> str:
    """The most probable letters of a token (Viterbi; a state is the last two letter classes). Paths are kept as links to the
    letter before, so a token of any length takes linear time and memory."""
    logp = model.logp
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(token):
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for letter, cost in options:
                if letter:
                    c = letter_class(letter)
                    state, value = (b, c), score + cost + logp[a, b, c]
                else:
                    state, value = (a, b), score + cost
                if state not in nxt or value > nxt[state][0]:
                    nxt[state] = (value, (path, letter) if letter else path)
        states = nxt
    _, path = max(((score + logp[a, b, 0], path) for (a, b), (score, path) in states.items()), key=lambda x: x[0])
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS if ord(c) < 128] + [ord(c) for c in "._-~^'`%&"]] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[0x30:0x3A] = True
_EDGE = re.compile(r"^[^\w@$!|+(€£*#]+|[^\w@$€£!|+(*#]+$")
_BRACKETS = re.compile(r"^[\W\d_]+|[\W\d_]+$")            # a word that only loses these stays as it is
_RARE = np.zeros(256, bool)
_RARE[[ord(c) for c in _RARELY_DOUBLED]] = True
_SINGLE = np.zeros(256, bool)          # signs that spelled letters are mixed with
_SINGLE[[ord(c) for c in "0123456789@$!|*#"]] = True


def _money(d: np.ndarray) -> np.ndarray:
    """First bytes of the signs beyond ASCII."""
    pound, euro = (np.zeros(len(d), bool) for _ in range(2))
    if len(d) > 2:
        pound[:-1] = (d[:-1] == 0xC2) & (d[1:] == 0xA3)
        euro[:-2] = (d[:-2] == 0xE2) & (d[1:-1] == 0x82) & (d[2:] == 0xAC)
    return pound | euro


def _char_bytes(first: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that starts with this byte."""
    return 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)


def _suspects(b: vec.Block) -> np.ndarray:
    """Numbers of the words that are lattices: a letter next to a sign or digit, a letter three times running, or doubled
    letters that are the whole word, or twice such as are seldom doubled."""
    d, low = b.data, vec.lower(b.data)
    if len(d) < 3:
        return np.zeros(0, np.int64)
    money = _money(d)
    # the bytes of a euro or pound sign are no letters
    letter = _LETTER[d] & ~money & ~(np.concatenate(([False], money[:-1]))) & ~((d == 0xAC) & np.concatenate(([False, False], money[:-2])))
    sign = (_SIGN | _DIGITS)[d] | money
    odd = np.zeros(len(d), bool)
    odd[:-1] |= sign[:-1] & letter[1:]
    # behind a letter: digits and signs that read as letters ("can't", "end." and "great!" are no such words)
    odd[1:] |= (_DIGITS[d[1:]] | _TAIL[d[1:]] | money[1:]) & letter[:-1]
    twice = (low[1:] == low[:-1]) & letter[1:] & (d[1:] < 128)
    odd[2:] |= twice[1:] & twice[:-1]
    at = np.flatnonzero(odd)
    # two letters or more that are seldom doubled
    rare = np.flatnonzero(np.concatenate(([False], twice & _RARE[low[1:]])))
    words, times = np.unique(np.searchsorted(b.start, rare, "right") - 1, return_counts=True)
    rare = words[(times > 1) & (words >= 0)]
    # every letter doubled: as many doubled places as half the word at least
    pairs = np.concatenate(([0], np.cumsum(np.concatenate(([False], twice)))))
    n = b.end - b.start
    every = np.flatnonzero((n >= 6) & (2 * (pairs[b.end] - pairs[b.start + 1]) >= n)) if len(n) else at
    words = np.searchsorted(b.start, at, "right") - 1
    return np.unique(np.concatenate([words[words >= 0], every, rare]))


_TAIL = np.zeros(256, bool)
_TAIL[[ord("@"), ord("$")]] = True


def _spelled(b: vec.Block) -> list[tuple[int, int]]:
    """Ranges of words of a run of at least three single letters and signs, at least two and half of them letters (the last of
    a run with or without a mark behind)."""
    n = b.end - b.start
    if not len(n):
        return []
    first = b.data[b.start]
    size = _char_bytes(first)
    money = _money(b.data)[b.start]
    letter = _LETTER[first] & ~money & ((n == size) | ((n == size + 1) & ~_LETTER[b.data[b.end - 1]]))
    sign = (money & (n == size)) | (_SINGLE[first] & (n == 1))
    letters = np.concatenate(([0], np.cumsum(letter)))
    one = np.concatenate(([False], letter | sign, [False]))
    flips = np.flatnonzero(one[1:] != one[:-1])
    runs = []
    for s, e in zip(flips[0::2].tolist(), flips[1::2].tolist(), strict=True):
        for x, y in _split_at(b.first, s, e):
            many = int(letters[y] - letters[x])
            if y - x >= 3 and many >= 2 and 2 * many >= y - x:
                runs.append((x, y))
    return runs


def _split_at(first: np.ndarray, s: int, e: int):
    cuts = [s, *first[(first > s) & (first < e)].tolist(), e]
    return zip(cuts[:-1], cuts[1:], strict=True)


class Restorer:
    """Restores texts; decoded tokens are remembered, as the same ones come again."""

    def __init__(self, model: CharacterModel):
        self.known = lru_cache(maxsize=100_000)(lambda token: decode(token, model))
        self.model = model

    def decode(self, token: str) -> str:
        return self.known(token) if len(token) <= _REMEMBERED else decode(token, self.model)

    def block(self, b: vec.Block) -> list[bytes]:
        """The restored text of every row of a block, cut into words by white space."""
        change: dict[int, list[tuple[int, int, bytes]]] = {}
        runs = _spelled(b)
        inside = {w for s, e in runs for w in range(s, e)}
        for s, e in runs:
            d = int(np.searchsorted(b.first, s, "right")) - 1
            token = b.data[b.start[s]: b.end[e - 1]].tobytes().decode("utf-8", "replace").lower()
            change.setdefault(d, []).append((int(b.start[s]), int(b.end[e - 1]), self.decode(_EDGE.sub("", " ".join(token.split()))).encode()))
        for w in _suspects(b).tolist():
            if w < 0 or w in inside:
                continue
            token = _EDGE.sub("", b.data[b.start[w]: b.end[w]].tobytes().decode("utf-8", "replace").lower())
            if token and not token.isdigit() and (new := self.decode(token)) != _BRACKETS.sub("", token):
                d = int(np.searchsorted(b.first, w, "right")) - 1
                change.setdefault(d, []).append((int(b.start[w]), int(b.end[w]), new.encode()))
        out = []
        for d in range(b.rows):
            if d not in change:
                out.append(b.text(d))
                continue
            done, parts = int(b.at[d]), []
            for s, e, new in sorted(change[d]):
                parts += [b.data[done:s].tobytes(), new]
                done = e
            out.append(b"".join([*parts, b.data[done: b.at[d + 1] - 1].tobytes()]))
        return out


def restore_text(text: str, model: CharacterModel) -> str:
    """One text, restored."""
    b = next(vec.blocks(pa.array([text]), vec.NON_SPACE, False))
    return Restorer(model).block(b)[0].decode()


def _word_buckets(b: vec.Block) -> np.ndarray:
    """Buckets of each word of three bytes or more: the word and its beginnings; shape words x features."""
    n = b.end - b.start
    cols = [b.hash]
    low = vec.lower(b.data)
    for p in PREFIXES:
        part = vec.hash_spans(low, b.start, b.start + np.minimum(n, p))
        cols.append(np.where(n > p, vec.mix(part ^ vec.U64(p * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), b.hash))
    return (np.stack(cols, axis=1) >> np.uint64(64 - 18)).astype(np.int64) if len(n) else np.zeros((0, 1 + len(PREFIXES)), np.int64)


def _restored_blocks(column, restorer: Restorer):
    """Blocks of the words of the restored texts, with the row that each starts at."""
    for b in vec.blocks(column, vec.NON_SPACE, False):
        for r in vec.blocks(pa.array(restorer.block(b), pa.large_binary()), vec.ALNUM, True):
            yield b.row + r.row, r


def _count_rows(shared):
    """(label, text) -> (bucket, toxic documents, other documents), summed over the task."""

    def run(batches):
        restorer = Restorer(shared.value)
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for row, b in _restored_blocks(batch.column(1), restorer):
                buckets = _word_buckets(b)
                for d in range(b.rows):
                    seen[labels[row + d], np.unique(buckets[b.first[d]: b.first[d + 1]])] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[1, at]), pa.array(seen[0, at])],
                                         names=["bucket", "toxic", "other"])

    return run


@dataclass
class Model:
    characters: CharacterModel
    odds: np.ndarray                  # BUCKETS log-odds
    weights: np.ndarray               # of the strongest words, and the bias

    def evidence(self, column, restorer: Restorer) -> np.ndarray:
        """Per row: the log-odds of its TOP strongest words, strongest first (0 where there are fewer)."""
        out = np.zeros((len(column), TOP))
        for row, b in _restored_blocks(column, restorer):
            buckets = _word_buckets(b)
            odds = self.odds[buckets].max(axis=1) if len(buckets) else np.zeros(0)
            odds[b.end - b.start < 3] = 0
            for d in range(b.rows):
                own = odds[b.first[d]: b.first[d + 1]]
                k = min(TOP, len(own))
                if k:
                    out[row + d, :k] = np.maximum(0, np.sort(np.partition(own, len(own) - k)[len(own) - k:])[::-1])
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _evidence_rows(shared):
    def run(batches):
        model = shared.value
        restorer = Restorer(model.characters)
        for batch in batches:
            x = model.evidence(batch.column(2), restorer)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "weight", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-5, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last weight is the bias."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, weight = np.zeros(a.shape[1]), weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (weight * (p - y)) + l2 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def character_model(texts: DataFrame, text_col: str = "text") -> CharacterModel:
    """Counts of all texts (at most CLASSES ** 3 rows reach the driver)."""
    count = np.zeros(CLASSES ** 3, np.int64)
    for r in texts.select(text_col).mapInArrow(_trigram_rows, "trigram int, n bigint").groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        count[r["trigram"]] = r["n"]
    return CharacterModel.of(count)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_label: int = PER_LABEL) -> Model:
    """Learn from the texts of ``docs``: the language model from all of them, the rest from those whose ids ``labels``
    marks 0 or 1 (rows without id or label are left out, null texts count as empty), about ``per_label`` of each.
    With one class only, or no rows, every score is that class's, or 0.5."""
    spark = docs.sparkSession
    characters = character_model(docs, text_col)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    n = counts(marks, "label")
    if len(n) < 2:
        return Model(characters, np.zeros(BUCKETS, np.float32), np.array([0.0] * TOP + [0.0 if not n else 4.0 if 1 in n else -4.0]))
    rows = labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sample(marks, "id", "label", per_label, n))
    counted = share("id", 2) >= 0.25                    # the others fit the regression
    shared = spark.sparkContext.broadcast(characters)
    toxic, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    got = rows.filter(counted).select("label", "text").mapInArrow(_count_rows(shared), "bucket int, toxic bigint, other bigint")
    for r in got.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).collect():   # at most BUCKETS rows
        toxic[r["bucket"]], other[r["bucket"]] = r["toxic"], r["other"]
    own = counts(sample(marks, "id", "label", per_label, n).filter(counted), "label")
    odds = np.log((toxic + 0.5) / (own.get(1, 0) + 1)) - np.log((other + 0.5) / (own.get(0, 0) + 1))
    odds[toxic + other == 0] = 0
    model = Model(characters, odds.astype(np.float32), np.zeros(TOP + 1))
    left = rows.filter(~counted).select("label", "weight", "text").mapInArrow(
        _evidence_rows(spark.sparkContext.broadcast(model)), "label int, weight double, x array<double>").collect()
    if len({r["label"] for r in left}) == 2:
        model.weights = _logistic(np.array([r["x"] for r in left]), np.array([r["label"] for r in left]), np.array([r["weight"] for r in left]))
    else:
        model.weights = np.array([1.0, *[0.0] * (TOP - 1), -3.0])
    return model


def _score_rows(shared):
    def run(batches):
        model = shared.value
        restorer = Restorer(model.characters)
        for batch in batches:
            scores = model.scores(model.evidence(batch.column(1), restorer))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for every input row (higher: label 1 likelier), no shuffle.

    Null texts count as empty; an empty text has no evidence and so the lowest score. Repeated rows and null ids are
    kept as they come; other columns are left out. An empty table gives an empty table.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _score_rows(shared), f"id {kind}, score double").withColumnRenamed("id", id_col)

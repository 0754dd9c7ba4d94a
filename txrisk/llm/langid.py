"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased characters give n-grams of 1 to 3, hashed to ``BUCKETS``; a text is the vector of (1 + ln count) * idf, of length 1.
Document frequencies count all training rows; the regression is fitted on a bounded sample
(about ``per_lang`` rows of each language) by follow-the-regularised-leader with L1 and L2 penalties, so most
weights are exactly 0. A temperature fitted on sample rows that were not trained on calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import counts, sample

BUCKETS = 1 << 15
PER_LANG = 1500
UNKNOWN = "und"
_SHIFT = np.uint64(64 - 15)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SEGMENT = 1 << 18


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in a text, and how often."""
    total = None
    for s in range(0, max(1, len(text)), _SEGMENT):
        c = np.frombuffer(text[s: s + _SEGMENT + 2].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        own = max(0, min(_SEGMENT, len(text) - s))
        one = (c + np.uint64(1)) * _M1
        two = (one[:-1] ^ (c[1:] + np.uint64(7))) * _M2
        three = (two[:-1] ^ (c[2:] + np.uint64(13))) * _M3
        # the lower-cased text may be longer: keep what starts in this segment, all of it in the last one
        last = s + _SEGMENT >= len(text)
        part = [x if last else x[:own] for x in (one, two, three)]
        got = np.bincount((np.concatenate(part) >> _SHIFT).astype(np.int64), minlength=BUCKETS)
        total = got if total is None else total + got
    at = np.flatnonzero(total)
    return at, total[at]


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _df_rows(batches):
    """text -> (bucket, texts with it), summed over the task."""
    seen = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for t in batch.column(0):
            seen[ngram_counts(t.as_py())[0]] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["bucket", "df"])


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = ngram_counts(text)
    v = (1 + np.log(n)) * idf[at]
    norm = float(np.sqrt(v @ v))
    return at, (v / norm if norm else v).astype(np.float32)


def _vectors(shared):
    def run(batches) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            got = [_vector(t.as_py(), idf) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()),
                                              pa.array([v.tobytes() for _, v in got], pa.binary())], names=["lang", "at", "v"])

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Ftrl:
    """Follow-the-regularised-leader (per-coordinate rates) for multinomial logistic regression."""

    features: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z = np.zeros((self.features, self.classes))
        self.n = np.zeros((self.features, self.classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, v: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = _softmax(v @ w)
        p[y] -= 1
        g = np.outer(v, p)
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray           # BUCKETS x langs, mostly 0
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not _has_letter(text):
            return UNKNOWN, 0.0
        at, v = _vector(text, self.idf)
        p = _softmax((v @ self.weights[at]) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that were not trained on."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG,
        epochs: int = 3) -> Model:
    """Learn from ``train`` (rows with a null text, language or id, or without a letter, are left out)."""
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna().filter(
        F.col("text").rlike(r"\p{L}"))
    n = counts(rows, "lang")
    langs = sorted(n)
    df = np.zeros(BUCKETS)
    for r in rows.select("text").mapInArrow(_df_rows, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r["bucket"]] = r["df"]                      # at most BUCKETS rows
    idf = np.log((1 + sum(n.values())) / (1 + df)) + 1
    shared = rows.sparkSession.sparkContext.broadcast(idf)
    got = sample(rows, "id", "lang", per_lang, n).orderBy(F.xxhash64("id")).select("lang", "text").mapInArrow(
        _vectors(shared), "lang string, at binary, v binary").collect()
    data = [(langs.index(r["lang"]), np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float32)) for r in got]
    model = Ftrl(BUCKETS, max(1, len(langs)))
    spare = [d for i, d in enumerate(data) if i % 5 == 0]
    for _ in range(epochs if len(langs) > 1 else 0):
        for i, (y, at, v) in enumerate(data):
            if i % 5:
                model.step(at, v, y)
    w = model.weights()
    logits = np.array([v @ w[at] for _, at, v in spare]) if spare else np.zeros((0, 1))
    return Model(langs, idf, w, _temperature(logits, np.array([d[0] for d in spare], int)))


def _predict_rows(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                                             names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every input row, no shuffle.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. Repeated rows and
    null ids are kept as they come; other columns are left out. An empty table gives an empty table.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _predict_rows(shared), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), where the pair sum is taken in linear time as
half of (sum v_i x_i)^2 - sum v_i^2 x_i^2 in each of ``RANK`` dimensions. It is fitted by adaptive gradient steps on a
bounded sample (about ``per_label`` labelled rows of each class) and shifted to the class shares of all
labelled training rows. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .learn import counts, labelled, sample

WORDS = 1 << 14
RANK = 8
PER_LABEL = 3000
STATISTICS = ("upper share", "digit share", "symbol share", "space share", "wide share", "word length", "words", "distinct words",
              "commonest word", "repeated lines", "line length", "words with a symbol", "one-letter words")
_UPPER, _DIGIT, _WIDE = np.zeros(256, bool), np.zeros(256, bool), np.arange(256) >= 128
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_SYMBOL = ~(vec.ALNUM | _UPPER | ~vec.NON_SPACE)
_CLASSES = np.stack([_UPPER, _DIGIT, _SYMBOL, ~vec.NON_SPACE, _WIDE]).astype(np.float64)


def features(block: vec.Block, d: int, meta: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text's features: words first, then statistics, then metadata."""
    lo, hi = int(block.first[d]), int(block.first[d + 1])
    raw = block.data[block.at[d]: block.at[d + 1] - 1]
    h = block.hash[lo:hi]
    at, n = np.unique((h >> np.uint64(50)).astype(np.int64), return_counts=True)
    x = np.log1p(n)
    x = x / np.sqrt(x @ x) if len(x) else x
    size, words = max(1, len(raw)), max(1, hi - lo)
    shares = _CLASSES @ np.bincount(raw, minlength=256) / size if len(raw) else np.zeros(5)
    start, end = block.start[lo:hi], block.end[lo:hi]
    lines = raw.tobytes().split(b"\n")
    odd = np.cumsum(np.concatenate(([0], _SYMBOL[raw])))
    inside = odd[end - block.at[d]] - odd[start - block.at[d]]
    stats = np.array([*shares, float((end - start).sum()) / words / 10, np.log1p(hi - lo) / 10, len(np.unique(h)) / words,
                      (n.max() if len(n) else 0) / words, 1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)) / 10,
                      float((inside > 0).mean()) if hi > lo else 0.0, float((end - start == 1).mean()) if hi > lo else 0.0, *meta])
    return np.concatenate((at, WORDS + np.arange(len(stats)))), np.concatenate((x, stats))


def _meta(batch, names: list[str]) -> list[list[float]]:
    """Metadata numbers by row: signed ln(1 + |x|) / 10, null as 0."""
    cols = [np.array([0.0 if v is None else float(v) for v in batch.column(batch.schema.names.index(c)).to_pylist()]) for c in names]
    return np.stack([np.sign(c) * np.log1p(np.abs(c)) / 10 for c in cols], axis=1).tolist() if cols else [[]] * batch.num_rows


def _feature_rows(n_meta):
    def run(batches):
        for batch in batches:
            meta = _meta(batch, [f"m{i}" for i in range(n_meta)])
            at, x = [], []
            for b in vec.blocks(batch.column(batch.schema.names.index("text")), vec.NON_SPACE, True):
                for d in range(b.rows):
                    a, v = features(b, d, meta[b.row + d])
                    at.append(a.astype(np.int32).tobytes())
                    x.append(v.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(x, pa.binary())], names=["order", "label", "at", "x"])

    return run


@dataclass
class Machine:
    """The factorisation machine; ``shift`` moves the balanced sample's odds to those of all labelled rows."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    shift: float = 0.0

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.v[at]
        s = x @ v
        return float(self.bias + x @ self.w[at] + 0.5 * (s @ s - (x * x) @ (v * v).sum(axis=1)))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(at, x) + self.shift, -40, 40))))


def fit_machine(data: list[tuple[int, np.ndarray, np.ndarray]], size: int, rank: int = RANK, epochs: int = 6, rate: float = 0.1,
                l2: float = 1e-5, seed: int = 3) -> Machine:
    """Adaptive gradient descent on the log loss, over the rows in a fixed shuffled order."""
    rng = np.random.Generator(np.random.PCG64(seed))
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            y, at, x = data[i]
            v = m.v[at]
            s = x @ v
            z = m.bias + x @ m.w[at] + 0.5 * (s @ s - (x * x) @ (v * v).sum(axis=1))
            e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
            if abs(e) < 1e-3:
                continue
            dw = e * x + l2 * m.w[at]
            dv = e * (x[:, None] * s - (x * x)[:, None] * v) + l2 * v
            gw[at] += dw * dw
            gv[at] += dv * dv
            gb += e * e
            m.w[at] -= rate * dw / np.sqrt(gw[at])
            m.v[at] -= rate * dv / np.sqrt(gv[at])
            m.bias -= rate * e / np.sqrt(gb)
    return m


def _input(df: DataFrame, text_col: str, meta_cols: tuple[str, ...]) -> list:
    return [*[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(meta_cols)], F.col(text_col).alias("text")]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        meta_cols: tuple[str, ...] = ("n_chars",), per_label: int = PER_LABEL) -> Machine:
    """Learn from the texts of ``docs`` whose ids ``labels`` marks 0 or 1 (rows without id or label are left out, null
    texts count as empty). With one class only, or no rows, every score is that class's, or 0.5."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    n = counts(marks, "label")
    size = WORDS + len(STATISTICS) + len(meta_cols)
    if len(n) < 2:
        return Machine(0.0 if not n else 4.0 if 1 in n else -4.0, np.zeros(size), np.zeros((size, RANK)))
    texts = docs.select(F.col(id_col).alias("id"), *_input(docs, text_col, meta_cols))
    got = labelled(texts, sample(marks, "id", "label", per_label, n)).select(
        F.xxhash64("id").alias("order"), "label", *[f"m{i}" for i in range(len(meta_cols))], "text").mapInArrow(
        _feature_rows(len(meta_cols)), "order bigint, label int, at binary, x binary").collect()
    got.sort(key=lambda r: (r["order"], r["label"], r["at"]))     # whatever the partitions
    data = [(r["label"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(np.float64)) for r in got]
    m = fit_machine(data, size)
    have = {k: sum(1 for y, _, _ in data if y == k) for k in (0, 1)}
    if all(have.values()):
        m.shift = float(np.log(n[1] / n[0]) - np.log(have[1] / have[0]))
    return m


def _score_rows(shared, n_meta):
    def run(batches):
        m = shared.value
        for batch in batches:
            meta, scores = _meta(batch, [f"m{i}" for i in range(n_meta)]), []
            for b in vec.blocks(batch.column(batch.schema.names.index("text")), vec.NON_SPACE, True):
                scores += [m.score(*features(b, d, meta[b.row + d])) for d in range(b.rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
          meta_cols: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """``id_col, score`` for every input row (higher: label 1 likelier), no shuffle.

    Null texts count as empty, which are scored like any text. Repeated rows and null ids are kept as they come;
    other columns are left out. An empty table gives an empty table.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(machine)
    return df.select(F.col(id_col).alias("id"), *_input(df, text_col, meta_cols)).mapInArrow(
        _score_rows(shared, len(meta_cols)), f"id {kind}, score double").withColumnRenamed("id", id_col)


def _filter_rows(shared, text_col, meta_cols, least):
    def run(batches):
        m = shared.value
        for batch in batches:
            meta, keep = _meta(batch, list(meta_cols)), []
            for b in vec.blocks(batch.column(batch.schema.names.index(text_col)), vec.NON_SPACE, True):
                keep += [m.score(*features(b, d, meta[b.row + d])) >= least for d in range(b.rows)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_good(df: DataFrame, machine: Machine, text_col: str = "text", meta_cols: tuple[str, ...] = ("n_chars",), least: float = 0.5) -> DataFrame:
    """The rows of ``df`` with a score of ``least`` or more, with all their columns; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    return df.mapInArrow(_filter_rows(shared, text_col, meta_cols, least), df.schema)

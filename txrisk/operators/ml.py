"""Model operators (M1-M17, W11, O10) on Spark ML and DataFrames.

* Encoders (M1/M2) are small lookup tables (value -> index, values sorted)
  built with a distributed rank, applied by a join; unseen values get -1.
* Scaling (M3) uses population mean / std (A22); std 0 counts as 1.
* Training (M6-M8) is Spark MLlib with balanced class weights (M5) as
  ``weightCol``; the stratified split (M4) is exact per class and ranks by a
  seeded hash with the distributed ranking of :mod:`ranking`.
* Metrics (M11-M15) are aggregates over confusion counts; AUC is the exact
  Mann-Whitney statistic with ties from prefix sums over distinct scores.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from .ranking import distributed_rank, key_boundaries, prefix_sums
from .stats import fit_scaler


# ---------------------------------------------------------------- M1 / M2
def fit_encoder(df: DataFrame, cols: Sequence[str] = S.CATEGORICAL_FEATURES,
                materialize: bool = True) -> dict[str, DataFrame]:
    """M1: per column, a table (value, index) with index = position of the value in sorted order.

    The fitted tables are model state: with ``materialize`` they are written
    once with a reliable ``checkpoint()`` to the shared checkpoint folder, so
    every later ``encode`` (and its size check) reads the small table instead
    of re-running the distinct + rank over the training data.
    """
    from ..session import checkpoint_dir

    if materialize:
        checkpoint_dir(df.sparkSession)
    # all columns in one pass: (column, value) pairs, ranked within each column
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p"))
    values = pairs.select("p.*").filter(F.col("value").isNotNull()).distinct()
    ranked = distributed_rank(values, "value", ["column"], rank_col="_r", n_col="_n")
    table = ranked.select("column", "value", (F.col("_r") - 1).cast("int").alias("index"))
    if materialize:
        table = table.checkpoint(eager=True)
    return {c: table.filter(F.col("column") == F.lit(c)).select("value", "index") for c in cols}


def encode(df: DataFrame, encoders: dict[str, DataFrame], unseen: int = -1, suffix: str = "_encoded") -> DataFrame:
    """M2: ``<col>_encoded`` from the encoder tables; values not seen at fit time -> ``unseen``."""
    from .joins import broadcast_measured

    out = df
    for c, table in encoders.items():
        # category tables are normally small (their bytes are measured): broadcast, also as the static side of a stream join
        t = broadcast_measured(table.select(F.col("value").alias(f"_v_{c}"), F.col("index").alias(f"_i_{c}")))
        out = (out.join(t, out[c] == t[f"_v_{c}"], "left")
               .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"_i_{c}"), F.lit(unseen)))
               .drop(f"_v_{c}", f"_i_{c}"))
    return out


def preprocess(df: DataFrame, encoders: dict[str, DataFrame], label: str = "label",
               feature_names: Sequence[str] = S.MODEL_FEATURES) -> tuple[DataFrame, str]:
    """P11 + M2 + P2 + P3: encoded features in model order (missing ones as 0), label kept
    apart; the raw categorical columns are dropped."""
    from .quality import ensure_columns

    out = encode(df, encoders).drop(*[c for c in encoders if c in df.columns])
    out = ensure_columns(out, feature_names, 0)
    return out.select(*feature_names, label), label


# ---------------------------------------------------------------- M3
def scaler_values(stats: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The fitted scaler as numbers (one row of 2 x len(cols) values; bounded)."""
    row = stats.first()
    return {c: (row[f"{c}_mean"], row[f"{c}_std"]) for c in cols}


def scale_with(df: DataFrame, values: dict[str, tuple[float, float]], suffix: str = "_scaled") -> DataFrame:
    """M3 with literal statistics (usable on streams)."""
    out = {}
    for c, (mean, std) in values.items():
        std = 1.0 if (std is None or std == 0) else std
        mean = 0.0 if mean is None else mean
        out[f"{c}{suffix}"] = (F.col(c).cast("double") - F.lit(mean)) / F.lit(std)
    return df.withColumns(out)


# ---------------------------------------------------------------- M4 / M5
def stratified_split(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M4: exact per-class split: in each class the round(fraction * n_class) rows with the
    smallest seeded hash of ``id_col`` (60 bits of an MD5) go to the test set. Deterministic."""
    digest = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    h = df.withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    ranked = distributed_rank(h, "_h", [label], rank_col="_r", n_col="_n")
    # rank over the hash: ties (hash collisions) share a rank and stay together.
    is_test = F.col("_r") <= F.round(F.lit(test_fraction) * F.col("_n"))
    tagged = ranked.withColumn("_test", is_test).drop("_h", "_r", "_n")
    return tagged.filter(~F.col("_test")).drop("_test"), tagged.filter(F.col("_test")).drop("_test")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """M5: weight n / (k * n_class) per row. The class table has one row per class; AQE joins it by its
    measured size."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.select(label, "_nc", totals.select(F.struct("_n", "_k")).scalar().alias("_t"))
    w = w.select(label, (F.col("_t._n") / (F.col("_t._k") * F.col("_nc"))).alias(out))
    return df.join(w, label, "left")


# ---------------------------------------------------------------- model
@dataclass
class FraudModel:
    pipeline: object                      # pyspark.ml.PipelineModel
    encoders: dict[str, DataFrame]
    scaler: dict[str, tuple[float, float]]
    feature_names: list[str]
    model_type: str
    version: str
    metrics: dict = field(default_factory=dict)
    training_date: str | None = None


NUMERIC_FEATURES = [f for f in S.MODEL_FEATURES if not f.endswith("_encoded")]


def model_frame(df: DataFrame, user_stats: DataFrame | None = None) -> DataFrame:
    """Serving features (F24) for scoring or training, computed when missing."""
    from .features import serving_features

    if not set(NUMERIC_FEATURES).issubset(df.columns):
        df = serving_features(df, user_stats)
    return df


def _prepared(df: DataFrame, encoders, scaler, feature_names) -> DataFrame:
    out = encode(df, encoders)
    out = out.withColumns({c: F.col(c).cast("double") for c in feature_names})
    return scale_with(out, {c: scaler[c] for c in feature_names}, suffix="_scaled")


def train(df: DataFrame, label: str = "label", kind: str = "random_forest", seed: int = 42,
          feature_names: Sequence[str] = S.MODEL_FEATURES, version: str | None = None,
          **params) -> FraudModel:
    """M6-M8 (+M1, M3, M5): fit encoders, scaler and the classifier on a labelled feature frame."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    feature_names = list(feature_names)
    encoders = fit_encoder(df, S.CATEGORICAL_FEATURES)
    encoded = encode(df, encoders).withColumns({c: F.col(c).cast("double") for c in feature_names})
    scaler = scaler_values(fit_scaler(encoded, feature_names), feature_names)
    data = scale_with(encoded, scaler, suffix="_scaled")
    data = data.withColumn("_label", F.col(label).cast("double"))
    data = balanced_weights(data, "_label", "_weight")
    cols = [f"{c}_scaled" for c in feature_names] + ["_label", "_weight"]
    # MLlib passes over the data many times: keep the narrow training frame
    # (13 doubles + label + weight) instead of recomputing encoders and joins per
    # pass; lost blocks are recomputed from lineage. Tree learners also
    # checkpoint their state to the shared checkpoint folder every 10 iterations.
    from pyspark import StorageLevel
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    data = data.select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
    assembler = VectorAssembler(inputCols=[f"{c}_scaled" for c in feature_names], outputCol="features",
                                handleInvalid="keep")
    if kind == "random_forest":
        clf = RandomForestClassifier(labelCol="_label", featuresCol="features", weightCol="_weight",
                                     numTrees=params.get("numTrees", 100), maxDepth=params.get("maxDepth", 10),
                                     seed=seed, checkpointInterval=10)
    elif kind == "gradient_boosting":
        clf = GBTClassifier(labelCol="_label", featuresCol="features", maxIter=params.get("maxIter", 100),
                            maxDepth=params.get("maxDepth", 5), stepSize=params.get("stepSize", 0.1), seed=seed,
                            checkpointInterval=10)
    elif kind == "logistic":
        clf = LogisticRegression(labelCol="_label", featuresCol="features", weightCol="_weight",
                                 maxIter=params.get("maxIter", 1000))
    else:
        raise ValueError(f"unknown model kind: {kind}")
    try:
        pipeline = Pipeline(stages=[assembler, clf]).fit(data)
    finally:
        data.unpersist()
    return FraudModel(pipeline, encoders, scaler, feature_names, kind, version or f"{kind}_model")


def predict(df: DataFrame, model: FraudModel) -> DataFrame:
    """M9 (+M10 version): ``fraud_score`` = P(fraud), ``is_fraud`` = predicted class, ``model_version``.

    Works on streaming frames: encoders are stream-static joins, the scaler is literals.
    """
    from pyspark.ml.functions import vector_to_array

    base = model_frame(df)
    prepared = _prepared(base, model.encoders, model.scaler, model.feature_names)
    scored = model.pipeline.transform(prepared)
    out = scored.withColumns({
        "fraud_score": vector_to_array(F.col("probability")).getItem(1),
        "is_fraud": F.col("prediction") == F.lit(1.0),
        "model_version": F.lit(model.version),
    })
    drop = ["features", "rawPrediction", "probability", "prediction"] + \
           [f"{c}_scaled" for c in model.feature_names]
    return out.drop(*drop)


# ---------------------------------------------------------------- metrics
def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """TP, FP, FN, TN (per group) in one aggregation."""
    y = F.col(label).cast("int") == 1
    p = F.col(prediction).cast("int") == 1
    return df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """M11 from confusion counts: accuracy, precision, recall, f1 (0 on empty denominators)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return counts.withColumns({
        "n": (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("long"),
        "accuracy": _safe_div(tp + tn, n),
        "precision": _safe_div(tp, tp + fp),
        "recall": _safe_div(tp, tp + fn),
        "f1_score": _safe_div(2 * tp, 2 * tp + fp + fn),
    })


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (per group when ``by`` is given)."""
    return metrics_from_counts(confusion_counts(df, label, prediction, by))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows actual 0/1, columns predicted 0/1 (zeros filled)."""
    return (df.select(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("_p"))
            .groupBy("actual").pivot("_p", [0, 1]).count().na.fill(0)
            .withColumnRenamed("0", "predicted_0").withColumnRenamed("1", "predicted_1"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 names: tuple[str, str] = ("Normal", "Fraud")) -> DataFrame:
    """Precision / recall / f1 / support per class, accuracy, macro avg, weighted avg."""
    m = metrics_from_counts(confusion_counts(df, label, prediction))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    # class 0 sees the matrix mirrored
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f0 = _safe_div(2 * tn, 2 * tn + fn + fp)
    p1, r1, f1 = F.col("precision"), F.col("recall"), F.col("f1_score")
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    rows = m.select(
        F.array(
            F.struct(F.lit(names[0]).alias("class"), p0.alias("precision"), r0.alias("recall"),
                     f0.alias("f1_score"), s0.alias("support")),
            F.struct(F.lit(names[1]).alias("class"), p1.alias("precision"), r1.alias("recall"),
                     f1.alias("f1_score"), s1.alias("support")),
            F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1_score"),
                     n.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"),
                     ((r0 + r1) / 2).alias("recall"), ((f0 + f1) / 2).alias("f1_score"), n.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), _safe_div(p0 * s0 + p1 * s1, n).alias("precision"),
                     _safe_div(r0 * s0 + r1 * s1, n).alias("recall"),
                     _safe_div(f0 * s0 + f1 * s1, n).alias("f1_score"), n.alias("support")),
        ).alias("r"))
    return rows.select(F.explode("r").alias("r")).select("r.*")


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score (hot scores fold map-side)."""
    y = F.col(label).cast("int") == 1
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC-AUC (ties count one half), one row ``roc_auc``."""
    pre = prefix_sums(score_counts(df, label, score), "score", ["neg"], bounds=key_boundaries(df, score))
    contrib = pre.agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.lit(0.5) * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return contrib.select(F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                 F.col("_u") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, scores descending:
    cumulative true / false positives at or above each threshold. Every distinct
    threshold is returned (no dropping of collinear points, no extra (0, 0) start
    point); the curve through these points is the same."""
    pre = prefix_sums(score_counts(df, label, score), "score", ["pos", "neg"], descending=True,
                      bounds=key_boundaries(df, score))
    return pre.select(F.col("score").alias("threshold"),
                      _safe_div(F.col("neg_upto").cast("double"), F.col("neg_total")).alias("fpr"),
                      _safe_div(F.col("pos_upto").cast("double"), F.col("pos_total")).alias("tpr"))


# ---------------------------------------------------------------- importances / persistence
def feature_importance(model: FraudModel, spark: SparkSession) -> DataFrame:
    """(feature, importance) rows from a tree model (empty for logistic regression)."""
    clf = model.pipeline.stages[-1]
    if not hasattr(clf, "featureImportances"):
        return spark.createDataFrame([], "feature string, importance double")
    imp = clf.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(model.feature_names, [float(x) for x in imp])),
                                 "feature string, importance double")


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    """The n largest importances. Accepts (feature, importance) rows or a
    ``feature_importance`` map column (exploded first)."""
    if "feature_importance" in importances.columns:
        importances = importances.select(F.explode("feature_importance").alias("feature", "importance"))
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)


def save_model(model: FraudModel, path: str, spark: SparkSession) -> str:
    """Pipeline, encoder tables and metadata (JSON) under ``path`` (any Hadoop file system)."""
    model.pipeline.write().overwrite().save(os.path.join(path, "pipeline"))
    for c, table in model.encoders.items():
        table.write.mode("overwrite").parquet(os.path.join(path, "encoders", c))
    meta = {
        "model_type": model.model_type, "feature_names": model.feature_names, "version": model.version,
        "training_date": model.training_date, "metrics": model.metrics,
        "scaler": {c: list(v) for c, v in model.scaler.items()},
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "metadata"))
    return path


def load_model(path: str, spark: SparkSession) -> FraudModel:
    """Load what :func:`save_model` wrote."""
    from pyspark.ml import PipelineModel

    pipeline = PipelineModel.load(os.path.join(path, "pipeline"))
    meta = json.loads(spark.read.text(os.path.join(path, "metadata")).first()["value"])
    encoders = {c: spark.read.parquet(os.path.join(path, "encoders", c)) for c in S.CATEGORICAL_FEATURES}
    scaler = {c: tuple(v) for c, v in meta["scaler"].items()}
    return FraudModel(pipeline, encoders, scaler, meta["feature_names"], meta["model_type"], meta["version"],
                      meta.get("metrics", {}), meta.get("training_date"))


def evaluate(model: FraudModel, test: DataFrame, label: str = "label") -> dict:
    """Metrics of a model on a labelled frame (one small aggregation, returned as a dict)."""
    pred = predict(test, model).select(F.col(label).cast("double").alias("_label"),
                                       F.col("is_fraud").cast("int").alias("_pred"), "fraud_score").persist()
    try:   # predictions computed once for both metrics (recomputed from lineage if lost)
        m = binary_metrics(pred, "_label", "_pred").first()
        auc = roc_auc(pred, "_label", "fraud_score").first()["roc_auc"]
    finally:
        pred.unpersist()
    return {"accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"],
            "f1_score": m["f1_score"], "roc_auc": auc}


def model_input(df: DataFrame) -> DataFrame:
    """The model's feature columns from either feature bundle: the batch bundle holds the user's transaction count as
    ``user_tx_count``, which is the serving bundle's ``user_frequency``."""
    if "user_frequency" not in df.columns and "user_tx_count" in df.columns:
        return df.withColumn("user_frequency", F.col("user_tx_count").cast("int"))
    return df


def train_and_register(df: DataFrame, label: str, kind: str, out_dir: str | None = None,
                       id_col: str = "transaction_id", seed: int = 42, as_of=None, **params):
    """Split -> train -> evaluate -> (save) -> one model_performance row (G1).

    Returns (model, registry row DataFrame).
    """
    from .registry import performance_row

    import datetime as dt

    spark = df.sparkSession
    if id_col not in df.columns:
        raise ValueError(f"no column {id_col}: the split needs the id of a row")
    df = model_input(df)
    train_df, test_df = stratified_split(df, label, id_col, 0.2, seed)
    when = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) if as_of is None else \
        (as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of)))
    model = train(train_df, label, kind, seed, version=f"{S.MODEL_VERSION_PREFIX}{when:%Y%m%d_%H%M%S}", **params)
    model.training_date = when.isoformat()
    model.metrics = evaluate(model, test_df, label)
    clf = model.pipeline.stages[-1]
    if hasattr(clf, "featureImportances"):
        imp = clf.featureImportances.toArray().tolist()
        model.metrics["feature_importance"] = dict(zip(model.feature_names, [float(x) for x in imp]))
    if out_dir:
        save_model(model, out_dir, spark)
    n = df.count()     # the split partitions df exactly
    return model, performance_row(spark, model, n, when)

"""Sources and sinks: CSV history, feature Parquet, alert log, metrics, audit, model info, reports, M17."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from txrisk import schemas as S
from txrisk.operators import alerts as AL
from txrisk.operators import ml as M
from txrisk.operators import registry as G
from txrisk.operators.features import batch_features, serving_features, user_frequency_table
from txrisk.operators.metrics import metrics_long
from txrisk.sources import sinks
from txrisk.sources.files import read_history_csv, write_features
from txrisk.sources.tables import transactions

NOW = dt.datetime(2024, 1, 30)


def _scratch():
    return tempfile.mkdtemp(prefix="txrisk-io-")


def test_history_csv_to_feature_parquet(spark, sf001):
    root = _scratch()
    t = transactions(spark, sf001).select(
        "transaction_id", "user_id", "amount", "currency", "merchant", "transaction_time", "country",
        "transaction_type", F.col("is_fraud_actual").cast("int").alias("is_fraud"))
    t.write.option("header", True).csv(os.path.join(root, "csv"))
    hist = read_history_csv(spark, os.path.join(root, "csv"))
    assert hist.schema == S.HISTORICAL_TRANSACTION or [f.name for f in hist.schema] == \
        [f.name for f in S.HISTORICAL_TRANSACTION]
    assert hist.count() == t.count()
    feats = batch_features(hist).withColumn("date", F.to_date("transaction_time"))
    write_features(feats, os.path.join(root, "features"), partition_by="date")
    back = spark.read.parquet(os.path.join(root, "features"))
    assert back.count() == t.count() and "amount_percentile" in back.columns


def test_alert_log_metrics_and_audit_sinks(spark):
    root = _scratch()
    recs = spark.createDataFrame([("HIGH_VALUE_FRAUD", "CRITICAL", "m", '{"a": 1}', NOW)], S.ALERT_RECORD)
    sinks.sink_alert_log(recs, os.path.join(root, "log"))
    sinks.sink_alert_log(recs, os.path.join(root, "log"))
    lines = [json.loads(r.value) for r in spark.read.text(os.path.join(root, "log")).collect()]
    assert len(lines) == 2 and lines[0]["alert_type"] == "HIGH_VALUE_FRAUD"
    wide = spark.createDataFrame([(3, 0.5)], "pending_alerts bigint, fraud_rate double")
    sinks.sink_metrics(metrics_long(wide, NOW), os.path.join(root, "metrics"))
    assert spark.read.parquet(os.path.join(root, "metrics")).count() == 2
    sinks.sink_audit(AL.alert_audit_rows(recs), os.path.join(root, "audit"))
    a = spark.read.parquet(os.path.join(root, "audit")).first()
    assert a.event_type == "ALERT_HIGH_VALUE_FRAUD" and a.metadata == '{"a": 1}'
    cache = AL.alert_cache_rows(recs).first()
    assert cache.key == f"alert:HIGH_VALUE_FRAUD:{int(NOW.replace(tzinfo=dt.timezone.utc).timestamp())}"
    assert cache.expires_at == NOW + dt.timedelta(hours=1)


def test_model_info_files_register_and_report(spark):
    root = _scratch()
    for name, acc, when in (("a", 0.99, "2026-02-04T21:14:27.863696"), ("b", 0.97, "2026-02-05T08:00:00")):
        d = os.path.join(root, "models", name, "metadata")
        os.makedirs(d)
        with open(os.path.join(d, "model_info.json"), "w") as f:
            json.dump({"model_type": "random_forest", "feature_names": S.MODEL_FEATURES,
                       "metrics": {"accuracy": acc, "precision": 0.9, "recall": 0.9, "f1_score": 0.9,
                                   "roc_auc": 0.99, "feature_importance": {"amount": 0.5, "hour": 0.2}},
                       "training_date": when, "version": f"fraud_model_{name}"}, f, indent=2)
    infos = G.read_model_info(spark, os.path.join(root, "models", "*", "metadata", "model_info.json"))
    assert infos.count() == 2
    newest = G.newest_model(infos).first()
    assert newest.version == "fraud_model_b" and newest.path.endswith("b/metadata/model_info.json")
    reg = G.register_model(spark.createDataFrame([], S.MODEL_PERFORMANCE), infos, NOW)
    assert [r.model_version for r in G.list_models(reg).collect()] == ["fraud_model_b", "fraud_model_a"]
    top = M.top_features(infos.select("metrics.feature_importance"), 1).collect()
    assert top[0].feature == "amount"
    metrics = spark.createDataFrame([(0.99, 0.9, 0.9, 0.9, 0.99)],
                                    "accuracy double, precision double, recall double, f1_score double, roc_auc double")
    sinks.write_report(metrics, os.path.join(root, "report"), "fraud_model_b", NOW)
    rep = sinks.read_report(spark, os.path.join(root, "report")).first()
    assert rep.model_version == "fraud_model_b" and rep.metrics.accuracy == 0.99


def test_train_and_register(spark, sf01):
    t = transactions(spark, sf01)
    frame = serving_features(t, user_stats=user_frequency_table(t)).withColumn(
        "label", F.col("is_fraud_actual").cast("int"))
    out = os.path.join(_scratch(), "model")
    model, row = M.train_and_register(frame, "label", "logistic", out, as_of="2024-02-01 10:20:30", maxIter=50)
    r = row.first()
    assert r.model_version == "fraud_model_20240201_102030" and r.is_active is False
    assert 0 <= float(r.accuracy) <= 1 and model.metrics["roc_auc"] > 0.5
    assert os.path.isdir(os.path.join(out, "pipeline"))


def test_scale_conf_sizes_partitions():
    from txrisk.session import scale_conf

    c = scale_conf(100 * 2 ** 40)                       # 100 TB
    assert int(c["spark.sql.files.maxPartitionBytes"]) == 256 * 2 ** 20
    assert int(c["spark.sql.shuffle.partitions"]) == 100_000  # capped; AQE coalesces
    assert int(scale_conf(10 * 2 ** 30)["spark.sql.shuffle.partitions"]) == 200   # small input: floor

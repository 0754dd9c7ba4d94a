"""The command line jobs run end to end on tables written by the library's own sinks."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from txrisk import cli
from txrisk import schemas as S
from txrisk.operators.features import serving_features
from txrisk.operators import registry
from txrisk.operators.registry import RegistryConflict, change_registry, read_registry, registry_version, write_registry
from txrisk.sources.tables import transactions
from txrisk.streaming.stream import score_batch


def test_cli_jobs(spark, sf001):
    root = tempfile.mkdtemp(prefix="txrisk-cli-")
    tables = os.path.join(root, "tables")
    tx = transactions(spark, sf001)
    score_batch(serving_features(tx), 0, os.path.join(tables, "transactions"), os.path.join(tables, "fraud_alerts"),
                as_of="2024-01-31 00:00:00")

    # registry: register two model info files, activate one, list
    for name, acc, when in (("a", 0.80, "2024-01-01T00:00:00"), ("b", 0.99, "2024-01-02T00:00:00")):
        d = os.path.join(root, "models", name, "metadata")
        os.makedirs(d)
        with open(os.path.join(d, "model_info.json"), "w") as f:
            json.dump({"model_type": "random_forest", "feature_names": S.MODEL_FEATURES,
                       "metrics": {"accuracy": acc, "precision": 0.7, "recall": 0.9, "f1_score": 0.8,
                                   "roc_auc": 0.9, "feature_importance": {"amount": 1.0}},
                       "training_date": when, "version": f"m_{name}"}, f)
    cli.main(["registry", "register", "--tables", tables,
              "--model-info", os.path.join(root, "models", "*", "metadata", "model_info.json")])
    cli.main(["registry", "activate", "--tables", tables, "--version", "m_a"])
    reg = read_registry(spark, os.path.join(tables, "model_performance"))
    assert reg.count() == 2 and [r.model_version for r in reg.filter("is_active").collect()] == ["m_a"]
    audit = {r.event_type for r in spark.read.parquet(os.path.join(tables, "audit_log")).collect()}
    assert audit == {"MODEL_REGISTERED", "MODEL_ACTIVATED"}

    cli.main(["alerts", "--tables", tables, "--as-of", "2024-01-31 00:00:00"])
    log = [json.loads(r.value) for r in spark.read.text(os.path.join(tables, "alerts_log")).collect()]
    assert {a["alert_type"] for a in log} == {"MODEL_PERFORMANCE_DEGRADATION"}   # m_a: accuracy .80, precision .70

    cli.main(["metrics", "--tables", tables, "--as-of", "2024-01-31 00:00:00", "--window", "1 day"])
    names = {r.metric_name for r in spark.read.parquet(os.path.join(tables, "monitoring_metrics")).collect()}
    assert {"transactions_per_minute", "fraud_rate", "accuracy", "pending_alerts"} <= names

    csv = os.path.join(root, "history")
    tx.select("transaction_id", "user_id", "amount", "currency", "merchant", "transaction_time", "country",
              "transaction_type", F.col("is_fraud_actual").cast("int").alias("is_fraud")) \
        .write.option("header", True).csv(csv)
    cli.main(["batch-features", "--input", csv, "--output", os.path.join(root, "features")])
    assert spark.read.parquet(os.path.join(root, "features")).count() == tx.count()
    # the batch table trains a model as it is, which then evaluates on it
    model_dir = os.path.join(root, "models", "batch")
    cli.main(["train", "--features", os.path.join(root, "features"), "--kind", "logistic", "--out", model_dir, "--tables", tables,
              "--as-of", "2024-02-02T00:00:00"])
    assert {r.model_version for r in read_registry(spark, os.path.join(tables, "model_performance")).collect()} == {
        "m_a", "m_b", "fraud_model_20240202_000000"}
    cli.main(["evaluate", "--model", model_dir, "--features", os.path.join(root, "features"), "--report", os.path.join(model_dir, "report")])
    with pytest.raises(ValueError):
        cli.main(["train", "--features", os.path.join(root, "features"), "--id-col", "nope", "--out", os.path.join(root, "x")])


def _models(spark, *versions):
    return spark.createDataFrame([(v, None, None, None, None, None, 1, None, None, False, None) for v in versions], S.MODEL_PERFORMANCE)


def _new_registry():
    return os.path.join(tempfile.mkdtemp(prefix="txrisk-reg-"), "model_performance")


def test_a_registry_that_cannot_be_read_is_not_overwritten(spark):
    path = _new_registry()
    assert read_registry(spark, path).count() == 0 and registry_version(spark, path) == 0
    assert write_registry(_models(spark, "m1"), path, 0) == 1
    # a write that broke off before its commit is passed over
    _models(spark, "lost").write.parquet(os.path.join(path, "data-lost"))
    assert [r.model_version for r in read_registry(spark, path).collect()] == ["m1"]
    assert write_registry(_models(spark, "m1", "m2"), path, 1) == 2
    with open(os.path.join(path, "_commits", "000000002")) as f:
        data = os.path.join(path, f.read().strip())
    part = next(p for p in os.listdir(data) if p.endswith(".parquet"))
    with open(os.path.join(data, part), "wb") as f:
        f.write(b"broken")
    with pytest.raises(Exception):
        read_registry(spark, path).count()
    with pytest.raises(Exception):
        cli.main(["registry", "activate", "--tables", os.path.dirname(path), "--version", "m1"])
    assert registry_version(spark, path) == 2                       # the attempt is not the registry
    assert [r.model_version for r in read_registry(spark, path, 1).collect()] == ["m1"]


def test_of_two_writers_that_read_the_same_snapshot_one_loses(spark):
    path = _new_registry()
    write_registry(_models(spark, "m0"), path, 0)
    a, b = (read_registry(spark, path), registry_version(spark, path)), (read_registry(spark, path), registry_version(spark, path))
    assert write_registry(a[0].unionByName(_models(spark, "a")), path, a[1]) == 2
    with pytest.raises(RegistryConflict):
        write_registry(b[0].unionByName(_models(spark, "b")), path, b[1])
    assert {r.model_version for r in read_registry(spark, path).collect()} == {"m0", "a"}
    # the commit itself refuses a number that was taken between the look and the commit
    assert not registry.create_file(spark, f"{path}/_commits/000000002", "data-other")
    assert registry.create_file(spark, f"{path}/_commits/000000003", "data-x")
    assert not [n for n in os.listdir(os.path.join(path, "_commits")) if n.endswith(".tmp")]


def test_changes_of_interleaved_writers_all_survive(spark):
    path, tries = _new_registry(), []

    def add_b(models):
        tries.append(models.count())
        if len(tries) == 1:                                         # another writer commits in between
            change_registry(spark, path, lambda m: m.unionByName(_models(spark, "a")))
        return models.unionByName(_models(spark, "b"))

    change_registry(spark, path, add_b)
    assert tries == [0, 1] and {r.model_version for r in read_registry(spark, path).collect()} == {"a", "b"}
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda v: change_registry(spark, path, lambda m: m.unionByName(_models(spark, v))), ["c", "d", "e", "f"]))
    assert sorted(r.model_version for r in read_registry(spark, path).collect()) == ["a", "b", "c", "d", "e", "f"]
    change_registry(spark, path, lambda m: registry.activate_model(m, "d"))
    assert [r.model_version for r in read_registry(spark, path).filter("is_active").collect()] == ["d"]


def test_cli_train_and_evaluate(spark, sf001):
    root = tempfile.mkdtemp(prefix="txrisk-cli-train-")
    tables = os.path.join(root, "tables")
    tx = transactions(spark, sf001)
    feats = serving_features(tx).withColumn("is_fraud", F.col("is_fraud_actual").cast("int"))
    fpath = os.path.join(root, "features")
    feats.drop("is_fraud_actual").write.parquet(fpath)
    model_dir = os.path.join(root, "models", "m1")
    cli.main(["train", "--features", fpath, "--label", "is_fraud", "--kind", "logistic", "--out", model_dir,
              "--tables", tables, "--as-of", "2024-02-01T00:00:00"])
    reg = read_registry(spark, os.path.join(tables, "model_performance")).collect()
    assert [r.model_version for r in reg] == ["fraud_model_20240201_000000"]
    report = os.path.join(model_dir, "report")
    cli.main(["evaluate", "--model", model_dir, "--features", fpath, "--label", "is_fraud", "--report", report])
    rep = spark.read.json(report).first()
    assert rep.model_version == "fraud_model_20240201_000000" and 0.0 <= rep.metrics.accuracy <= 1.0

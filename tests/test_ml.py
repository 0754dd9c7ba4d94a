"""Model metrics against the committed golden numbers, exact AUC, split, encoders, training."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from txrisk.operators import ml as M
from txrisk.operators.features import serving_features, user_frequency_table
from txrisk.sources.tables import transactions

# Confusion counts derived from the committed metrics (n, TP, FP, FN, TN) and the
# committed accuracy / precision / recall / F1 they must reproduce.
GOLDEN = [
    (490, 26, 10, 9474, 0.9964, 0.9496124031007752, 0.98, 0.9645669291338583),
    (487, 34, 13, 9466, 0.9953, 0.9347408829174664, 0.974, 0.9539666993143976),
    (1547, 37, 53, 18363, 0.9955, 0.9766414141414141, 0.966875, 0.9717336683417086),
    (489, 17, 11, 9483, 0.9972, 0.9664031620553359, 0.978, 0.9721669980119284),
]


def _frame(spark, tp, fp, fn, tn):
    data = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn
    return spark.createDataFrame(data, "label int, prediction int")


@pytest.mark.parametrize("tp,fp,fn,tn,acc,prec,rec,f1", GOLDEN)
def test_golden_metrics(spark, tp, fp, fn, tn, acc, prec, rec, f1):
    m = M.binary_metrics(_frame(spark, tp, fp, fn, tn)).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (tp, fp, fn, tn)
    assert m.accuracy == pytest.approx(acc, abs=1e-12)
    assert m.precision == pytest.approx(prec, abs=1e-12)
    assert m.recall == pytest.approx(rec, abs=1e-12)
    assert m.f1_score == pytest.approx(f1, abs=1e-12)


def test_confusion_matrix_and_report(spark):
    df = _frame(spark, 490, 26, 10, 9474)
    cm = {r.actual: (r.predicted_0, r.predicted_1) for r in M.confusion_matrix(df).collect()}
    assert cm == {0: (9474, 26), 1: (10, 490)}
    rep = {r["class"]: r for r in M.class_report(df).collect()}
    assert rep["Fraud"].precision == pytest.approx(0.9496124031007752)
    assert rep["Normal"].support == 9500 and rep["Fraud"].support == 500
    assert rep["accuracy"].f1_score == pytest.approx(0.9964)


def test_empty_denominators_are_zero(spark):
    m = M.binary_metrics(_frame(spark, 0, 0, 5, 5)).first()
    assert m.precision == 0.0 and m.f1_score == 0.0 and m.recall == 0.0


def _brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    tot = 0.0
    for p in pos:
        for q in neg:
            tot += 1.0 if p > q else (0.5 if p == q else 0.0)
    return tot / (len(pos) * len(neg))


def test_auc_exact_with_ties(spark, sf001):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from txrisk.operators.scoring import rule_score

    s = rule_score(transactions(spark, sf001)).select(F.col("is_fraud_actual").cast("int").alias("label"),
                                                       F.col("fraud_score").alias("score"))
    got = M.roc_auc(s, "label", "score").first().roc_auc
    pairs = [(r.label, r.score) for r in s.collect()]
    assert got == pytest.approx(_brute_auc(pairs), abs=1e-12)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC")
    assert got == pytest.approx(ev.evaluate(s.withColumn("label", F.col("label").cast("double"))), abs=1e-6)


def test_roc_points_monotone(spark, sf001):
    from txrisk.operators.scoring import rule_score

    s = rule_score(transactions(spark, sf001)).select(F.col("is_fraud_actual").cast("int").alias("label"),
                                                       F.col("fraud_score").alias("score"))
    pts = sorted(M.roc_points(s, "label", "score").collect(), key=lambda r: -r.threshold)
    assert pts[-1].fpr == 1.0 and pts[-1].tpr == 1.0
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(pts, pts[1:]))


def test_stratified_split_exact_per_class(spark, sf001):
    t = transactions(spark, sf001).withColumn("label", F.col("is_fraud_actual").cast("int"))
    train, test = M.stratified_split(t, "label", "transaction_id", 0.2, 42)
    n = {r.label: r["count"] for r in t.groupBy("label").count().collect()}
    nt = {r.label: r["count"] for r in test.groupBy("label").count().collect()}
    for k, v in n.items():
        assert nt.get(k, 0) == round(0.2 * v)
    assert train.count() + test.count() == t.count()
    assert train.join(test, "transaction_id").count() == 0
    # deterministic
    _, test2 = M.stratified_split(t, "label", "transaction_id", 0.2, 42)
    assert sorted(r.transaction_id for r in test.collect()) == sorted(r.transaction_id for r in test2.collect())


def test_encoder_unseen_is_minus_one(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "merchant string")
    enc = M.fit_encoder(fit, ["merchant"])
    out = {r.merchant: r.merchant_encoded for r in
           M.encode(spark.createDataFrame([("a",), ("c",), ("zz",), (None,)], "merchant string"), enc).collect()}
    assert out == {"a": 0, "c": 2, "zz": -1, None: -1}


def test_balanced_weights(spark):
    df = _frame(spark, 10, 0, 0, 30)
    w = {r.label: r.weight for r in M.balanced_weights(df, "label").select("label", "weight").distinct().collect()}
    assert w[1] == pytest.approx(40 / (2 * 10)) and w[0] == pytest.approx(40 / (2 * 30))


def test_train_predict_save_load(spark, sf01):
    t = transactions(spark, sf01)
    frame = serving_features(t, user_stats=user_frequency_table(t)).withColumn(
        "label", F.col("is_fraud_actual").cast("int"))
    model = M.train(frame, "label", "random_forest", numTrees=10, maxDepth=5, version="rf_test")
    pred = M.predict(frame, model)
    assert {"fraud_score", "is_fraud", "model_version"}.issubset(pred.columns)
    auc = M.roc_auc(pred.withColumn("y", F.col("label")), "y", "fraud_score").first().roc_auc
    assert auc > 0.8     # the label depends on amount and merchant, which the model sees
    path = os.path.join(tempfile.mkdtemp(prefix="txrisk-model-"), "m")
    M.save_model(model, path, spark)
    back = M.load_model(path, spark)
    a = sorted((r.transaction_id, round(r.fraud_score, 9)) for r in pred.select("transaction_id", "fraud_score").collect())
    b = sorted((r.transaction_id, round(r.fraud_score, 9)) for r in
               M.predict(frame, back).select("transaction_id", "fraud_score").collect())
    assert a == b
    top = M.top_features(M.feature_importance(model, spark), 10).collect()
    assert len(top) == 10 and top[0].importance >= top[-1].importance

"""Alert rules with the default thresholds, dashboard edge cases, quality checks, registry."""

import datetime as dt
import json

from pyspark.sql import functions as F

from txrisk.operators import alerts as AL
from txrisk.operators import dashboard as D
from txrisk.operators import quality as Q
from txrisk.operators import registry as G
from txrisk.operators.metrics import collect_metrics, metrics_long

NOW = dt.datetime(2024, 3, 1, 12, 0, 0)
ALERT_SCHEMA = ("transaction_id string, user_id string, amount double, merchant string, fraud_score double, "
                "is_fraud boolean, model_version string, detection_time timestamp, transaction_time timestamp, "
                "alert_status string")
TX_SCHEMA = ("transaction_id string, user_id string, amount double, currency string, merchant string, "
             "transaction_time timestamp, country string, transaction_type string, created_at timestamp")


def _alert(i, user="U1", amount=100.0, minutes_ago=1, status="pending", score=0.8, is_fraud=True):
    t = NOW - dt.timedelta(minutes=minutes_ago)
    return (f"T{i}", user, amount, "Amazon", score, is_fraud, "rule_based", t, t, status)


def _tx(i, minutes_ago=1, country="US"):
    t = NOW - dt.timedelta(minutes=minutes_ago)
    return (f"T{i}", "U1", 10.0, "USD", "Amazon", t, country, "purchase", t)


def test_high_value_threshold_is_strict(spark):
    a = spark.createDataFrame([_alert(1, amount=5000.0), _alert(2, amount=5000.01),
                               _alert(3, amount=9000.0, status="confirmed"),
                               _alert(4, amount=9000.0, minutes_ago=6)], ALERT_SCHEMA)
    out = AL.high_value_alerts(a, NOW).collect()
    assert [json.loads(r.details)["transaction_id"] for r in out] == ["T2"]
    assert out[0].message == "High-value fraud detected: $5000.01 for user U1"
    assert out[0].severity == "CRITICAL"


def test_rapid_sequence_default_threshold(spark):
    a = spark.createDataFrame([_alert(i, user="U9", minutes_ago=i) for i in range(10)]
                              + [_alert(100 + i, user="U8", minutes_ago=i) for i in range(9)]
                              + [_alert(200, user="U8", minutes_ago=31)], ALERT_SCHEMA)
    out = AL.rapid_sequence_alerts(a, NOW).collect()
    assert [json.loads(r.details)["user_id"] for r in out] == ["U9"]
    assert out[0].message == "Rapid fraud sequence from user U9: 10 frauds"
    members = D.rapid_sequence_members(a, NOW).collect()
    assert len(members) == 10


def test_rate_spike(spark):
    tx = spark.createDataFrame([_tx(i) for i in range(20)] + [_tx(99, minutes_ago=11)], TX_SCHEMA)
    a = spark.createDataFrame([_alert(i) for i in range(4)], ALERT_SCHEMA)       # 4 / 20 = .2 > .15
    out = AL.rate_spike_alerts(tx, a, NOW).collect()
    assert len(out) == 1 and out[0].message == "Fraud rate spike detected: 20.00%"
    a3 = spark.createDataFrame([_alert(i) for i in range(3)], ALERT_SCHEMA)     # .15 is not above
    assert AL.rate_spike_alerts(tx, a3, NOW).count() == 0


def test_empty_tables_give_zero_rates(spark):
    tx = spark.createDataFrame([], TX_SCHEMA)
    a = spark.createDataFrame([], ALERT_SCHEMA)
    r = D.fraud_rate(tx, a, NOW).first()
    assert (r.total_tx, r.fraud_tx, r.fraud_rate) == (0, 0, 0.0)
    s = D.dashboard_stats(tx, a, NOW).first()
    assert s.avg_amount == 0.0 and s.avg_fraud_score == 0.0 and s.by_country == []


def test_left_join_condition_stays_in_on(spark):
    tx = spark.createDataFrame([_tx(1), _tx(2)], TX_SCHEMA)
    a = spark.createDataFrame([_alert(1, is_fraud=False)], ALERT_SCHEMA)
    out = D.tx_with_alerts(tx, a, fraud_only=True).collect()
    assert len(out) == 2 and all(r.is_fraud is False and r.alert_status == "n/a" for r in out)


def test_page_after_keeps_time_ties(spark):
    t = NOW
    rows = [("T1", "U", 1.0, "USD", "A", t, "US", "p", t), ("T2", "U", 1.0, "USD", "A", t, "US", "p", t),
            ("T3", "U", 1.0, "USD", "A", t + dt.timedelta(seconds=1), "US", "p", t)]
    tx = spark.createDataFrame(rows, TX_SCHEMA)
    a = spark.createDataFrame([], ALERT_SCHEMA)
    assert [r.transaction_id for r in D.page_after(tx, a, "T1").collect()] == ["T2", "T3"]
    assert [r.transaction_id for r in D.newer_than(tx, "T1").collect()] == ["T3"]


def test_model_degradation_and_registry(spark):
    infos = spark.createDataFrame(
        [("random_forest", ["a"], (0.99, 0.95, 0.98, 0.96, 0.999, {"a": 1.0}), "2026-02-04T21:14:27", "m1"),
         ("gradient_boosting", ["a"], (0.80, 0.70, 0.90, 0.79, 0.9, {"a": 1.0}), "2026-02-05T10:00:00", "m2")],
        "model_type string, feature_names array<string>, metrics struct<accuracy double, precision double, "
        "recall double, f1_score double, roc_auc double, feature_importance map<string,double>>, "
        "training_date string, version string")
    empty = spark.createDataFrame([], G.S.MODEL_PERFORMANCE)
    reg = G.register_model(empty, infos, NOW)
    assert reg.filter("is_active").count() == 0
    newest = G.newest_model(infos).first()
    assert newest.version == "m2"
    act = G.activate_model(reg, newest.version)
    assert [r.model_version for r in G.active_model(act).collect()] == ["m2"]
    alerts = AL.model_degradation_alerts(act, NOW).collect()
    assert len(alerts) == 1 and alerts[0].message == "Model m2 performance below threshold"
    assert AL.model_degradation_alerts(G.activate_model(reg, "m1"), NOW).count() == 0
    audit = G.registration_audit(infos, NOW).collect()
    assert {r.event_type for r in audit} == {"MODEL_REGISTERED"}


def test_metrics_long_units(spark):
    wide = spark.createDataFrame([(3, 0.25, True, "v1")], "n int, r double, ok boolean, name string")
    out = {r.metric_name: (float(r.metric_value), r.metric_unit) for r in metrics_long(wide, NOW).collect()}
    assert out == {"n": (3.0, "count"), "r": (0.25, "ratio"), "ok": (1.0, "boolean")}


def test_collect_metrics_one_row(spark):
    tx = spark.createDataFrame([_tx(i, minutes_ago=i * 10) for i in range(10)], TX_SCHEMA)
    a = spark.createDataFrame([_alert(i, minutes_ago=i * 10) for i in range(3)], ALERT_SCHEMA)
    m = collect_metrics(tx, a, None, NOW).collect()
    # the first row is exactly at as_of: inside the last minute
    assert len(m) == 1 and m[0].transactions_per_minute == 1 and m[0].frauds_detected_1h == 3
    assert m[0].transactions_today == 10 and m[0].pending_alerts == 3


def test_quality_checks(spark):
    df = spark.createDataFrame([("A", "U", 1.0), ("A", "U", 2.0), (None, "U", 3.0), ("B", None, 1e14)],
                               "transaction_id string, user_id string, amount double")
    valid, bad = Q.split_valid(df, ["transaction_id", "user_id"])
    assert valid.count() == 2 and sorted(r.missing for r in bad.collect()) == [["transaction_id"], ["user_id"]]
    assert [(r.transaction_id, r.copies) for r in Q.duplicates(df, "transaction_id").collect()] == [("A", 2)]
    dd = Q.dedupe(df.filter("transaction_id = 'A'"), "transaction_id", order_by="amount").collect()
    assert [(r.transaction_id, r.amount) for r in dd] == [("A", 1.0)]
    bad_rows = Q.out_of_range(df.filter(F.col("transaction_id").isNotNull()),
                              lengths={"user_id": 0}, decimals={"amount": (15, 2)}).collect()
    assert ("B", "amount") in {(r.transaction_id, r.column) for r in bad_rows}
    filled = Q.with_defaults(spark.createDataFrame([(None,)], "alert_status string"), {"alert_status": "pending"})
    assert filled.first().alert_status == "pending"

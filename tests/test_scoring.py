"""Scalar features and the rule score: boundary cases and a row-by-row cross-check."""

import datetime as dt

from pyspark.sql import functions as F

from txrisk import schemas as S
from txrisk.operators.features import serving_features
from txrisk.operators.scoring import flagged, rule_score, score
from txrisk.sources.tables import transactions


def _tx(spark, rows):
    schema = "transaction_id string, user_id string, amount double, merchant string, country string, transaction_time string"
    return spark.createDataFrame(rows, schema)


def test_night_hours_and_weekend(spark):
    rows = [(f"T{h}", "U", 5.0, "Amazon", "US", f"2024-01-06T{h:02d}:30:00") for h in (6, 7, 21, 22)]
    rows.append(("TSUN", "U", 5.0, "Amazon", "US", "2024-01-07T12:00:00"))   # Sunday
    rows.append(("TMON", "U", 5.0, "Amazon", "US", "2024-01-08T12:00:00"))   # Monday
    f = {r.transaction_id: r for r in serving_features(_tx(spark, rows)).collect()}
    assert f["T6"].is_night == 1 and f["T7"].is_night == 0
    assert f["T21"].is_night == 0 and f["T22"].is_night == 1
    assert f["T6"].day_of_week == 7 and f["T6"].is_weekend == 1          # Saturday
    assert f["TSUN"].day_of_week == 1 and f["TSUN"].is_weekend == 1
    assert f["TMON"].day_of_week == 2 and f["TMON"].is_weekend == 0


def test_amount_edges_and_nulls(spark):
    rows = [("A", "U", 1000.0, None, None, "2024-01-08T12:00:00"),
            ("B", "U", 1000.01, "Suspicious Shop", "RU", "2024-01-08T12:00:00"),
            ("C", "U", 10.0, "Amazon", "CN", "not a time")]
    f = {r.transaction_id: r for r in serving_features(_tx(spark, rows)).collect()}
    assert f["A"].is_high_amount == 0 and f["B"].is_high_amount == 1
    assert f["A"].is_unknown_merchant == 0 and f["A"].is_foreign_country == 0     # NULL -> 0
    assert f["B"].is_unknown_merchant == 1 and f["B"].is_foreign_country == 1
    assert f["C"].transaction_timestamp is None                                   # malformed -> NULL, no error
    assert f["C"].user_frequency == S.DEFAULT_USER_FREQUENCY


def test_score_exactly_point_seven_is_not_fraud(spark):
    # high amount (.3) + night (.2) + foreign (.2) = .7 exactly -> not fraud
    rows = [("P7", "U", 2000.0, "Amazon", "RU", "2024-01-08T23:00:00"),
            ("P8", "U", 2000.0, "Foreign Vendor", "RU", "2024-01-08T12:00:00"),   # .3 + .3 + .2 = .8
            ("P10", "U", 2000.0, "Foreign Vendor", "CN", "2024-01-08T02:00:00")]  # 1.0 (clamp)
    s = {r.transaction_id: r for r in rule_score(_tx(spark, rows)).collect()}
    assert abs(s["P7"].fraud_score - 0.7) < 1e-12 and s["P7"].is_fraud is False
    assert s["P8"].is_fraud is True
    assert s["P10"].fraud_score == 1.0 and s["P10"].model_version == "rule_based"


def _python_rule(amount, hour, merchant, country):
    score = 0.0
    if amount > 1000:
        score += 0.3
    if hour >= 22 or hour <= 6:
        score += 0.2
    if merchant in S.RISKY_MERCHANTS:
        score += 0.3
    if country in S.FOREIGN_COUNTRIES:
        score += 0.2
    return min(score, 1.0)


def test_rule_score_matches_row_by_row(spark, sf001):
    s = rule_score(transactions(spark, sf001)).select(
        "amount", "transaction_time", "merchant", "country", "fraud_score", "is_fraud").collect()
    assert len(s) > 0
    for r in s:
        expect = _python_rule(r.amount, r.transaction_time.hour, r.merchant, r.country)
        assert r.fraud_score == expect
        assert r.is_fraud == (expect > 0.7)


def test_flagged_and_stamp(spark, sf001):
    out = score(transactions(spark, sf001), as_of=dt.datetime(2024, 2, 1))
    assert flagged(out).filter(~F.col("is_fraud")).count() == 0
    assert out.select(F.max("detection_time")).first()[0] == dt.datetime(2024, 2, 1)


def test_transactions_fixture_counts(spark, sf01):
    t = transactions(spark, sf01)
    agg = t.agg(F.count("*").alias("n"), F.countDistinct("transaction_id").alias("ids"),
                F.sum(F.col("amount").cast("decimal(15,2)")).alias("total"),
                F.countDistinct("merchant").alias("m"), F.countDistinct("country").alias("c"),
                F.countDistinct("user_id").alias("u"), F.count_if("is_fraud_actual").alias("fraud")).first()
    assert (agg.n, agg.ids, str(agg.total), agg.m, agg.c, agg.u, agg.fraud) == \
        (10000, 10000, "4963065.70", 17, 6, 150, 311)
    s = rule_score(t).agg(F.count_if(F.col("fraud_score") > 0.7).alias("gt"),
                          F.count_if(F.col("fraud_score") == 0.7).alias("eq"),
                          F.count_if(F.col("fraud_score") >= 0.5).alias("ge5"),
                          F.round(F.sum("fraud_score"), 6).alias("sum")).first()
    assert (s.gt, s.eq, s.ge5, s.sum) == (104, 279, 1567, 2256.6)

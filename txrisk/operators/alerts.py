"""Alert rules (R1-R7): each rule is a query producing alert records.

An alert record is (alert_type, severity, message, details JSON, timestamp),
one common schema for all rules, so all rules run as one union (R6) and land
in one log (S8) and one audit table (S13).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import as_of_col, interval, ts_string
from . import dashboard as D
from .registry import active_model


@dataclass(frozen=True)
class AlertThresholds:
    """Rule thresholds (high_fraud_score is declared; its rule is optional)."""
    high_fraud_score: float = S.ALERT_HIGH_FRAUD_SCORE
    high_amount: float = S.ALERT_HIGH_AMOUNT
    rapid_frauds: int = S.ALERT_RAPID_FRAUDS
    fraud_rate_spike: float = S.ALERT_FRAUD_RATE_SPIKE
    min_accuracy: float = S.ALERT_MIN_ACCURACY
    min_precision: float = S.ALERT_MIN_PRECISION
    min_recall: float = S.ALERT_MIN_RECALL
    high_value_window: str = "5 minutes"
    rate_window: str = "10 minutes"
    rapid_window: str = "30 minutes"


def make_alert(df: DataFrame, alert_type: str, severity: str, message: Column, details: Column,
               as_of=None) -> DataFrame:
    """The common alert record (F21: details encoded with ``to_json``)."""
    return df.select(F.lit(alert_type).alias("alert_type"), F.lit(severity).alias("severity"),
                     message.alias("message"), F.to_json(details).alias("details"),
                     as_of_col(as_of).alias("timestamp"))


def high_value_alerts(alerts: DataFrame, as_of=None, threshold: float = S.ALERT_HIGH_AMOUNT,
                      lookback: str = "5 minutes") -> DataFrame:
    """R1 + P8 + O6 (CRITICAL): recent pending fraud alerts above the amount threshold, largest first
    (P8: conjunction recent AND amount > threshold AND is_fraud AND pending; O6: amount descending)."""
    a = D.within(alerts, "detection_time", as_of, lookback).filter(
        (F.col("amount") > F.lit(threshold)) & F.col("is_fraud") & (F.col("alert_status") == F.lit(S.PENDING_STATUS)))
    a = a.orderBy(F.col("amount").desc(), F.col("transaction_id"))
    amount = F.col("amount").cast("double")
    kind, severity, fmt = S.ALERT_HIGH_VALUE
    return make_alert(
        a, kind, severity,
        F.format_string(fmt, amount, F.col("user_id")),
        F.struct(F.col("transaction_id"), F.col("user_id"), amount.alias("amount"),
                 F.col("fraud_score").cast("double").alias("fraud_score"), F.col("merchant")),
        as_of)


def rate_spike_alerts(tx: DataFrame, alerts: DataFrame, as_of=None, threshold: float = S.ALERT_FRAUD_RATE_SPIKE,
                      lookback: str = "10 minutes", time_col: str = "created_at") -> DataFrame:
    """R2 (HIGH): fraud rate over the window above the threshold (at most one alert)."""
    r = D.fraud_rate(tx, alerts, as_of, lookback, time_col=time_col, fraud_only=True)
    r = r.filter(F.col("fraud_rate") > F.lit(threshold))
    kind, severity, fmt = S.ALERT_RATE_SPIKE
    return make_alert(
        r, kind, severity,
        F.format_string(fmt, F.col("fraud_rate") * F.lit(100.0)),
        F.struct(F.col("total_tx").alias("total_transactions"), F.col("fraud_tx").alias("fraud_transactions"),
                 F.col("fraud_rate")),
        as_of)


def rapid_sequence_alerts(alerts: DataFrame, as_of=None, threshold: int = S.ALERT_RAPID_FRAUDS,
                          lookback: str = "30 minutes") -> DataFrame:
    """R3 (HIGH): users with at least ``threshold`` fraud alerts in the window.

    ``details`` also holds the bounds of the window; with them and the user, :func:`rapid_sequence_ids` gives
    the transaction ids of a sequence in long form (kept out of the record so a huge
    sequence never becomes one value)."""
    u = D.rapid_sequences(alerts, as_of, lookback, threshold)
    t = as_of_col(as_of)
    kind, severity, fmt = S.ALERT_RAPID_SEQUENCE
    return make_alert(
        u, kind, severity,
        F.format_string(fmt, F.col("user_id"), F.col("fraud_count")),
        F.struct(F.col("user_id"), F.col("fraud_count"), ts_string(t - interval(lookback)).alias("window_start"),
                 ts_string(t).alias("window_end")),
        as_of)


def rapid_sequence_ids(records: DataFrame, alerts: DataFrame) -> DataFrame:
    """The transactions of R3 records, in long form: (user_id, timestamp, transaction_id), one row for each
    fraud alert of the user that was detected within the bounds that ``details`` states."""
    d = F.from_json("details", "user_id string, window_start string, window_end string")
    r = records.filter(F.col("alert_type") == F.lit(S.ALERT_RAPID_SEQUENCE[0])).select(
        d["user_id"].alias("user_id"), "timestamp", F.to_timestamp(d["window_start"]).alias("_from"), F.to_timestamp(d["window_end"]).alias("_to"))
    a = alerts.filter(F.col("is_fraud")).select("user_id", "transaction_id", "detection_time")
    return r.join(a, "user_id").filter(F.col("detection_time").between(F.col("_from"), F.col("_to"))).select("user_id", "timestamp", "transaction_id")


def model_degradation_alerts(models: DataFrame, as_of=None, min_accuracy: float = S.ALERT_MIN_ACCURACY,
                             min_precision: float = S.ALERT_MIN_PRECISION,
                             min_recall: float = S.ALERT_MIN_RECALL) -> DataFrame:
    """R4 + P9 (MEDIUM): the active model below any of the three thresholds
    (P9: accuracy < .85 OR precision < .75 OR recall < .75)."""
    m = active_model(models)
    m = m.filter((F.col("accuracy") < F.lit(min_accuracy)) | (F.col("precision_score") < F.lit(min_precision))
                 | (F.col("recall") < F.lit(min_recall)))
    kind, severity, fmt = S.ALERT_MODEL_DEGRADATION
    return make_alert(
        m, kind, severity,
        F.format_string(fmt, F.col("model_version")),
        F.struct(F.col("model_version"), F.col("accuracy").cast("double").alias("accuracy"),
                 F.col("precision_score").cast("double").alias("precision"),
                 F.col("recall").cast("double").alias("recall"),
                 F.col("f1_score").cast("double").alias("f1_score")),
        as_of)


def high_score_alerts(alerts: DataFrame, as_of=None, threshold: float = S.ALERT_HIGH_FRAUD_SCORE,
                      lookback: str = "5 minutes") -> DataFrame:
    """Optional rule on the declared 0.95 score threshold (not in the default set)."""
    a = D.within(alerts, "detection_time", as_of, lookback).filter(
        F.col("is_fraud") & (F.col("fraud_score") >= F.lit(threshold)))
    return make_alert(
        a, "HIGH_FRAUD_SCORE", "HIGH",
        F.format_string("High fraud score %.4f for transaction %s", F.col("fraud_score").cast("double"),
                        F.col("transaction_id")),
        F.struct("transaction_id", "user_id", F.col("fraud_score").cast("double").alias("fraud_score")),
        as_of)


def run_alert_rules(tx: DataFrame, alerts: DataFrame, models: DataFrame | None, as_of=None,
                    thresholds: AlertThresholds = AlertThresholds()) -> DataFrame:
    """All default rules in one DataFrame (union of R1-R4)."""
    parts = [
        high_value_alerts(alerts, as_of, thresholds.high_amount, thresholds.high_value_window),
        rate_spike_alerts(tx, alerts, as_of, thresholds.fraud_rate_spike, thresholds.rate_window),
        rapid_sequence_alerts(alerts, as_of, thresholds.rapid_frauds, thresholds.rapid_window),
    ]
    if models is not None:
        parts.append(model_degradation_alerts(models, as_of, thresholds.min_accuracy,
                                              thresholds.min_precision, thresholds.min_recall))
    return D.union_samples(*parts)


def alert_audit_rows(alert_records: DataFrame) -> DataFrame:
    """S13 rows for R6: event_type ALERT_<type>, the message, details as metadata."""
    return alert_records.select(
        F.concat(F.lit(S.AUDIT_ALERT_PREFIX), F.col("alert_type")).alias("event_type"),
        F.col("message").alias("event_description"),
        F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("transaction_id"),
        F.lit(None).cast("string").alias("model_version"),
        F.col("details").alias("metadata"), F.col("timestamp").alias("created_at"))


def alert_cache_rows(alert_records: DataFrame, ttl: str = S.RULE_ALERT_TTL) -> DataFrame:
    """Key / value / expiry form of alert records (``alert:<type>:<epoch seconds>``)."""
    return alert_records.select(
        F.concat_ws(":", F.lit(S.RULE_ALERT_KEY_PREFIX), F.col("alert_type"), F.unix_timestamp("timestamp").cast("string")).alias("key"),
        F.to_json(F.struct("alert_type", "severity", "message", "details", "timestamp")).alias("value"),
        (F.col("timestamp") + F.expr(f"INTERVAL {ttl.split()[0]} {ttl.split()[1].rstrip('s').upper()}"))
        .alias("expires_at"))

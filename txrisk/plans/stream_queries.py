"""Queries of the message and streaming operators, evaluated on batch frames.

The windowed functions are the ones the streaming jobs run; on a batch frame
the watermark is a no-op, so these queries check their results against SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import ts_string
from ..operators.features import serving_features
from ..operators.scoring import rule_score
from ..sources.kafka import parse_messages, to_messages
from ..sources.sinks import alert_payload
from ..session import checkpoint_dir
from ..streaming.counts import add_batch, compact, user_frequency
from ..streaming.keyed import stream_alert_expiry, stream_bursts, stream_user_windows
from ..streaming.replay import replayed
from ..streaming.stream import stream_fraud_rate, stream_rapid_fraud, stream_tx_with_alerts, stream_volume
from ..operators.quality import dedupe
from . import oracle as O
from .base import alerts, big, query, r6, scored, tx
from .feature_queries import HOURS_SQL, user_windows_sql


@query("kafka_message_scoring", O.BASE + """
SELECT transaction_id, CAST(hour AS BIGINT) AS hour, CAST(day_of_week AS BIGINT) AS day_of_week,
       round(fraud_score, 6) AS fraud_score, is_fraud, is_fraud_actual FROM scored""")
def q_kafka_message_scoring(spark, d):
    """S1/S2 message path + P1 + F1 + F22 + F24 + R0: transactions encoded as JSON messages, decoded, featurised, scored."""
    msgs = to_messages(tx(spark, d))
    parsed = parse_messages(msgs)
    s = rule_score(serving_features(parsed))
    return s.select("transaction_id", big("hour").alias("hour"), big("day_of_week").alias("day_of_week"),
                    r6("fraud_score").alias("fraud_score"), "is_fraud", "is_fraud_actual")


@query("alert_payload", O.BASE + f"""
SELECT 'fraud_alert:' || transaction_id AS key, transaction_id AS v_transaction_id, user_id AS v_user_id,
       amount AS v_amount, round(fraud_score, 6) AS v_fraud_score, {O.ts('detection_time')} AS v_timestamp,
       {O.ts("detection_time + INTERVAL 1 HOUR")} AS expires_at
FROM alerts""")
def q_alert_payload(spark, d):
    """S7 + F21 + F22 + F23: cache payload of each alert (key, JSON value, expiry one hour after detection)."""
    p = alert_payload(alerts(spark, d))
    v = lambda k: F.get_json_object("value", f"$.{k}")
    return p.select("key", v("transaction_id").alias("v_transaction_id"), v("user_id").alias("v_user_id"),
                    v("amount").cast("double").alias("v_amount"),
                    F.round(v("fraud_score").cast("double"), 6).alias("v_fraud_score"),
                    v("timestamp").alias("v_timestamp"), ts_string("expires_at").alias("expires_at"))


@query("stream_volume_hourly", O.BASE + f"""
SELECT {O.ts("date_trunc('hour', transaction_time)")} AS window_start,
       {O.ts("date_trunc('hour', transaction_time) + INTERVAL 1 HOUR")} AS window_end,
       CAST(count(DISTINCT transaction_id) AS BIGINT) AS tx_count,
       CAST(count(DISTINCT transaction_id) FILTER (WHERE is_fraud) AS BIGINT) AS fraud_count
FROM scored GROUP BY 1, 2""")
def q_stream_volume_hourly(spark, d):
    """T8 on a batch frame: hourly tumbling windows of transactions and frauds."""
    v = stream_volume(scored(spark, d), "1 hour")
    return v.select(ts_string("window_start").alias("window_start"), ts_string("window_end").alias("window_end"),
                    big("tx_count").alias("tx_count"), big("fraud_count").alias("fraud_count"))


@query("stream_rapid_fraud_windows", O.BASE_DENSE + f"""
, wins AS (
  SELECT user_id, time_bucket(INTERVAL 6 HOUR, detection_time) - k * INTERVAL 6 HOUR AS ws
  FROM dense, range(0, 4) r(k) WHERE is_fraud)
SELECT {O.ts('ws')} AS window_start, {O.ts('ws + INTERVAL 1 DAY')} AS window_end, user_id,
       CAST(count(*) AS BIGINT) AS fraud_count
FROM wins GROUP BY ws, user_id HAVING count(*) >= 3""")
def q_stream_rapid_fraud_windows(spark, d):
    """T9 on a batch frame: users with >= 3 dense alerts in 1-day windows sliding by 6 hours."""
    r = stream_rapid_fraud(alerts(spark, d, 0.5), "1 day", "6 hours", 3)
    return r.select(ts_string("window_start").alias("window_start"), ts_string("window_end").alias("window_end"),
                    "user_id", big("fraud_count").alias("fraud_count"))


@query("stream_fraud_rate_daily", O.BASE + f"""
SELECT {O.ts("date_trunc('day', transaction_time)")} AS window_start,
       {O.ts("date_trunc('day', transaction_time) + INTERVAL 1 DAY")} AS window_end,
       CAST(count(*) AS BIGINT) AS total_tx, CAST(count(*) FILTER (WHERE is_fraud) AS BIGINT) AS fraud_tx,
       round(CAST(count(*) FILTER (WHERE is_fraud) AS DOUBLE) / count(*), 6) AS fraud_rate,
       CAST(count(*) FILTER (WHERE is_fraud) AS DOUBLE) / count(*) > 0.015 AS spike
FROM scored GROUP BY 1, 2""")
def q_stream_fraud_rate_daily(spark, d):
    """T10 on a batch frame: daily fraud rate and spike flag (threshold 0.015)."""
    r = stream_fraud_rate(scored(spark, d), "1 day", 0.015, slide=None)
    return r.select(ts_string("window_start").alias("window_start"), ts_string("window_end").alias("window_end"),
                    big("total_tx").alias("total_tx"), big("fraud_tx").alias("fraud_tx"),
                    r6("fraud_rate").alias("fraud_rate"), "spike")


@query("replay_dedupe", O.BASE + f"""
SELECT DISTINCT transaction_id, user_id, amount, {O.ts('transaction_time')} AS transaction_time FROM tx""")
def q_replay_dedupe(spark, d):
    """A replayed feed (every message twice) de-duplicated by transaction id."""
    t = tx(spark, d).select("transaction_id", "user_id", "amount", "transaction_time")
    replay = t.unionByName(t)
    dd = dedupe(replay, "transaction_id", watermark="10 minutes", time_col="transaction_time")
    return dd.select("transaction_id", "user_id", "amount", ts_string("transaction_time").alias("transaction_time"))


#: A replay is fed in three slices of time; the query is stopped and started again after each.
CUTS = ["2024-01-10 00:00:00", "2024-01-20 12:00:00"]


@query("replayed_user_windows", O.BASE + user_windows_sql() + f"""
SELECT transaction_id, CAST(user_tx_count_7d AS BIGINT) AS user_tx_count_7d, round(user_avg_amount_7d, 6) AS user_avg_amount_7d,
       {O.ts('prev_t')} AS prev_transaction_time, {HOURS_SQL} AS hours_since_last_tx,
       CAST(tx_count_1h AS BIGINT) AS tx_count_1h, round(total_amount_1h, 6) AS total_amount_1h, tx_count_1h > 5 AS is_high_velocity
FROM uf""")
def q_replayed_user_windows(spark, d):
    """W3-W6, W9, W10, F15 at serving time: all transactions through the keyed stream, with restarts."""
    t = tx(spark, d).select("transaction_id", "user_id", "transaction_time", "amount")
    f = replayed(t, stream_user_windows, "transaction_time", CUTS)
    return f.select("transaction_id", big("user_tx_count_7d").alias("user_tx_count_7d"), r6("user_avg_amount_7d").alias("user_avg_amount_7d"),
                    ts_string("prev_transaction_time").alias("prev_transaction_time"), r6("hours_since_last_tx").alias("hours_since_last_tx"),
                    big("tx_count_1h").alias("tx_count_1h"), r6("total_amount_1h").alias("total_amount_1h"),
                    (F.col("is_high_velocity") == 1).alias("is_high_velocity"))


@query("replayed_bursts", O.BASE_DENSE + f"""
, moments AS (SELECT DISTINCT user_id, detection_time AS t FROM dense WHERE is_fraud)
, spans AS (SELECT m.user_id, t, count(*) AS n FROM moments m JOIN dense a ON a.user_id = m.user_id AND a.is_fraud AND a.detection_time BETWEEN t - INTERVAL 1 DAY AND t
            GROUP BY m.user_id, t)
, told AS (SELECT *, lag(t) OVER w AS pt, lag(n) OVER w AS pn FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, {O.ts("t - INTERVAL 1 DAY")} AS window_start, {O.ts('t')} AS window_end, CAST(n AS BIGINT) AS fraud_count,
       NOT coalesce(pn >= 3 AND pt >= t - INTERVAL 1 DAY, FALSE) AS starts
FROM told WHERE n >= 3""")
def q_replayed_bursts(spark, d):
    """T9 / R3 at every event: each detection time at which a user has 3 or more dense alerts within the day before, by keyed state."""
    a = alerts(spark, d, 0.5).select("user_id", "detection_time", "is_fraud")
    b = replayed(a, lambda s: stream_bursts(s, span="1 day", threshold=3), "detection_time", CUTS)
    return b.select("user_id", ts_string("window_start").alias("window_start"), ts_string("window_end").alias("window_end"),
                    big("fraud_count").alias("fraud_count"), "starts")


@query("replayed_alert_expiry", O.BASE_DENSE + f"""
SELECT transaction_id, 'set' AS event, {O.ts('detection_time')} AS at, {O.ts("detection_time + INTERVAL 1 HOUR")} AS expires_at FROM dense
UNION ALL
SELECT transaction_id, 'expired' AS event, {O.ts("max(detection_time) + INTERVAL 1 HOUR")}, {O.ts("max(detection_time) + INTERVAL 1 HOUR")} FROM dense GROUP BY 1""")
def q_replayed_alert_expiry(spark, d):
    """T6 on a stream: dense alerts as they are set and as they expire."""
    a = alerts(spark, d, 0.5).select("transaction_id", "detection_time")
    e = replayed(a, stream_alert_expiry, "detection_time", CUTS)
    return e.select("transaction_id", "event", ts_string("at").alias("at"), ts_string("expires_at").alias("expires_at"))


@query("replayed_tx_with_alerts", O.BASE_DENSE + f"""
SELECT t.transaction_id, {O.ts('t.transaction_time')} AS transaction_time, coalesce(round(a.fraud_score, 6), 0.0::DOUBLE) AS fraud_score,
       coalesce(a.is_fraud, FALSE) AS is_fraud, coalesce(a.alert_status, 'n/a') AS alert_status
FROM tx t LEFT JOIN dense a ON t.transaction_id = a.transaction_id""")
def q_replayed_tx_with_alerts(spark, d):
    """J1 / T7 on streams: two streams joined with a watermark each; every transaction comes out, once without an alert."""
    t = tx(spark, d).select("transaction_id", "transaction_time")
    a = alerts(spark, d, 0.5).select("transaction_id", "fraud_score", "is_fraud", "alert_status", "detection_time")
    j = replayed([t, a], stream_tx_with_alerts, ["transaction_time", "detection_time"], CUTS)
    return j.select("transaction_id", ts_string("transaction_time").alias("transaction_time"), r6("fraud_score").alias("fraud_score"), "is_fraud", "alert_status")


@query("user_frequency_kept", O.BASE + """
SELECT user_id, CAST(count(*) AS BIGINT) AS user_frequency FROM tx GROUP BY user_id""")
def q_user_frequency_kept(spark, d):
    """J10 kept up to date: all transactions counted in six batches of days, one of them written twice, folded into a base on the way."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/user-counts-{uuid.uuid4().hex}"
    t = tx(spark, d).select("user_id", F.floor((F.dayofmonth("transaction_time") - 1) / 6).alias("batch"))
    for n in range(6):
        rows = t.filter(F.col("batch") == n)
        if n == 3:
            compact(spark, path, ("replay", n))
            add_batch(t.filter(F.col("batch") == 0), path, ("replay", n))      # an attempt that was lost
        add_batch(rows, path, ("replay", n))
    return user_frequency(spark, path).select("user_id", big("user_frequency").alias("user_frequency"))

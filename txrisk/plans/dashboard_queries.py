"""Dashboard, alert-table and set-operation queries (S10, F24, R0, J*, A1-A18, O*, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ts_string
from ..operators import dashboard as D
from ..operators.features import serving_features
from ..sources import tables
from . import oracle as O
from .base import (AS_OF, BY_COUNTRY_SQL, MONTH_END, alerts, big, by_country_str, query, r6, scored, tx)
from pyspark.sql import DataFrame

# ---------------------------------------------------------------- S10 / F24 / R0 / P4 / A10 (flagship)
@query("transactions", O.BASE + f"""
SELECT transaction_id, user_id, amount, currency, merchant, {O.ts('transaction_time')} AS transaction_time,
       country, transaction_type, is_fraud_actual, {O.ts('created_at')} AS created_at FROM tx""")
def q_transactions(spark, d):
    """S10 + F1/F23 (timestamps): the typed transactions table."""
    t = tx(spark, d)
    return t.select("transaction_id", "user_id", "amount", "currency", "merchant",
                    ts_string("transaction_time").alias("transaction_time"), "country", "transaction_type",
                    "is_fraud_actual", ts_string("created_at").alias("created_at"))


@query("serving_features", O.BASE + """
SELECT transaction_id, CAST(hour AS BIGINT) AS hour, CAST(day_of_week AS BIGINT) AS day_of_week,
       round(amount_log, 6) AS amount_log, CAST(is_night AS BIGINT) AS is_night,
       CAST(is_weekend AS BIGINT) AS is_weekend, CAST(user_frequency AS BIGINT) AS user_frequency,
       CAST(is_high_amount AS BIGINT) AS is_high_amount, CAST(is_unknown_merchant AS BIGINT) AS is_unknown_merchant,
       CAST(is_foreign_country AS BIGINT) AS is_foreign_country
FROM feat""")
def q_serving_features(spark, d):
    """F1-F3, F5, F6, F8, F9, F11, F12, J10 (default), F24."""
    f = serving_features(tx(spark, d))
    return f.select("transaction_id", big("hour").alias("hour"), big("day_of_week").alias("day_of_week"),
                    r6("amount_log").alias("amount_log"), big("is_night").alias("is_night"),
                    big("is_weekend").alias("is_weekend"), big("user_frequency").alias("user_frequency"),
                    big("is_high_amount").alias("is_high_amount"),
                    big("is_unknown_merchant").alias("is_unknown_merchant"),
                    big("is_foreign_country").alias("is_foreign_country"))


@query("rule_scores", O.BASE + """
SELECT transaction_id, round(fraud_score, 6) AS fraud_score, is_fraud, model_version FROM scored""")
def q_rule_scores(spark, d):
    """R0 + F19 + M10: rule score, strict > 0.7 flag, model_version."""
    s = scored(spark, d)
    return s.select("transaction_id", r6("fraud_score").alias("fraud_score"), "is_fraud", "model_version")


ALERT_COLS_SQL = f"""transaction_id, user_id, amount, merchant, round(fraud_score, 6) AS fraud_score, is_fraud,
       model_version, {O.ts('detection_time')} AS detection_time, {O.ts('transaction_time')} AS transaction_time,
       alert_status"""


def alert_cols(a: DataFrame) -> DataFrame:
    return a.select("transaction_id", "user_id", "amount", "merchant", r6("fraud_score").alias("fraud_score"),
                    "is_fraud", "model_version", ts_string("detection_time").alias("detection_time"),
                    ts_string("transaction_time").alias("transaction_time"), "alert_status")


@query("fraud_alerts", O.BASE + f"SELECT {ALERT_COLS_SQL} FROM alerts")
def q_fraud_alerts(spark, d):
    """P4 + S6: flagged rows as the alerts table."""
    return alert_cols(alerts(spark, d))


FRAUD_SUMMARY_SQL = """
SELECT CAST(CAST(detection_time AS DATE) AS VARCHAR) AS date, CAST(count(*) AS BIGINT) AS total_alerts,
       CAST(sum(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS confirmed_frauds,
       round(CAST(sum(CAST(fraud_score AS DECIMAL(5,4))) AS DOUBLE) / count(fraud_score), 6) AS avg_fraud_score,
       CAST(sum(CAST(amount AS DECIMAL(15,2))) AS DOUBLE) AS total_amount_flagged,
       CAST(count(DISTINCT user_id) AS BIGINT) AS unique_users_flagged
FROM {src} GROUP BY 1"""


def fraud_summary_out(a: DataFrame) -> DataFrame:
    s = D.fraud_summary(a)
    return s.select(F.col("date").cast("string").alias("date"), big("total_alerts").alias("total_alerts"),
                    big("confirmed_frauds").alias("confirmed_frauds"),
                    r6("avg_fraud_score").alias("avg_fraud_score"),
                    F.col("total_amount_flagged").cast("double").alias("total_amount_flagged"),
                    big("unique_users_flagged").alias("unique_users_flagged"))


@query("fraud_summary", O.BASE + FRAUD_SUMMARY_SQL.format(src="alerts"))
def q_fraud_summary(spark, d):
    """A10 + O7 + F16 + P4 + R0 + F24 over the alerts table: the flagship slice events -> features -> score -> alerts -> daily summary."""
    return fraud_summary_out(alerts(spark, d))


@query("fraud_summary_dense", O.BASE_DENSE + FRAUD_SUMMARY_SQL.format(src="dense"))
def q_fraud_summary_dense(spark, d):
    """A10 over the dense alert table (score >= 0.5)."""
    return fraud_summary_out(alerts(spark, d, 0.5))


@query("daily_transaction_stats", O.BASE + """
SELECT CAST(CAST(transaction_time AS DATE) AS VARCHAR) AS date, CAST(count(*) AS BIGINT) AS total_transactions,
       round(CAST(sum(CAST(amount AS DECIMAL(15,2))) AS DOUBLE) / count(amount), 6) AS avg_amount, max(amount) AS max_amount, min(amount) AS min_amount,
       CAST(count(DISTINCT user_id) AS BIGINT) AS unique_users,
       CAST(count(DISTINCT merchant) AS BIGINT) AS unique_merchants
FROM tx GROUP BY 1""")
def q_daily_transaction_stats(spark, d):
    """A11 + O7 + F16."""
    s = D.daily_transaction_stats(tx(spark, d))
    return s.select(F.col("date").cast("string").alias("date"), big("total_transactions").alias("total_transactions"),
                    r6("avg_amount").alias("avg_amount"), "max_amount", "min_amount",
                    big("unique_users").alias("unique_users"), big("unique_merchants").alias("unique_merchants"))


# ---------------------------------------------------------------- dashboard bundles
TX_STATS_SQL = f"""
SELECT CAST(count(*) FILTER (WHERE transaction_time >= TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE
                              AND transaction_time <= TIMESTAMP '{AS_OF}') AS BIGINT) AS transactions_per_minute,
       CAST(count(*) FILTER (WHERE transaction_time >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
                              AND transaction_time <= TIMESTAMP '{AS_OF}') AS BIGINT) AS transactions_today,
       round(coalesce(CAST(sum(CAST(amount AS DECIMAL(15,2))) FILTER (WHERE transaction_time >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
                              AND transaction_time <= TIMESTAMP '{AS_OF}') AS DOUBLE)
                      / count(amount) FILTER (WHERE transaction_time >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
                              AND transaction_time <= TIMESTAMP '{AS_OF}'), 0), 2) AS avg_amount
FROM tx"""


@query("transaction_stats", O.BASE + TX_STATS_SQL)
def q_transaction_stats(spark, d):
    """A1, A2, A17 + P5 + F18: per-minute and 24 h counts, 24 h average amount."""
    s = D.tx_counts(tx(spark, d), AS_OF)
    return s.select(big("transactions_per_minute").alias("transactions_per_minute"),
                    big("transactions_today").alias("transactions_today"), "avg_amount")


def _alert_window(src: str, lb: str) -> str:
    return (f"detection_time >= TIMESTAMP '{AS_OF}' - INTERVAL {lb} AND detection_time <= TIMESTAMP '{AS_OF}'")


def fraud_stats_sql(src: str, lb: str = "24 HOUR") -> str:
    return f"""
, counts AS (
  SELECT CAST(count(*) FILTER (WHERE {_alert_window(src, lb)} AND is_fraud) AS BIGINT) AS frauds_detected,
         CAST(count(*) FILTER (WHERE alert_status = 'pending') AS BIGINT) AS pending_alerts,
         round(round(coalesce(CAST(sum(CAST(fraud_score AS DECIMAL(5,4))) FILTER (WHERE {_alert_window(src, lb)}) AS DOUBLE)
                         / count(fraud_score) FILTER (WHERE {_alert_window(src, lb)}), 0), 4), 6) AS avg_fraud_score
  FROM {src})
, rate AS (
  SELECT round(CASE WHEN count(DISTINCT t.transaction_id) > 0
                    THEN CAST(count(DISTINCT f.transaction_id) AS DOUBLE) / count(DISTINCT t.transaction_id)
                    ELSE 0 END, 4) AS fraud_rate
  FROM tx t LEFT JOIN {src} f ON t.transaction_id = f.transaction_id AND f.is_fraud = TRUE
  WHERE t.transaction_time >= TIMESTAMP '{AS_OF}' - INTERVAL {lb} AND t.transaction_time <= TIMESTAMP '{AS_OF}')
, bc AS (
  SELECT t.country, count(*) AS fraud_count FROM {src} f JOIN tx t ON t.transaction_id = f.transaction_id
  WHERE f.is_fraud = TRUE AND {_alert_window(src, lb).replace('detection_time', 'f.detection_time')}
  GROUP BY t.country ORDER BY fraud_count DESC, t.country LIMIT 10)
, countries AS (SELECT coalesce({BY_COUNTRY_SQL}, '') AS by_country FROM bc)
"""


@query("fraud_stats", O.BASE_DENSE + fraud_stats_sql("dense", "7 DAY") + """
SELECT frauds_detected, pending_alerts, avg_fraud_score, fraud_rate, by_country FROM counts, rate, countries""")
def q_fraud_stats(spark, d):
    """A3, A5, A6, A7 (J2), A8 (J4, O4), A18 over a 7-day window of the dense alerts."""
    s = D.fraud_stats(tx(spark, d), alerts(spark, d, 0.5), AS_OF, "7 days")
    return s.select(big("frauds_detected").alias("frauds_detected"), big("pending_alerts").alias("pending_alerts"),
                    r6("avg_fraud_score").alias("avg_fraud_score"), r6("fraud_rate").alias("fraud_rate"),
                    F.coalesce(by_country_str(), F.lit("")).alias("by_country"))


@query("dashboard_stats", O.BASE + fraud_stats_sql("alerts", "24 HOUR") + f"""
, txs AS ({TX_STATS_SQL})
SELECT transactions_per_minute, transactions_today, avg_amount, frauds_detected, pending_alerts, fraud_rate,
       avg_fraud_score, by_country FROM txs, counts, rate, countries""")
def q_dashboard_stats(spark, d):
    """The eight live statistics in one row."""
    s = D.dashboard_stats(tx(spark, d), alerts(spark, d), AS_OF)
    return s.select(big("transactions_per_minute").alias("transactions_per_minute"),
                    big("transactions_today").alias("transactions_today"), "avg_amount",
                    big("frauds_detected").alias("frauds_detected"), big("pending_alerts").alias("pending_alerts"),
                    r6("fraud_rate").alias("fraud_rate"), r6("avg_fraud_score").alias("avg_fraud_score"),
                    F.coalesce(by_country_str(), F.lit("")).alias("by_country"))


@query("fraud_rate_any_alert", O.BASE_DENSE + f"""
SELECT CAST(count(DISTINCT t.transaction_id) AS BIGINT) AS total_tx,
       CAST(count(DISTINCT f.transaction_id) AS BIGINT) AS fraud_tx,
       round(CASE WHEN count(DISTINCT t.transaction_id) > 0
                  THEN CAST(count(DISTINCT f.transaction_id) AS DOUBLE) / count(DISTINCT t.transaction_id)
                  ELSE 0 END, 6) AS fraud_rate
FROM tx t LEFT JOIN dense f ON t.transaction_id = f.transaction_id
WHERE t.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY AND t.created_at <= TIMESTAMP '{AS_OF}'""")
def q_fraud_rate_any_alert(spark, d):
    """A7 monitoring form (J3: any alert counts; window on created_at)."""
    r = D.fraud_rate(tx(spark, d), alerts(spark, d, 0.5), AS_OF, "3 days", time_col="created_at", fraud_only=False)
    return r.select(big("total_tx").alias("total_tx"), big("fraud_tx").alias("fraud_tx"),
                    r6("fraud_rate").alias("fraud_rate"))


@query("fraud_by_country", O.BASE_DENSE + f"""
SELECT t.country, CAST(count(*) AS BIGINT) AS fraud_count FROM dense f JOIN tx t ON t.transaction_id = f.transaction_id
WHERE f.is_fraud AND f.detection_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 31 DAY
  AND f.detection_time <= TIMESTAMP '{MONTH_END}'
GROUP BY t.country ORDER BY fraud_count DESC, t.country LIMIT 10""")
def q_fraud_by_country(spark, d):
    """A8 / J4 / O4 over the whole month of dense alerts."""
    r = D.fraud_by_country(alerts(spark, d, 0.5), tx(spark, d), MONTH_END, "31 days")
    return r.select("country", big("fraud_count").alias("fraud_count"))


@query("volume_history", O.BASE + f"""
SELECT {O.ts("date_trunc('minute', t.transaction_time)")} AS minute,
       CAST(count(DISTINCT t.transaction_id) AS BIGINT) AS tx_count,
       CAST(count(DISTINCT fa.transaction_id) AS BIGINT) AS fraud_count
FROM tx t LEFT JOIN alerts fa ON t.transaction_id = fa.transaction_id AND fa.is_fraud = TRUE
WHERE t.transaction_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 44640 MINUTE
  AND t.transaction_time <= TIMESTAMP '{MONTH_END}'
GROUP BY 1""")
def q_volume_history(spark, d):
    """A9 + F16 + O7 + J2 over the whole month (44640 minutes)."""
    v = D.volume_history(tx(spark, d), alerts(spark, d), MONTH_END, minutes=44640)
    return v.select(ts_string("minute").alias("minute"), big("tx_count").alias("tx_count"),
                    big("fraud_count").alias("fraud_count"))


RECORD_SQL = f"""t.transaction_id, t.user_id, t.amount, t.currency, t.merchant, {O.ts('t.transaction_time')} AS transaction_time,
       t.country, t.transaction_type, round(COALESCE(fa.fraud_score, 0), 6) AS fraud_score,
       COALESCE(fa.is_fraud, FALSE) AS is_fraud, COALESCE(fa.alert_status, 'n/a') AS alert_status"""


def record_cols(df: DataFrame) -> DataFrame:
    return df.select("transaction_id", "user_id", "amount", "currency", "merchant",
                     ts_string("transaction_time").alias("transaction_time"), "country", "transaction_type",
                     r6("fraud_score").alias("fraud_score"), "is_fraud", "alert_status")


@query("tx_with_alerts", O.BASE_DENSE + f"""
SELECT {RECORD_SQL} FROM tx t LEFT JOIN dense fa ON t.transaction_id = fa.transaction_id""")
def q_tx_with_alerts(spark, d):
    """J1 + P10 + P13: every transaction with its (dense) alert, defaults when none."""
    return record_cols(D.tx_with_alerts(tx(spark, d), alerts(spark, d, 0.5)))


@query("recent_transactions", O.BASE_DENSE + f"""
SELECT {RECORD_SQL} FROM tx t LEFT JOIN dense fa ON t.transaction_id = fa.transaction_id
ORDER BY t.transaction_time DESC, t.transaction_id DESC LIMIT 20""")
def q_recent_transactions(spark, d):
    """O1 (top-k is the feature): newest 20 rows of J1."""
    return record_cols(D.recent_transactions(tx(spark, d), alerts(spark, d, 0.5), 20))


@query("page_after_anchor", O.BASE_DENSE + f"""
SELECT {RECORD_SQL} FROM tx t LEFT JOIN dense fa ON t.transaction_id = fa.transaction_id
WHERE t.transaction_time > (SELECT max(transaction_time) FROM tx WHERE transaction_id = 'TXN_500')
   OR (t.transaction_time = (SELECT max(transaction_time) FROM tx WHERE transaction_id = 'TXN_500')
       AND t.transaction_id > 'TXN_500')
ORDER BY t.transaction_time, t.transaction_id LIMIT 20""")
def q_page_after_anchor(spark, d):
    """Keyset page of 20 rows after the anchor transaction TXN_500."""
    return record_cols(D.page_after(tx(spark, d), alerts(spark, d, 0.5), "TXN_500", 20))


@query("alerts_feed_pending", O.BASE_DENSE + f"""
SELECT {ALERT_COLS_SQL} FROM dense WHERE is_fraud AND alert_status = 'pending'
ORDER BY detection_time DESC, transaction_id DESC LIMIT 20""")
def q_alerts_feed_pending(spark, d):
    """O5/P7 + T7 feed: newest 20 pending fraud alerts."""
    return alert_cols(D.alerts_feed(alerts(spark, d, 0.5), "pending", 20))


@query("rapid_sequences", O.BASE_DENSE + f"""
, users AS (SELECT user_id, count(*) AS fraud_count FROM dense
            WHERE is_fraud AND detection_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 31 DAY
              AND detection_time <= TIMESTAMP '{MONTH_END}'
            GROUP BY user_id HAVING count(*) >= 12)
SELECT d.user_id, d.transaction_id, CAST(u.fraud_count AS BIGINT) AS fraud_count
FROM dense d JOIN users u ON d.user_id = u.user_id
WHERE d.is_fraud AND d.detection_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 31 DAY
  AND d.detection_time <= TIMESTAMP '{MONTH_END}'""")
def q_rapid_sequences(spark, d):
    """A12/R3 data: users with >= 12 dense alerts in the month, one row per (user, transaction)."""
    m = D.rapid_sequence_members(alerts(spark, d, 0.5), MONTH_END, "31 days", 12)
    return m.select("user_id", "transaction_id", big("fraud_count").alias("fraud_count"))


@query("unseen_alerts", O.BASE_DENSE + f"""
SELECT {ALERT_COLS_SQL} FROM dense d WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.transaction_id = d.transaction_id)""")
def q_unseen_alerts(spark, d):
    """Dense alerts not among the strict alerts already seen."""
    return alert_cols(D.unseen_alerts(alerts(spark, d, 0.5), alerts(spark, d)))


@query("retain_seen", O.BASE_DENSE + f"""
SELECT {ALERT_COLS_SQL} FROM alerts a
WHERE EXISTS (SELECT 1 FROM dense d WHERE d.transaction_id = a.transaction_id AND d.alert_status <> 'dismissed')""")
def q_retain_seen(spark, d):
    """Seen (strict) alerts that are still current (dense, not dismissed)."""
    current = alerts(spark, d, 0.5).filter(F.col("alert_status") != "dismissed")
    return alert_cols(D.retain_seen(alerts(spark, d), current))


@query("orphan_alerts", O.BASE + f"""
SELECT {ALERT_COLS_SQL} FROM alerts a
WHERE NOT EXISTS (SELECT 1 FROM tx t WHERE t.transaction_id = a.transaction_id AND t.transaction_type <> 'refund')""")
def q_orphan_alerts(spark, d):
    """Alerts whose transaction is missing from a ledger without refunds."""
    ledger = tx(spark, d).filter(F.col("transaction_type") != "refund")
    return alert_cols(D.orphans(alerts(spark, d), ledger))


@query("cascade_delete", O.BASE + f"""
SELECT {ALERT_COLS_SQL} FROM alerts a
WHERE EXISTS (SELECT 1 FROM tx t WHERE t.transaction_id = a.transaction_id AND t.transaction_type <> 'refund')""")
def q_cascade_delete(spark, d):
    """Alerts kept after refunds are deleted from the ledger."""
    ledger = tx(spark, d).filter(F.col("transaction_type") != "refund")
    return alert_cols(D.cascade_delete(alerts(spark, d), ledger))


@query("insert_if_absent", O.BASE_DENSE + f"""
SELECT {ALERT_COLS_SQL} FROM dense d WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.transaction_id = d.transaction_id)""")
def q_insert_if_absent(spark, d):
    """U4: dense alert rows that an insert-if-absent would add to the strict alerts table."""
    return alert_cols(D.insert_if_absent(alerts(spark, d), alerts(spark, d, 0.5), "transaction_id"))


@query("union_alerts", O.BASE_DENSE + f"""
SELECT {ALERT_COLS_SQL} FROM alerts UNION ALL SELECT {ALERT_COLS_SQL} FROM dense""")
def q_union_alerts(spark, d):
    """UNION ALL of two alert tables."""
    return alert_cols(D.union_samples(alerts(spark, d), alerts(spark, d, 0.5)))


@query("label_distribution", O.BASE + """
SELECT is_fraud_actual, CAST(count(*) AS BIGINT) AS count FROM tx GROUP BY 1""")
def q_label_distribution(spark, d):
    """A13 on the hidden label."""
    r = D.label_distribution(tx(spark, d), "is_fraud_actual")
    return r.select("is_fraud_actual", big("count").alias("count"))


@query("table_counts", O.BASE + """
SELECT 'transactions' AS "table", CAST(count(*) AS BIGINT) AS row_count FROM tx
UNION ALL SELECT 'fraud_alerts', CAST(count(*) AS BIGINT) FROM alerts
UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT) FROM lineitem
UNION ALL SELECT 'orders', CAST(count(*) AS BIGINT) FROM orders""")
def q_table_counts(spark, d):
    """Row counts of the stored tables."""
    r = D.table_counts({"transactions": tx(spark, d), "fraud_alerts": alerts(spark, d),
                        "lineitem": tables.read_table(spark, d, "lineitem"),
                        "orders": tables.read_table(spark, d, "orders")})
    return r.select("table", big("row_count").alias("row_count"))


@query("live_alerts", O.BASE_DENSE + f"""
SELECT {ALERT_COLS_SQL} FROM dense
WHERE detection_time >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND detection_time <= TIMESTAMP '{AS_OF}'""")
def q_live_alerts(spark, d):
    """T6 + P5: alerts younger than a 1-day TTL at as_of."""
    return alert_cols(D.live_alerts(alerts(spark, d, 0.5), AS_OF, "1 day"))


@query("latest_alert_per_user", O.BASE_DENSE + f"""
SELECT {ALERT_COLS_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY detection_time DESC, transaction_id DESC) AS rn FROM dense)
WHERE rn = 1""")
def q_latest_alert_per_user(spark, d):
    """Each user's newest (dense) alert."""
    from ..operators.registry import latest_per_key

    return alert_cols(latest_per_key(alerts(spark, d, 0.5), ["user_id"], "detection_time", ["transaction_id"]))


@query("newest_transaction", O.BASE + f"""
SELECT transaction_id, {O.ts('transaction_time')} AS transaction_time FROM tx
ORDER BY transaction_time DESC, transaction_id DESC LIMIT 1""")
def q_newest_transaction(spark, d):
    """O2: the anchor of the live feed (newest transaction)."""
    n = D.newest(tx(spark, d))
    return n.select("transaction_id", ts_string("transaction_time").alias("transaction_time"))


@query("transaction_records", O.BASE + f"""
SELECT t.transaction_id, t.user_id, CAST(CAST(t.amount AS DECIMAL(15,2)) AS DOUBLE) AS amount, t.currency,
       t.merchant, {O.ts('t.transaction_time')} AS transaction_time, t.country, t.transaction_type,
       CAST(CAST(coalesce(fa.fraud_score, 0) AS DECIMAL(5,4)) AS DOUBLE) AS fraud_score,
       coalesce(fa.is_fraud, FALSE) AS is_fraud, coalesce(fa.alert_status, 'n/a') AS alert_status
FROM tx t LEFT JOIN alerts fa ON t.transaction_id = fa.transaction_id""")
def q_transaction_records(spark, d):
    """J1 over the stored types (decimal amount and score) + P13 record projection."""
    stored_tx = tx(spark, d).withColumn("amount", F.col("amount").cast("decimal(15,2)"))
    stored = tables.stored_alerts(alerts(spark, d))
    j = D.tx_with_alerts(stored_tx, stored.withColumn("fraud_score", F.col("fraud_score")))
    j = j.withColumn("fraud_score", F.col("fraud_score").cast("decimal(5,4)"))
    return D.to_record(j)


@query("sample_rows", O.BASE + """
SELECT transaction_id, amount, is_fraud_actual FROM tx ORDER BY transaction_id LIMIT 10""")
def q_sample_rows(spark, d):
    """O12 + P2: a 10-row sample of chosen columns (missing columns skipped), in id order."""
    from ..operators.quality import sample_rows

    return sample_rows(tx(spark, d).orderBy("transaction_id"), ["transaction_id", "amount", "is_fraud_actual",
                                                                 "fraud_score_rule"], 10)

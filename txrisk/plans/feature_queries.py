"""Window and batch feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ts_string
from ..operators import features as FE
from ..operators.ranking import distributed_percent_rank
from ..operators.stats import feature_summary, quantile_flag
from ..sources import tables
from . import oracle as O
from .base import big, query, r6, scored, tx

USER_WINDOWS_SQL = """
, uf AS (
  SELECT *,
         count(*) OVER (PARTITION BY user_id) AS user_tx_count,
         CAST(sum(CAST(amount AS DECIMAL(15,2))) OVER (PARTITION BY user_id) AS DOUBLE) / count(amount) OVER (PARTITION BY user_id) AS user_avg_amount,
         count(*) OVER wl AS user_tx_count_{ls},
         CAST(sum(CAST(amount AS DECIMAL(15,2))) OVER wl AS DOUBLE) / count(amount) OVER wl AS user_avg_amount_{ls},
         lag(transaction_time) OVER (PARTITION BY user_id ORDER BY transaction_time, transaction_id) AS prev_t,
         count(*) OVER wv AS tx_count_{vs},
         CAST(sum(CAST(amount AS DECIMAL(15,2))) OVER wv AS DOUBLE) AS total_amount_{vs}
  FROM {src}
  WINDOW wl AS (PARTITION BY user_id ORDER BY transaction_time RANGE BETWEEN INTERVAL {lb} PRECEDING AND CURRENT ROW),
         wv AS (PARTITION BY user_id ORDER BY transaction_time RANGE BETWEEN INTERVAL {vel} PRECEDING AND CURRENT ROW)
)"""

HOURS_SQL = ("round(coalesce((floor(epoch_us(transaction_time) / 1000000.0) - floor(epoch_us(prev_t) / 1000000.0))"
             " / 3600.0, 24.0), 6)")


def user_windows_sql(src="tx", lb="7 DAY", ls="7d", vel="1 HOUR", vs="1h") -> str:
    return USER_WINDOWS_SQL.format(src=src, lb=lb, ls=ls, vel=vel, vs=vs)


@query("user_features", O.BASE + user_windows_sql() + f"""
SELECT transaction_id, CAST(user_tx_count AS BIGINT) AS user_tx_count, round(user_avg_amount, 6) AS user_avg_amount,
       CAST(user_tx_count_7d AS BIGINT) AS user_tx_count_7d, round(user_avg_amount_7d, 6) AS user_avg_amount_7d,
       round((amount - user_avg_amount) / (user_avg_amount + 1), 6) AS amount_deviation_from_avg,
       {O.ts('prev_t')} AS prev_transaction_time, {HOURS_SQL} AS hours_since_last_tx
FROM uf""")
def q_user_features(spark, d):
    """W1-W6 + F14: per-user totals, 7-day RANGE look-back, previous transaction."""
    f = FE.user_window_features(tx(spark, d))
    return f.select("transaction_id", big("user_tx_count").alias("user_tx_count"),
                    r6("user_avg_amount").alias("user_avg_amount"),
                    big("user_tx_count_7d").alias("user_tx_count_7d"),
                    r6("user_avg_amount_7d").alias("user_avg_amount_7d"),
                    r6("amount_deviation_from_avg").alias("amount_deviation_from_avg"),
                    ts_string("prev_transaction_time").alias("prev_transaction_time"),
                    r6("hours_since_last_tx").alias("hours_since_last_tx"))


@query("user_features_hot_split", O.BASE + user_windows_sql() + f"""
SELECT transaction_id, CAST(user_tx_count AS BIGINT) AS user_tx_count, round(user_avg_amount, 6) AS user_avg_amount,
       CAST(user_tx_count_7d AS BIGINT) AS user_tx_count_7d, round(user_avg_amount_7d, 6) AS user_avg_amount_7d,
       {O.ts('prev_t')} AS prev_transaction_time, {HOURS_SQL} AS hours_since_last_tx,
       CAST(tx_count_1h AS BIGINT) AS tx_count_1h, round(total_amount_1h, 6) AS total_amount_1h
FROM uf""")
def q_user_features_hot_split(spark, d):
    """W1-W6, W9, W10 over two ranges of time, so that users are split over few tasks."""
    f = FE.user_window_features(tx(spark, d), n_buckets=2)
    return f.select("transaction_id", big("user_tx_count").alias("user_tx_count"),
                    r6("user_avg_amount").alias("user_avg_amount"),
                    big("user_tx_count_7d").alias("user_tx_count_7d"),
                    r6("user_avg_amount_7d").alias("user_avg_amount_7d"),
                    ts_string("prev_transaction_time").alias("prev_transaction_time"),
                    r6("hours_since_last_tx").alias("hours_since_last_tx"),
                    big("tx_count_1h").alias("tx_count_1h"), r6("total_amount_1h").alias("total_amount_1h"))


@query("user_features_small_buckets", O.BASE + user_windows_sql() + f"""
SELECT transaction_id, CAST(user_tx_count AS BIGINT) AS user_tx_count,
       CAST(user_tx_count_7d AS BIGINT) AS user_tx_count_7d, round(user_avg_amount_7d, 6) AS user_avg_amount_7d,
       {O.ts('prev_t')} AS prev_transaction_time, CAST(tx_count_1h AS BIGINT) AS tx_count_1h
FROM uf""")
def q_user_features_small_buckets(spark, d):
    """Same features with 64 ranges of time (7-day frames span several ranges)."""
    f = FE.user_window_features(tx(spark, d), n_buckets=64)
    return f.select("transaction_id", big("user_tx_count").alias("user_tx_count"),
                    big("user_tx_count_7d").alias("user_tx_count_7d"),
                    r6("user_avg_amount_7d").alias("user_avg_amount_7d"),
                    ts_string("prev_transaction_time").alias("prev_transaction_time"),
                    big("tx_count_1h").alias("tx_count_1h"))


# few keys with thousands of rows each, raw amounts (more than two decimals), any event table
@query("event_type_windows", """
WITH uf AS (
  SELECT event_id, ts, count(*) OVER (PARTITION BY event_type) AS n, avg(value) OVER (PARTITION BY event_type) AS a,
         count(*) OVER wl AS n7, avg(value) OVER wl AS a7, count(*) OVER wv AS n1, sum(value) OVER wv AS s1,
         lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev_t
  FROM (SELECT event_id, event_type, ts, value * 1.25::DOUBLE AS value FROM events)
  WINDOW wl AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW),
         wv AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW))
SELECT event_id, CAST(n AS BIGINT) AS user_tx_count, round(a, 9) AS user_avg_amount, CAST(n7 AS BIGINT) AS user_tx_count_7d,
       round(a7, 9) AS user_avg_amount_7d, CAST(n1 AS BIGINT) AS tx_count_1h, round(s1, 9) AS total_amount_1h, """
       + O.ts("prev_t") + """ AS prev_transaction_time FROM uf""")
def q_event_type_windows(spark, d):
    """W1-W5, W9, W10 with the event type as the key: a fifth of all rows each, amounts with more than two decimals."""
    e = tables.read_table(spark, d, "events").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 1.25).alias("value"))
    f = FE.user_window_features(e, key="event_type", ts="ts", amount="value", id_col="event_id")
    return f.select("event_id", big("user_tx_count").alias("user_tx_count"), F.round("user_avg_amount", 9).alias("user_avg_amount"),
                    big("user_tx_count_7d").alias("user_tx_count_7d"), F.round("user_avg_amount_7d", 9).alias("user_avg_amount_7d"),
                    big("tx_count_1h").alias("tx_count_1h"), F.round("total_amount_1h", 9).alias("total_amount_1h"),
                    ts_string("prev_transaction_time").alias("prev_transaction_time"))


@query("customer_windows", """
WITH t AS (
  SELECT 'TXN_' || l_orderkey || '_' || l_linenumber AS transaction_id, o_custkey AS customer, CAST(l_shipdate AS TIMESTAMP) AS tm,
         l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
uf AS (
  SELECT *, count(*) OVER (PARTITION BY customer) AS n, count(*) OVER w AS n30, CAST(sum(CAST(amount AS DECIMAL(15,2))) OVER w AS DOUBLE) / count(amount) OVER w AS a30,
         lag(tm) OVER (PARTITION BY customer ORDER BY tm, transaction_id) AS prev_t
  FROM t WINDOW w AS (PARTITION BY customer ORDER BY tm RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))
SELECT transaction_id, customer, CAST(n AS BIGINT) AS user_tx_count, CAST(n30 AS BIGINT) AS user_tx_count_30d,
       round(a30, 6) AS user_avg_amount_30d, """ + O.ts("prev_t") + """ AS prev_transaction_time FROM uf""")
def q_customer_windows(spark, d):
    """W1, W3-W5 by customer over the line items, whose ids repeat."""
    li = tables.read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    od = tables.read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"))
    t = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("_", F.lit("TXN"), "l_orderkey", "l_linenumber").alias("transaction_id"), "customer",
        F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_extendedprice").alias("amount"))
    f = FE.user_window_features(t, key="customer", ts="at", lookback="30 days", lookback_suffix="30d", velocity="1 day", velocity_suffix="1d")
    return f.select("transaction_id", "customer", big("user_tx_count").alias("user_tx_count"), big("user_tx_count_30d").alias("user_tx_count_30d"),
                    r6("user_avg_amount_30d").alias("user_avg_amount_30d"), ts_string("prev_transaction_time").alias("prev_transaction_time"))


@query("velocity_1h", O.BASE + user_windows_sql() + """
SELECT transaction_id, CAST(tx_count_1h AS BIGINT) AS tx_count_1h, round(total_amount_1h, 6) AS total_amount_1h,
       CAST(CASE WHEN tx_count_1h > 5 THEN 1 ELSE 0 END AS BIGINT) AS is_high_velocity
FROM uf""")
def q_velocity_1h(spark, d):
    """W9, W10, F15 with the defaults (1 hour, more than 5)."""
    f = FE.velocity(tx(spark, d))
    return f.select("transaction_id", big("tx_count_1h").alias("tx_count_1h"),
                    r6("total_amount_1h").alias("total_amount_1h"), big("is_high_velocity").alias("is_high_velocity"))


@query("velocity_1d", O.BASE + user_windows_sql(vel="1 DAY", vs="1d") + """
SELECT transaction_id, CAST(tx_count_1d AS BIGINT) AS tx_count_1d, round(total_amount_1d, 6) AS total_amount_1d,
       CAST(CASE WHEN tx_count_1d > 3 THEN 1 ELSE 0 END AS BIGINT) AS is_high_velocity
FROM uf""")
def q_velocity_1d(spark, d):
    """W9, W10, F15 with a 1-day window and a limit of 3 (the defaults select nothing here)."""
    f = FE.velocity(tx(spark, d), interval="1 day", max_count=3, suffix="1d")
    return f.select("transaction_id", big("tx_count_1d").alias("tx_count_1d"),
                    r6("total_amount_1d").alias("total_amount_1d"), big("is_high_velocity").alias("is_high_velocity"))


@query("merchant_stats", O.BASE + """
SELECT transaction_id, CAST(count(*) OVER (PARTITION BY merchant) AS BIGINT) AS merchant_tx_count,
       round(CAST(sum(CAST(amount AS DECIMAL(15,2))) OVER (PARTITION BY merchant) AS DOUBLE) / count(amount) OVER (PARTITION BY merchant), 6) AS merchant_avg_amount
FROM tx""")
def q_merchant_stats(spark, d):
    """Merchant count and average joined back to each row."""
    f = FE.merchant_stats(tx(spark, d))
    return f.select("transaction_id", big("merchant_tx_count").alias("merchant_tx_count"),
                    r6("merchant_avg_amount").alias("merchant_avg_amount"))


@query("amount_percentile", O.BASE + """
SELECT transaction_id, amount, round(percent_rank() OVER (ORDER BY amount), 6) AS amount_percentile FROM tx""")
def q_amount_percentile(spark, d):
    """Global percent_rank by amount, computed without a single-partition window."""
    f = distributed_percent_rank(tx(spark, d), "amount", "amount_percentile")
    return f.select("transaction_id", "amount", r6("amount_percentile").alias("amount_percentile"))


@query("user_frequency_join", O.BASE + """
, hist AS (SELECT user_id, count(*) AS n FROM tx WHERE transaction_time < TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id)
SELECT t.transaction_id, CAST(coalesce(h.n, 15) AS BIGINT) AS user_frequency
FROM tx t LEFT JOIN hist h ON t.user_id = h.user_id""")
def q_user_frequency_join(spark, d):
    """user_frequency from a history table (first half of the month), 15 for unknown users."""
    t = tx(spark, d)
    hist = FE.user_frequency_table(t.filter(F.col("transaction_time") < F.lit("2024-01-15 00:00:00").cast("timestamp")))
    f = FE.serving_features(t, user_stats=hist)
    return f.select("transaction_id", big("user_frequency").alias("user_frequency"))


BATCH_COLS = [
    ("hour", "big"), ("day_of_week", "big"), ("day_of_month", "big"), ("month", "big"), ("is_night", "big"),
    ("is_weekend", "big"), ("is_business_hours", "big"), ("amount_log", "r6"), ("is_high_amount", "big"),
    ("is_micro_transaction", "big"), ("amount_percentile", "r6"), ("user_tx_count", "big"),
    ("user_tx_count_7d", "big"), ("user_avg_amount", "r6"), ("user_avg_amount_7d", "r6"),
    ("amount_deviation_from_avg", "r6"), ("hours_since_last_tx", "r6"), ("is_unknown_merchant", "big"),
    ("merchant_tx_count", "big"), ("merchant_avg_amount", "r6"), ("is_foreign_country", "big"),
    ("is_high_risk_country", "big"), ("is_domestic", "big"), ("tx_count_1h", "big"), ("total_amount_1h", "r6"),
    ("is_high_velocity", "big"), ("fraud_score_rule", "r6"),
]

BATCH_SQL = O.BASE + user_windows_sql() + f"""
, bf AS (
  SELECT transaction_id, is_fraud_actual, hour(transaction_time) AS hour, dayofweek(transaction_time) + 1 AS day_of_week,
         dayofmonth(transaction_time) AS day_of_month, month(transaction_time) AS month,
         CASE WHEN hour(transaction_time) >= 22 OR hour(transaction_time) <= 6 THEN 1 ELSE 0 END AS is_night,
         CASE WHEN dayofweek(transaction_time) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN hour(transaction_time) BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS is_business_hours,
         ln(1 + amount) AS amount_log, CASE WHEN amount > 1000 THEN 1 ELSE 0 END AS is_high_amount,
         CASE WHEN amount < 10 THEN 1 ELSE 0 END AS is_micro_transaction,
         percent_rank() OVER (ORDER BY amount) AS amount_percentile,
         user_tx_count, user_tx_count_7d, user_avg_amount, user_avg_amount_7d,
         (amount - user_avg_amount) / (user_avg_amount + 1) AS amount_deviation_from_avg,
         {HOURS_SQL} AS hours_since_last_tx,
         CASE WHEN merchant IN ('Unknown Merchant', 'Suspicious Shop', 'Foreign Vendor') THEN 1 ELSE 0 END AS is_unknown_merchant,
         count(*) OVER (PARTITION BY merchant) AS merchant_tx_count,
         CAST(sum(CAST(amount AS DECIMAL(15,2))) OVER (PARTITION BY merchant) AS DOUBLE) / count(amount) OVER (PARTITION BY merchant) AS merchant_avg_amount,
         CASE WHEN country IN ('RU', 'CN') THEN 1 ELSE 0 END AS is_foreign_country,
         CASE WHEN country IN ('RU', 'CN', 'NG', 'PK') THEN 1 ELSE 0 END AS is_high_risk_country,
         CASE WHEN country = 'US' THEN 1 ELSE 0 END AS is_domestic,
         tx_count_1h, total_amount_1h, CASE WHEN tx_count_1h > 5 THEN 1 ELSE 0 END AS is_high_velocity,
         least(0.0::DOUBLE + CASE WHEN amount > 1000 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
               + CASE WHEN hour(transaction_time) >= 22 OR hour(transaction_time) <= 6 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
               + CASE WHEN merchant IN ('Unknown Merchant', 'Suspicious Shop', 'Foreign Vendor') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
               + CASE WHEN country IN ('RU', 'CN') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) AS fraud_score_rule
  FROM uf)
SELECT transaction_id, CAST(is_fraud_actual AS INTEGER) AS is_fraud, """ + ", ".join(
    (f"CAST({c} AS BIGINT) AS {c}" if kind == "big" else f"round({c}, 6) AS {c}") for c, kind in BATCH_COLS) + " FROM bf"


@query("batch_features", BATCH_SQL)
def q_batch_features(spark, d):
    """F25 (F2-F15, W1-W10, J11) + K3 rule-score column: the full batch feature bundle."""
    t = tx(spark, d).withColumn("is_fraud", F.col("is_fraud_actual").cast("int"))
    f = FE.batch_features(t)
    cols = [big(c).alias(c) if kind == "big" else r6(c).alias(c) for c, kind in BATCH_COLS]
    return f.select("transaction_id", "is_fraud", *cols)


SUMMARY_COLS = ["amount", "hour", "day_of_week", "amount_log", "fraud_score"]


def _summary_sql() -> str:
    parts = []
    for c in SUMMARY_COLS:
        parts.append(
            f"SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS stddev, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
            f"round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM scored")
    return O.BASE + "\nUNION ALL\n".join(parts)


@query("feature_summary", _summary_sql())
def q_feature_summary(spark, d):
    """A14 (exact form) + P12: count, mean, stddev, min, quartiles, max per numeric feature."""
    s = feature_summary(scored(spark, d), SUMMARY_COLS)
    return s.select("feature", big("count").alias("count"), *[r6(c).alias(c) for c in
                                                                ["mean", "stddev", "min", "p25", "p50", "p75", "max"]])


@query("high_amount_q90", O.BASE + """
SELECT transaction_id, amount,
       CAST(CASE WHEN amount > (SELECT quantile_cont(amount, 0.9) FROM tx) THEN 1 ELSE 0 END AS BIGINT) AS is_high_amount
FROM tx""")
def q_high_amount_q90(spark, d):
    """is_high_amount as amount above its exact 90 % quantile."""
    f = quantile_flag(tx(spark, d), "amount", 0.9)
    return f.select("transaction_id", "amount", big("is_high_amount").alias("is_high_amount"))

"""Alert-rule, registry, monitoring and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ts_string
from ..operators import alerts as AL
from ..operators import dashboard as D
from ..operators import quality as Q
from ..operators import registry as G
from ..operators.metrics import collect_metrics, metrics_long
from ..sources import tables
from . import oracle as O
from .base import AS_OF, MONTH_END, alerts, big, query, r6, scored, tx

# ---------------------------------------------------------------- registry from periodic evaluations
CONF_SQL = """
, ev AS (
  SELECT date_trunc('day', transaction_time) AS period,
         count(*) FILTER (WHERE is_fraud_actual AND is_fraud) AS tp,
         count(*) FILTER (WHERE NOT is_fraud_actual AND is_fraud) AS fp,
         count(*) FILTER (WHERE is_fraud_actual AND NOT is_fraud) AS fn,
         count(*) FILTER (WHERE NOT is_fraud_actual AND NOT is_fraud) AS tn
  FROM scored GROUP BY 1)
, reg AS (
  SELECT 'rule_based_' || strftime(period, '%Y%m%d') AS model_version,
         CAST(CAST(CAST(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS VARCHAR) AS DECIMAL(5,4)) AS DOUBLE) AS accuracy,
         CAST(CAST(CAST(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS VARCHAR) AS DECIMAL(5,4)) AS DOUBLE) AS precision_score,
         CAST(CAST(CAST(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS VARCHAR) AS DECIMAL(5,4)) AS DOUBLE) AS recall,
         CAST(CAST(CAST(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS VARCHAR) AS DECIMAL(5,4)) AS DOUBLE) AS f1_score,
         period AS training_date, CAST(tp + fp + fn + tn AS BIGINT) AS dataset_size,
         period + INTERVAL 1 DAY AS created_at
  FROM ev)
"""


def registry(spark, d):
    s = scored(spark, d).withColumn("_y", F.col("is_fraud_actual").cast("int")).withColumn(
        "_p", F.col("is_fraud").cast("int"))
    return G.evaluation_registry(s, "_y", "_p", "day")


def registry_cols(df):
    return df.select("model_version", *[F.col(c).cast("double").alias(c) for c in
                                        ("accuracy", "precision_score", "recall", "f1_score")],
                     ts_string("training_date").alias("training_date"), big("dataset_size").alias("dataset_size"),
                     "is_active", ts_string("created_at").alias("created_at"))


@query("registry_daily_evaluations", O.BASE + CONF_SQL + f"""
SELECT model_version, accuracy, precision_score, recall, f1_score, {O.ts('training_date')} AS training_date,
       dataset_size, FALSE AS is_active, {O.ts('created_at')} AS created_at FROM reg""")
def q_registry_daily(spark, d):
    """G1 + M11: one registry row per day from evaluating the deployed rule scorer on that day's labels."""
    return registry_cols(registry(spark, d))


def activated(spark, d):
    reg = registry(spark, d)
    newest = G.newest_model(reg.select("model_version", "training_date")).select("model_version")
    # G5 + G2: the newest version becomes the only active one.
    return G.activate_model(reg, newest.scalar())


@query("registry_activate_newest", O.BASE + CONF_SQL + f"""
SELECT model_version, accuracy, precision_score, recall, f1_score, {O.ts('training_date')} AS training_date,
       model_version = (SELECT arg_max(model_version, training_date) FROM reg) AS is_active,
       {O.ts('created_at')} AS created_at FROM reg""")
def q_registry_activate_newest(spark, d):
    """G5 + G2 + G3/O8: activate the newest model by training time; list the registry."""
    listed = G.list_models(activated(spark, d))
    return listed.select("model_version", *[F.col(c).cast("double").alias(c) for c in
                                            ("accuracy", "precision_score", "recall", "f1_score")],
                         ts_string("training_date").alias("training_date"), "is_active",
                         ts_string("created_at").alias("created_at"))


@query("active_model", O.BASE + CONF_SQL + """
SELECT model_version, accuracy, precision_score, recall, f1_score FROM reg
ORDER BY training_date DESC LIMIT 1""")
def q_active_model(spark, d):
    """The active model after activation."""
    a = G.active_model(activated(spark, d))
    return a.select("model_version", *[F.col(c).cast("double").alias(c) for c in
                                       ("accuracy", "precision_score", "recall", "f1_score")])


@query("model_degradation_alert", O.BASE + CONF_SQL + f"""
, am AS (SELECT * FROM reg ORDER BY training_date DESC LIMIT 1)
SELECT 'MODEL_PERFORMANCE_DEGRADATION' AS alert_type, 'MEDIUM' AS severity,
       'Model ' || model_version || ' performance below threshold' AS message,
       model_version AS d_model_version, accuracy AS d_accuracy, precision_score AS d_precision,
       recall AS d_recall, '{AS_OF.replace(' ', ' ')}' AS ts
FROM am WHERE accuracy < 0.85 OR precision_score < 0.75 OR recall < 0.75""")
def q_model_degradation_alert(spark, d):
    """R4 + P9 + O9 (+R5 record): active model below the default thresholds."""
    a = AL.model_degradation_alerts(activated(spark, d), AS_OF)
    det = lambda k: F.get_json_object("details", f"$.{k}")
    return a.select("alert_type", "severity", "message", det("model_version").alias("d_model_version"),
                    det("accuracy").cast("double").alias("d_accuracy"),
                    det("precision").cast("double").alias("d_precision"),
                    det("recall").cast("double").alias("d_recall"),
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


# ---------------------------------------------------------------- alert rules
@query("high_value_alerts", O.BASE_DENSE + f"""
SELECT 'HIGH_VALUE_FRAUD' AS alert_type, 'CRITICAL' AS severity,
       printf('High-value fraud detected: $%.2f for user %s', amount, user_id) AS message,
       transaction_id AS d_transaction_id, amount AS d_amount, round(fraud_score, 6) AS d_fraud_score,
       merchant AS d_merchant
FROM dense
WHERE detection_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 31 DAY AND detection_time <= TIMESTAMP '{MONTH_END}'
  AND amount > 1000 AND is_fraud AND alert_status = 'pending'""")
def q_high_value_alerts(spark, d):
    """R1 + P8 + O6 + F20 + F21 + R5 with threshold 1000 over the month (the default 5000 in 5 minutes selects nothing here)."""
    a = AL.high_value_alerts(alerts(spark, d, 0.5), MONTH_END, 1000.0, "31 days")
    det = lambda k: F.get_json_object("details", f"$.{k}")
    return a.select("alert_type", "severity", "message", det("transaction_id").alias("d_transaction_id"),
                    det("amount").cast("double").alias("d_amount"),
                    F.round(det("fraud_score").cast("double"), 6).alias("d_fraud_score"),
                    det("merchant").alias("d_merchant"))


RATE_SQL = f"""
, r AS (
  SELECT count(DISTINCT t.transaction_id) AS total_tx, count(DISTINCT f.transaction_id) AS fraud_tx
  FROM tx t LEFT JOIN dense f ON t.transaction_id = f.transaction_id AND f.is_fraud = TRUE
  WHERE t.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND t.created_at <= TIMESTAMP '{AS_OF}')
, rr AS (SELECT *, CASE WHEN total_tx > 0 THEN CAST(fraud_tx AS DOUBLE) / total_tx ELSE 0 END AS fraud_rate FROM r)
"""


@query("rate_spike_alert", O.BASE_DENSE + RATE_SQL + """
SELECT 'FRAUD_RATE_SPIKE' AS alert_type, 'HIGH' AS severity,
       printf('Fraud rate spike detected: %.2f%%', fraud_rate * 100) AS message,
       CAST(total_tx AS BIGINT) AS d_total, CAST(fraud_tx AS BIGINT) AS d_fraud, round(fraud_rate, 6) AS d_rate
FROM rr WHERE fraud_rate > 0.1""")
def q_rate_spike_alert(spark, d):
    """R2 + A7 + F20 over one day of dense alerts with threshold 0.1."""
    a = AL.rate_spike_alerts(tx(spark, d), alerts(spark, d, 0.5), AS_OF, 0.1, "1 day")
    det = lambda k: F.get_json_object("details", f"$.{k}")
    return a.select("alert_type", "severity", "message", det("total_transactions").cast("long").alias("d_total"),
                    det("fraud_transactions").cast("long").alias("d_fraud"),
                    F.round(det("fraud_rate").cast("double"), 6).alias("d_rate"))


RAPID_SQL = f"""
, ru AS (SELECT user_id, count(*) AS fraud_count FROM dense
         WHERE is_fraud AND detection_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 31 DAY
           AND detection_time <= TIMESTAMP '{MONTH_END}'
         GROUP BY user_id HAVING count(*) >= 12)
"""


@query("rapid_sequence_alerts", O.BASE_DENSE + RAPID_SQL + """
SELECT 'RAPID_FRAUD_SEQUENCE' AS alert_type, 'HIGH' AS severity,
       printf('Rapid fraud sequence from user %s: %d frauds', user_id, fraud_count) AS message,
       user_id AS d_user_id, CAST(fraud_count AS BIGINT) AS d_fraud_count FROM ru""")
def q_rapid_sequence_alerts(spark, d):
    """R3 with threshold 12 over the month of dense alerts."""
    a = AL.rapid_sequence_alerts(alerts(spark, d, 0.5), MONTH_END, 12, "31 days")
    det = lambda k: F.get_json_object("details", f"$.{k}")
    return a.select("alert_type", "severity", "message", det("user_id").alias("d_user_id"),
                    det("fraud_count").cast("long").alias("d_fraud_count"))


TEST_THRESHOLDS = AL.AlertThresholds(high_amount=1000.0, rapid_frauds=12, fraud_rate_spike=0.1,
                                     high_value_window="31 days", rate_window="1 day", rapid_window="31 days")


def all_alerts(spark, d):
    # as_of at month end for the time-bound rules; the rate rule looks at the last day.
    return AL.run_alert_rules(tx(spark, d), alerts(spark, d, 0.5), activated(spark, d), MONTH_END, TEST_THRESHOLDS)


ALL_RULES_SQL = O.BASE_DENSE + CONF_SQL + RAPID_SQL + f"""
, r AS (
  SELECT count(DISTINCT t.transaction_id) AS total_tx, count(DISTINCT f.transaction_id) AS fraud_tx
  FROM tx t LEFT JOIN dense f ON t.transaction_id = f.transaction_id AND f.is_fraud = TRUE
  WHERE t.created_at >= TIMESTAMP '{MONTH_END}' - INTERVAL 1 DAY AND t.created_at <= TIMESTAMP '{MONTH_END}')
, rr AS (SELECT *, CASE WHEN total_tx > 0 THEN CAST(fraud_tx AS DOUBLE) / total_tx ELSE 0 END AS fraud_rate FROM r)
, am AS (SELECT * FROM reg ORDER BY training_date DESC LIMIT 1)
, recs AS (
  SELECT 'HIGH_VALUE_FRAUD' AS alert_type, 'CRITICAL' AS severity,
         printf('High-value fraud detected: $%.2f for user %s', amount, user_id) AS message
  FROM dense WHERE detection_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 31 DAY
    AND detection_time <= TIMESTAMP '{MONTH_END}' AND amount > 1000 AND is_fraud AND alert_status = 'pending'
  UNION ALL
  SELECT 'FRAUD_RATE_SPIKE', 'HIGH', printf('Fraud rate spike detected: %.2f%%', fraud_rate * 100)
  FROM rr WHERE fraud_rate > 0.1
  UNION ALL
  SELECT 'RAPID_FRAUD_SEQUENCE', 'HIGH', printf('Rapid fraud sequence from user %s: %d frauds', user_id, fraud_count)
  FROM ru
  UNION ALL
  SELECT 'MODEL_PERFORMANCE_DEGRADATION', 'MEDIUM', 'Model ' || model_version || ' performance below threshold'
  FROM am WHERE accuracy < 0.85 OR precision_score < 0.75 OR recall < 0.75)
"""


@query("alert_rules", ALL_RULES_SQL + f"""
SELECT alert_type, severity, message, '{MONTH_END}' AS ts FROM recs""")
def q_alert_rules(spark, d):
    """All four rules in one union (test thresholds)."""
    a = all_alerts(spark, d)
    return a.select("alert_type", "severity", "message",
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("alert_audit_rows", ALL_RULES_SQL + f"""
SELECT 'ALERT_' || alert_type AS event_type, message AS event_description, '{MONTH_END}' AS created_at FROM recs""")
def q_alert_audit_rows(spark, d):
    """S13 for R6: one audit row per triggered alert."""
    a = AL.alert_audit_rows(all_alerts(spark, d))
    return a.select("event_type", "event_description",
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# ---------------------------------------------------------------- monitoring
MON_SQL = O.BASE_DENSE + CONF_SQL + f"""
, w AS (SELECT TIMESTAMP '{AS_OF}' AS t)
, txm AS (
  SELECT count(*) FILTER (WHERE created_at >= t - INTERVAL 1 MINUTE AND created_at <= t) AS transactions_per_minute,
         count(*) FILTER (WHERE created_at >= date_trunc('day', t) AND created_at < date_trunc('day', t) + INTERVAL 1 DAY) AS transactions_today,
         round(coalesce(CAST(sum(CAST(amount AS DECIMAL(15,2))) FILTER (WHERE created_at >= t - INTERVAL 1 DAY AND created_at <= t) AS DOUBLE)
               / count(amount) FILTER (WHERE created_at >= t - INTERVAL 1 DAY AND created_at <= t), 0), 2) AS avg_amount_1d
  FROM tx, w)
, fm AS (
  SELECT count(*) FILTER (WHERE detection_time >= t - INTERVAL 1 DAY AND detection_time <= t) AS frauds_detected_1d,
         round(coalesce(CAST(sum(CAST(fraud_score AS DECIMAL(5,4))) FILTER (WHERE detection_time >= t - INTERVAL 1 DAY AND detection_time <= t) AS DOUBLE)
               / count(fraud_score) FILTER (WHERE detection_time >= t - INTERVAL 1 DAY AND detection_time <= t), 0), 4) AS avg_fraud_score,
         count(*) FILTER (WHERE alert_status = 'pending') AS pending_alerts
  FROM dense, w)
, rm AS (
  SELECT CASE WHEN count(DISTINCT tt.transaction_id) > 0
              THEN CAST(count(DISTINCT f.transaction_id) AS DOUBLE) / count(DISTINCT tt.transaction_id) ELSE 0 END AS fraud_rate
  FROM tx tt LEFT JOIN dense f ON tt.transaction_id = f.transaction_id, w
  WHERE tt.created_at >= t - INTERVAL 1 DAY AND tt.created_at <= t)
, am AS (SELECT * FROM reg ORDER BY training_date DESC LIMIT 1)
"""


@query("monitoring_metrics_without_model", MON_SQL + """
SELECT 'transactions_per_minute' AS metric_name, CAST(transactions_per_minute AS DOUBLE) AS metric_value, 'count' AS metric_unit FROM txm
UNION ALL SELECT 'transactions_today', CAST(transactions_today AS DOUBLE), 'count' FROM txm
UNION ALL SELECT 'avg_amount_1d', round(avg_amount_1d, 4), 'ratio' FROM txm
UNION ALL SELECT 'frauds_detected_1d', CAST(frauds_detected_1d AS DOUBLE), 'count' FROM fm
UNION ALL SELECT 'avg_fraud_score', round(avg_fraud_score, 4), 'ratio' FROM fm
UNION ALL SELECT 'pending_alerts', CAST(pending_alerts AS DOUBLE), 'count' FROM fm
UNION ALL SELECT 'fraud_rate', round(fraud_rate, 4), 'ratio' FROM rm""")
def q_monitoring_metrics_without_model(spark, d):
    """A20 with no active model: no rows for a model's figures."""
    wide = collect_metrics(tx(spark, d), alerts(spark, d, 0.5), registry(spark, d), AS_OF, window="1 day")
    return metrics_long(wide, AS_OF).select("metric_name", F.round(F.col("metric_value").cast("double"), 4).alias("metric_value"), "metric_unit")


@query("fraud_rate_without_alert_times", O.BASE_DENSE + f"""
SELECT CAST(count(DISTINCT t.transaction_id) AS BIGINT) AS total_tx, CAST(count(DISTINCT a.transaction_id) AS BIGINT) AS fraud_tx,
       round(count(DISTINCT a.transaction_id) / count(DISTINCT t.transaction_id), 6) AS fraud_rate
FROM tx t LEFT JOIN dense a ON t.transaction_id = a.transaction_id AND a.is_fraud
WHERE t.transaction_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 31 DAY AND t.transaction_time <= TIMESTAMP '{MONTH_END}'""")
def q_fraud_rate_without_alert_times(spark, d):
    """J2 / A7 where half of the alerts (by event id) carry no time of their own: the join is on the id alone."""
    a = alerts(spark, d, 0.5).withColumn("transaction_time", F.when(F.col("event_id") % 2 == 1, F.col("transaction_time")))
    r = D.fraud_rate(tx(spark, d), a, MONTH_END, "31 days")
    return r.select(big("total_tx").alias("total_tx"), big("fraud_tx").alias("fraud_tx"), r6("fraud_rate").alias("fraud_rate"))


@query("volume_without_alert_times", O.BASE_DENSE + f"""
SELECT {O.ts("date_trunc('minute', t.transaction_time)")} AS minute, CAST(count(DISTINCT t.transaction_id) AS BIGINT) AS tx_count,
       CAST(count(DISTINCT a.transaction_id) AS BIGINT) AS fraud_count
FROM tx t LEFT JOIN dense a ON t.transaction_id = a.transaction_id AND a.is_fraud
WHERE t.transaction_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 44640 MINUTE AND t.transaction_time <= TIMESTAMP '{MONTH_END}'
GROUP BY date_trunc('minute', t.transaction_time)""")
def q_volume_without_alert_times(spark, d):
    """A9 where half of the alerts carry no time of their own."""
    a = alerts(spark, d, 0.5).withColumn("transaction_time", F.when(F.col("event_id") % 2 == 1, F.col("transaction_time")))
    v = D.volume_history(tx(spark, d), a, MONTH_END, 44640)
    return v.select(ts_string("minute").alias("minute"), big("tx_count").alias("tx_count"), big("fraud_count").alias("fraud_count"))


@query("rapid_sequence_ids", O.BASE_DENSE + RAPID_SQL + f"""
SELECT d.user_id, d.transaction_id FROM dense d JOIN ru r ON d.user_id = r.user_id
WHERE d.is_fraud AND d.detection_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 31 DAY AND d.detection_time <= TIMESTAMP '{MONTH_END}'""")
def q_rapid_sequence_ids(spark, d):
    """The transactions of each rapid-sequence record, found from the record alone."""
    a = alerts(spark, d, 0.5)
    return AL.rapid_sequence_ids(AL.rapid_sequence_alerts(a, MONTH_END, 12, "31 days"), a).select("user_id", "transaction_id")


@query("missing_values_split", O.BASE + """
, holes AS (SELECT transaction_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 11 <> 0 THEN amount END AS amount FROM tx)
SELECT transaction_id, CASE WHEN user_id IS NULL OR amount IS NULL THEN 'quarantine' ELSE 'valid' END AS part,
       concat_ws(',', CASE WHEN user_id IS NULL THEN 'user_id' END, CASE WHEN amount IS NULL THEN 'amount' END) AS missing FROM holes""")
def q_missing_values_split(spark, d):
    """Q1: required values made NULL by a rule on the event id; both parts of the split."""
    t = tx(spark, d).withColumns({"user_id": F.when(F.col("event_id") % 7 != 0, F.col("user_id")),
                                  "amount": F.when(F.col("event_id") % 11 != 0, F.col("amount"))})
    good, bad = Q.split_valid(t)
    return good.select("transaction_id", F.lit("valid").alias("part"), F.lit("").alias("missing")).unionByName(
        bad.select("transaction_id", F.lit("quarantine").alias("part"), F.array_join("missing", ",").alias("missing")))


@query("amounts_out_of_range", O.BASE + """
SELECT transaction_id, 'amount' AS "column", 'not decimal(5,2)' AS problem FROM tx WHERE amount > 999.99""")
def q_amounts_out_of_range(spark, d):
    """Q4, decimal limits: amounts that do not fit decimal(5,2)."""
    return Q.out_of_range(tx(spark, d), lengths={}, decimals={"amount": (5, 2)})


@query("monitoring_metrics", MON_SQL + """
SELECT metric_name, round(metric_value, 4) AS metric_value, metric_unit FROM (
  SELECT 'transactions_per_minute' AS metric_name, CAST(transactions_per_minute AS DOUBLE) AS metric_value, 'count' AS metric_unit FROM txm
  UNION ALL SELECT 'transactions_today', CAST(transactions_today AS DOUBLE), 'count' FROM txm
  UNION ALL SELECT 'avg_amount_1d', avg_amount_1d, 'ratio' FROM txm
  UNION ALL SELECT 'frauds_detected_1d', CAST(frauds_detected_1d AS DOUBLE), 'count' FROM fm
  UNION ALL SELECT 'avg_fraud_score', avg_fraud_score, 'ratio' FROM fm
  UNION ALL SELECT 'pending_alerts', CAST(pending_alerts AS DOUBLE), 'count' FROM fm
  UNION ALL SELECT 'fraud_rate', fraud_rate, 'ratio' FROM rm
  UNION ALL SELECT 'accuracy', accuracy, 'ratio' FROM am
  UNION ALL SELECT 'precision', precision_score, 'ratio' FROM am
  UNION ALL SELECT 'recall', recall, 'ratio' FROM am
  UNION ALL SELECT 'f1_score', f1_score, 'ratio' FROM am)""")
def q_monitoring_metrics(spark, d):
    """A19 + A20 + P6 + T12 (+S9 rows): monitoring metrics in long form, 1-day window on ingest time."""
    wide = collect_metrics(tx(spark, d), alerts(spark, d, 0.5), activated(spark, d), AS_OF, window="1 day")
    long = metrics_long(wide, AS_OF)
    return long.select("metric_name", F.round(F.col("metric_value").cast("double"), 4).alias("metric_value"),
                       "metric_unit")


# ---------------------------------------------------------------- data quality on the larger input
ORDERS_TX_SQL = """
, otx AS (
  SELECT 'TXN_' || CAST(l.l_orderkey AS VARCHAR) || '_' || CAST(l.l_linenumber AS VARCHAR) AS transaction_id,
         'USER_' || CAST(o.o_custkey AS VARCHAR) AS user_id, l.l_extendedprice AS amount, 'USD' AS currency,
         s.s_name AS merchant, l.l_shipdate AS transaction_time, n.n_name AS country,
         'purchase' AS transaction_type, l.l_shipdate AS created_at
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)
"""


def otx(spark, d):
    return tables.transactions_from_orders(spark, d)


@query("orders_quality_split", "WITH " + ORDERS_TX_SQL.lstrip().lstrip(",") + """
SELECT CAST(count(*) FILTER (WHERE transaction_id IS NOT NULL AND user_id IS NOT NULL AND amount IS NOT NULL
                              AND transaction_time IS NOT NULL) AS BIGINT) AS valid_rows,
       CAST(count(*) FILTER (WHERE transaction_id IS NULL OR user_id IS NULL OR amount IS NULL
                              OR transaction_time IS NULL) AS BIGINT) AS quarantined_rows
FROM otx""")
def q_orders_quality_split(spark, d):
    """Q1: NOT NULL split of the order-based transactions (counts of both sides)."""
    valid, bad = Q.split_valid(otx(spark, d))
    return valid.agg(F.count(F.lit(1)).alias("valid_rows")).select(
        "valid_rows", bad.agg(F.count(F.lit(1))).scalar().alias("quarantined_rows"))


@query("orders_duplicate_ids", "WITH " + ORDERS_TX_SQL.lstrip().lstrip(",") + """
SELECT transaction_id, CAST(count(*) AS BIGINT) AS copies FROM otx GROUP BY 1 HAVING count(*) > 1""")
def q_orders_duplicate_ids(spark, d):
    """Q2 report: transaction ids that occur more than once."""
    return Q.duplicates(otx(spark, d), "transaction_id").select("transaction_id", big("copies").alias("copies"))


@query("orders_dedupe", "WITH " + ORDERS_TX_SQL.lstrip().lstrip(",") + f"""
SELECT DISTINCT ON (transaction_id) transaction_id, user_id, amount, currency, merchant,
       {O.ts('transaction_time')} AS transaction_time, country, transaction_type, {O.ts('created_at')} AS created_at
FROM otx ORDER BY transaction_id, otx.transaction_time, user_id, amount, currency, merchant, country,
                  transaction_type, otx.created_at""")
def q_orders_dedupe(spark, d):
    """Q2 / T11 batch form: one row per transaction id (the earliest, ties by the other columns)."""
    dd = Q.dedupe(otx(spark, d), "transaction_id", order_by="transaction_time")
    return dd.select("transaction_id", "user_id", "amount", "currency", "merchant",
                     ts_string("transaction_time").alias("transaction_time"), "country", "transaction_type",
                     ts_string("created_at").alias("created_at"))


@query("orders_out_of_range", "WITH " + ORDERS_TX_SQL.lstrip().lstrip(",") + """
SELECT transaction_id, 'country' AS "column", 'length > 10' AS problem FROM otx WHERE length(country) > 10
UNION ALL
SELECT transaction_id, 'merchant', 'length > 200' FROM otx WHERE length(merchant) > 200
UNION ALL
SELECT transaction_id, 'user_id', 'length > 50' FROM otx WHERE length(user_id) > 50""")
def q_orders_out_of_range(spark, d):
    """Q4: varchar-length and decimal(15,2) violations of the order-based transactions."""
    return Q.out_of_range(otx(spark, d))


@query("orders_daily_stats", "WITH " + ORDERS_TX_SQL.lstrip().lstrip(",") + """
SELECT CAST(CAST(transaction_time AS DATE) AS VARCHAR) AS date, CAST(count(*) AS BIGINT) AS total_transactions,
       round(CAST(sum(CAST(amount AS DECIMAL(15,2))) AS DOUBLE) / count(amount), 6) AS avg_amount,
       max(amount) AS max_amount, min(amount) AS min_amount,
       CAST(count(DISTINCT user_id) AS BIGINT) AS unique_users,
       CAST(count(DISTINCT merchant) AS BIGINT) AS unique_merchants
FROM otx GROUP BY 1""")
def q_orders_daily_stats(spark, d):
    """A11 on the larger input (five-table join)."""
    s = D.daily_transaction_stats(otx(spark, d), tables.read_table(spark, d, "lineitem").count())
    return s.select(F.col("date").cast("string").alias("date"), big("total_transactions").alias("total_transactions"),
                    r6("avg_amount").alias("avg_amount"), "max_amount", "min_amount",
                    big("unique_users").alias("unique_users"), big("unique_merchants").alias("unique_merchants"))


@query("alert_table_rows", O.BASE + f"""
SELECT transaction_id, user_id, CAST(CAST(amount AS DECIMAL(15,2)) AS DOUBLE) AS amount, merchant,
       CAST(CAST(fraud_score AS DECIMAL(5,4)) AS DOUBLE) AS fraud_score, is_fraud, model_version,
       {O.ts('transaction_time')} AS transaction_time, 'pending' AS alert_status, '{AS_OF}' AS detection_time
FROM scored WHERE is_fraud""")
def q_alert_table_rows(spark, d):
    """S5/S6 row shapes + Q5 + P4: flagged rows as stored alerts: 8 columns, table types, defaults for status and detection time."""
    from ..sources.sinks import alert_rows

    rows = alert_rows(scored(spark, d), table_defaults=False)
    rows = Q.with_defaults(rows, {"alert_status": "pending",
                                  "detection_time": F.lit(AS_OF).cast("timestamp")})
    return rows.select("transaction_id", "user_id", F.col("amount").cast("double").alias("amount"), "merchant",
                       F.col("fraud_score").cast("double").alias("fraud_score"), "is_fraud", "model_version",
                       ts_string("transaction_time").alias("transaction_time"), "alert_status",
                       F.date_format("detection_time", "yyyy-MM-dd HH:mm:ss").alias("detection_time"))


@query("orders_out_of_range_tight", "WITH " + ORDERS_TX_SQL.lstrip().lstrip(",") + """
SELECT transaction_id, 'country' AS "column", 'length > 8' AS problem FROM otx WHERE length(country) > 8
UNION ALL
SELECT transaction_id, 'merchant', 'length > 12' FROM otx WHERE length(merchant) > 12""")
def q_orders_out_of_range_tight(spark, d):
    """Q4 with tighter column limits (country 8, merchant 12) so violations occur in the given data."""
    return Q.out_of_range(otx(spark, d), lengths={"country": 8, "merchant": 12}, decimals={})


@query("high_score_alerts", O.BASE_DENSE + f"""
SELECT 'HIGH_FRAUD_SCORE' AS alert_type, 'HIGH' AS severity,
       printf('High fraud score %.4f for transaction %s', fraud_score, transaction_id) AS message,
       transaction_id AS d_transaction_id, round(fraud_score, 6) AS d_fraud_score
FROM dense
WHERE detection_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 31 DAY AND detection_time <= TIMESTAMP '{MONTH_END}'
  AND is_fraud AND fraud_score >= 0.95""")
def q_high_score_alerts(spark, d):
    """R7's declared 0.95 score threshold as an optional rule (month window)."""
    a = AL.high_score_alerts(alerts(spark, d, 0.5), MONTH_END, 0.95, "31 days")
    det = lambda k: F.get_json_object("details", f"$.{k}")
    return a.select("alert_type", "severity", "message", det("transaction_id").alias("d_transaction_id"),
                    F.round(det("fraud_score").cast("double"), 6).alias("d_fraud_score"))


@query("activation_audit", O.BASE + CONF_SQL + f"""
SELECT 'MODEL_ACTIVATED' AS event_type,
       'Model ' || (SELECT arg_max(model_version, training_date) FROM reg) || ' activated for production' AS event_description,
       (SELECT arg_max(model_version, training_date) FROM reg) AS model_version, '{AS_OF}' AS created_at""")
def q_activation_audit(spark, d):
    """S13 for G2: the audit row of activating the newest registry version."""
    reg = registry(spark, d)
    newest = G.newest_model(reg.select("model_version", "training_date")).first()["model_version"]
    a = G.activation_audit(reg, newest, AS_OF)
    return a.select("event_type", "event_description", "model_version",
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("model_performance_record", O.BASE + CONF_SQL + f"""
SELECT model_version, accuracy, precision_score, recall, f1_score, {O.ts('training_date')} AS training_date,
       dataset_size, TRUE AS is_active, {O.ts('created_at')} AS created_at
FROM reg ORDER BY training_date DESC LIMIT 1""")
def q_model_performance_record(spark, d):
    """G4/O9 + P13: the dashboard's model-performance record of the active model."""
    a = G.active_model(activated(spark, d), full=True)
    return a.select("model_version", *[F.col(c).cast("double").alias(c) for c in
                                       ("accuracy", "precision_score", "recall", "f1_score")],
                    ts_string("training_date").alias("training_date"), big("dataset_size").alias("dataset_size"),
                    "is_active", ts_string("created_at").alias("created_at"))

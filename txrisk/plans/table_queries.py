"""Table rows, helpers and registry operators that no other query calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import model_version_name, percent, round_to, ts_string
from ..operators import alerts as AL
from ..operators import dashboard as D
from ..operators import features as FE
from ..operators import ml as M
from ..operators import registry as G
from ..operators.stats import feature_summary
from ..sources.sinks import transaction_rows
from . import oracle as O
from .base import AS_OF, MONTH_END, ORACLE, alerts, big, query, r6, scored, tx
from .dashboard_queries import record_cols
from .rules_queries import CONF_SQL, registry


@query("transaction_table_rows", O.BASE + f"""
SELECT transaction_id, user_id, CAST(CAST(amount AS DECIMAL(15,2)) AS DOUBLE) AS amount, currency, merchant, country, transaction_type,
       {O.ts('transaction_time')} AS transaction_time, CAST(CAST(transaction_time AS DATE) AS VARCHAR) AS transaction_date FROM tx""")
def q_transaction_table_rows(spark, d):
    """The rows that the transactions sink writes."""
    return transaction_rows(scored(spark, d)).select(
        "transaction_id", "user_id", F.col("amount").cast("double").alias("amount"), "currency", "merchant", "country", "transaction_type",
        ts_string("transaction_time").alias("transaction_time"), F.col("transaction_date").cast("string").alias("transaction_date"))


ENCODERS_SQL = "".join(f"""
, e_{c} AS (SELECT {c} AS v, dense_rank() OVER (ORDER BY {c}) - 1 AS i FROM (SELECT DISTINCT {c} FROM tx WHERE {c} IS NOT NULL))"""
                       for c in S.CATEGORICAL_FEATURES)


@query("model_input_rows", O.BASE + ENCODERS_SQL + """
SELECT event_id, round(amount, 6) AS amount, CAST(hour AS BIGINT) AS hour, CAST(day_of_week AS BIGINT) AS day_of_week, CAST(0 AS BIGINT) AS user_frequency,
       round(amount_log, 6) AS amount_log, CAST(is_night AS BIGINT) AS is_night, CAST(is_weekend AS BIGINT) AS is_weekend,
       CAST(is_high_amount AS BIGINT) AS is_high_amount, CAST(is_unknown_merchant AS BIGINT) AS is_unknown_merchant,
       CAST(is_foreign_country AS BIGINT) AS is_foreign_country, CAST(coalesce(m.i, -1) AS BIGINT) AS merchant_encoded,
       CAST(coalesce(c.i, -1) AS BIGINT) AS country_encoded, CAST(coalesce(t.i, -1) AS BIGINT) AS transaction_type_encoded
FROM feat LEFT JOIN e_merchant m ON merchant = m.v LEFT JOIN e_country c ON country = c.v LEFT JOIN e_transaction_type t ON transaction_type = t.v""")
def q_model_input_rows(spark, d):
    """The model's columns in order, one that is missing (user_frequency) as 0, the raw categories dropped."""
    feats = FE.serving_features(tx(spark, d)).drop("user_frequency")
    out, _ = M.preprocess(feats, M.fit_encoder(feats, S.CATEGORICAL_FEATURES), "event_id")
    return out.select("event_id", *[(r6(c) if c in ("amount", "amount_log") else big(c)).alias(c) for c in S.MODEL_FEATURES])


@query("recent_transactions_reversed", ORACLE["recent_transactions"])
def q_recent_transactions_reversed(spark, d):
    """The newest page, oldest row first (top-k is the feature)."""
    return record_cols(D.recent_transactions(tx(spark, d), alerts(spark, d, 0.5), 20, ascending=True))


@query("transactions_newer_than", O.BASE + """
SELECT transaction_id FROM tx WHERE transaction_time > (SELECT max(transaction_time) FROM tx WHERE transaction_id = 'TXN_500')""")
def q_transactions_newer_than(spark, d):
    """All transactions newer than the anchor."""
    return D.newer_than(tx(spark, d), "TXN_500").select("transaction_id")


@query("numeric_feature_summary", O.BASE + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean FROM feat" for c in (
        "amount", "hour", "day_of_week", "amount_log", "is_night", "is_weekend", "user_frequency", "is_high_amount")))
def q_numeric_feature_summary(spark, d):
    """Summary of the columns that are found to be numeric."""
    f = FE.serving_features(tx(spark, d)).select("amount", "merchant", "hour", "day_of_week", "amount_log", "is_night", "transaction_time",
                                                 "is_weekend", "country", "user_frequency", "is_high_amount", "is_fraud_actual")
    return feature_summary(f, FE.numeric_columns(f)).select("feature", big("count").alias("count"), r6("mean").alias("mean"))


@query("merchant_fraud_rates", O.BASE + """
SELECT merchant, round(n / t, 4) AS fraud_rate, printf('%.2f%%', n / t * 100.0) AS fraud_rate_text
FROM (SELECT merchant, count(*) FILTER (WHERE is_fraud_actual) AS n, count(*) AS t FROM tx GROUP BY 1)""")
def q_merchant_fraud_rates(spark, d):
    """Fraud rate of each merchant, rounded and as text."""
    rates = tx(spark, d).groupBy("merchant").agg((F.count_if("is_fraud_actual") / F.count(F.lit(1))).alias("r"))
    return rates.select("merchant", round_to(F.col("r"), 4).alias("fraud_rate"), percent(F.col("r")).alias("fraud_rate_text"))


@query("daily_model_versions", O.BASE + """
SELECT 'fraud_model_' || strftime(date_trunc('day', transaction_time), '%Y%m%d_%H%M%S') AS model_version, CAST(count(*) AS BIGINT) AS transactions
FROM tx GROUP BY 1""")
def q_daily_model_versions(spark, d):
    """The version name that a model trained at the start of each day would get."""
    day = tx(spark, d).groupBy(F.date_trunc("day", "transaction_time").alias("day")).agg(F.count(F.lit(1)).alias("transactions"))
    return day.select(model_version_name("day").alias("model_version"), "transactions")


@query("registered_models", O.BASE + CONF_SQL + f"""
SELECT model_version, accuracy, precision_score, recall, f1_score, {O.ts('training_date')} AS training_date, FALSE AS is_active,
       '{{"model_type":"rule_based"}}' AS hyperparameters, '{AS_OF}' AS created_at FROM reg""")
def q_registered_models(spark, d):
    """Metadata of the daily evaluations, registered as models."""
    r = registry(spark, d)
    as_double = lambda c, n: F.col(c).cast("double").alias(n)
    infos = r.select(
        F.lit("rule_based").alias("model_type"), F.col("model_version").alias("version"), ts_string("training_date", micros=False).alias("training_date"),
        F.struct(as_double("accuracy", "accuracy"), as_double("precision_score", "precision"), as_double("recall", "recall"),
                 as_double("f1_score", "f1_score"), F.lit(None).cast("map<string,double>").alias("feature_importance")).alias("metrics"))
    reg = G.register_model(spark.createDataFrame([], S.MODEL_PERFORMANCE), infos, AS_OF)
    return reg.select("model_version", *[as_double(c, c) for c in ("accuracy", "precision_score", "recall", "f1_score")],
                      ts_string("training_date").alias("training_date"), "is_active", "hyperparameters",
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("alert_cache_keys", O.BASE_DENSE + f"""
SELECT 'alert:HIGH_VALUE_FRAUD:' || CAST(epoch(TIMESTAMP '{MONTH_END}') AS BIGINT) AS key,
       strftime(TIMESTAMP '{MONTH_END}' + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS expires_at
FROM dense
WHERE detection_time >= TIMESTAMP '{MONTH_END}' - INTERVAL 31 DAY AND detection_time <= TIMESTAMP '{MONTH_END}'
  AND amount > 1000 AND is_fraud AND alert_status = 'pending'""")
def q_alert_cache_keys(spark, d):
    """Key and expiry of the cached form of alert records."""
    rows = AL.alert_cache_rows(AL.high_value_alerts(alerts(spark, d, 0.5), MONTH_END, 1000.0, "31 days"))
    return rows.select("key", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))

"""Model evaluation, encoding, scaling and training queries.

The deployed scorer is the rule score (R0); the labels are the hidden
``is_fraud_actual`` of the transactions.
"""

from __future__ import annotations

from pyspark.sql import functions as F


from .. import schemas as S
from ..operators import ml as M
from ..operators.features import user_frequency_table
from ..operators.stats import fit_scaler, scale
from . import oracle as O
from .base import big, query, r6, scored, tx

CONF_ALL_SQL = """
, cm AS (
  SELECT count(*) FILTER (WHERE is_fraud_actual AND is_fraud) AS tp,
         count(*) FILTER (WHERE NOT is_fraud_actual AND is_fraud) AS fp,
         count(*) FILTER (WHERE is_fraud_actual AND NOT is_fraud) AS fn,
         count(*) FILTER (WHERE NOT is_fraud_actual AND NOT is_fraud) AS tn
  FROM scored)
"""


def labelled(spark, d):
    return scored(spark, d).withColumns({"label": F.col("is_fraud_actual").cast("int"),
                                         "prediction": F.col("is_fraud").cast("int")})


def metric_cols(df, *extra):
    return df.select(*extra, big("tp").alias("tp"), big("fp").alias("fp"), big("fn").alias("fn"),
                     big("tn").alias("tn"), big("n").alias("n"), r6("accuracy").alias("accuracy"),
                     r6("precision").alias("precision"), r6("recall").alias("recall"),
                     r6("f1_score").alias("f1_score"))


METRICS_SELECT_SQL = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(tn AS BIGINT) AS tn, CAST(tp + fp + fn + tn AS BIGINT) AS n,
       round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1_score"""


@query("rule_model_metrics", O.BASE + CONF_ALL_SQL + f"SELECT {METRICS_SELECT_SQL} FROM cm")
def q_rule_model_metrics(spark, d):
    """Accuracy, precision, recall, F1 of the rule scorer against the labels."""
    return metric_cols(M.binary_metrics(labelled(spark, d)))


@query("daily_model_metrics", O.BASE + """
, cm AS (
  SELECT CAST(CAST(transaction_time AS DATE) AS VARCHAR) AS date,
         count(*) FILTER (WHERE is_fraud_actual AND is_fraud) AS tp,
         count(*) FILTER (WHERE NOT is_fraud_actual AND is_fraud) AS fp,
         count(*) FILTER (WHERE is_fraud_actual AND NOT is_fraud) AS fn,
         count(*) FILTER (WHERE NOT is_fraud_actual AND NOT is_fraud) AS tn
  FROM scored GROUP BY 1)
""" + f"SELECT date, {METRICS_SELECT_SQL} FROM cm")
def q_daily_model_metrics(spark, d):
    """M11 per day (grouped metrics in one aggregation)."""
    lab = labelled(spark, d).withColumn("date", F.to_date("transaction_time").cast("string"))
    return metric_cols(M.binary_metrics(lab, by=["date"]), "date")


@query("confusion_matrix", O.BASE + """
SELECT CAST(is_fraud_actual AS INTEGER) AS actual,
       CAST(count(*) FILTER (WHERE NOT is_fraud) AS BIGINT) AS predicted_0,
       CAST(count(*) FILTER (WHERE is_fraud) AS BIGINT) AS predicted_1
FROM scored GROUP BY 1""")
def q_confusion_matrix(spark, d):
    """2 x 2 confusion matrix."""
    c = M.confusion_matrix(labelled(spark, d))
    return c.select(F.col("actual").cast("int").alias("actual"), big("predicted_0").alias("predicted_0"),
                    big("predicted_1").alias("predicted_1"))


@query("class_report", O.BASE + CONF_ALL_SQL + """
, pr AS (
  SELECT CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / (tn + fn) ELSE 0 END AS p0,
         CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END AS r0,
         CASE WHEN 2 * tn + fn + fp > 0 THEN CAST(2 * tn AS DOUBLE) / (2 * tn + fn + fp) ELSE 0 END AS f0,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p1,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r1,
         CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1,
         CAST(tn + fp AS DOUBLE) AS s0, CAST(tp + fn AS DOUBLE) AS s1,
         CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS acc
  FROM cm)
SELECT 'Normal' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1_score, CAST(s0 AS BIGINT) AS support FROM pr
UNION ALL SELECT 'Fraud', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM pr
UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 6), CAST(s0 + s1 AS BIGINT) FROM pr
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(s0 + s1 AS BIGINT) FROM pr
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6), round((r0 * s0 + r1 * s1) / (s0 + s1), 6),
                 round((f0 * s0 + f1 * s1) / (s0 + s1), 6), CAST(s0 + s1 AS BIGINT) FROM pr""")
def q_class_report(spark, d):
    """Per-class precision / recall / F1 / support with accuracy, macro and weighted averages."""
    r = M.class_report(labelled(spark, d))
    return r.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1_score").alias("f1_score"), big("support").alias("support"))


SCORE_COUNTS_SQL = """
, sc AS (SELECT fraud_score AS s, count(*) FILTER (WHERE is_fraud_actual) AS pos,
                count(*) FILTER (WHERE NOT is_fraud_actual) AS neg FROM scored GROUP BY 1)
"""


@query("rule_score_auc", O.BASE + SCORE_COUNTS_SQL + """
, pre AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before FROM sc)
SELECT round(CAST(sum(pos * (neg_before + 0.5 * neg)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc FROM pre""")
def q_rule_score_auc(spark, d):
    """Exact ROC-AUC of the rule score (ties count one half)."""
    return M.roc_auc(labelled(spark, d), "label", "fraud_score").select(r6("roc_auc").alias("roc_auc"))


@query("roc_points", O.BASE + SCORE_COUNTS_SQL + """
SELECT round(s, 6) AS threshold,
       round(CAST(sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(neg) OVER (), 6) AS fpr,
       round(CAST(sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(pos) OVER (), 6) AS tpr
FROM sc""")
def q_roc_points(spark, d):
    """ROC curve points per distinct threshold."""
    p = M.roc_points(labelled(spark, d), "label", "fraud_score")
    return p.select(r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


ENC_SQL = O.BASE + """
, fit AS (SELECT * FROM tx WHERE transaction_type <> 'refund')
, em AS (SELECT merchant AS v, dense_rank() OVER (ORDER BY merchant) - 1 AS i FROM (SELECT DISTINCT merchant FROM fit WHERE merchant IS NOT NULL))
, ec AS (SELECT country AS v, dense_rank() OVER (ORDER BY country) - 1 AS i FROM (SELECT DISTINCT country FROM fit WHERE country IS NOT NULL))
, et AS (SELECT transaction_type AS v, dense_rank() OVER (ORDER BY transaction_type) - 1 AS i FROM (SELECT DISTINCT transaction_type FROM fit WHERE transaction_type IS NOT NULL))
SELECT t.transaction_id, CAST(coalesce(em.i, -1) AS BIGINT) AS merchant_encoded,
       CAST(coalesce(ec.i, -1) AS BIGINT) AS country_encoded, CAST(coalesce(et.i, -1) AS BIGINT) AS transaction_type_encoded
FROM tx t LEFT JOIN em ON t.merchant = em.v LEFT JOIN ec ON t.country = ec.v LEFT JOIN et ON t.transaction_type = et.v"""


@query("label_encoding", ENC_SQL)
def q_label_encoding(spark, d):
    """M1 + M2: sorted-value encoders fitted without refunds; refunds encode to -1."""
    t = tx(spark, d)
    enc = M.fit_encoder(t.filter(F.col("transaction_type") != "refund"))
    e = M.encode(t, enc)
    return e.select("transaction_id", big("merchant_encoded").alias("merchant_encoded"),
                    big("country_encoded").alias("country_encoded"),
                    big("transaction_type_encoded").alias("transaction_type_encoded"))


SCALE_COLS = ["amount", "hour", "day_of_week", "amount_log", "is_night"]


@query("scaler_fit", O.BASE + "SELECT " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in SCALE_COLS) + " FROM feat")
def q_scaler_fit(spark, d):
    """Population mean and standard deviation per feature (one row)."""
    from ..operators.features import serving_features

    s = fit_scaler(serving_features(tx(spark, d)), SCALE_COLS)
    return s.select(*[r6(c).alias(c) for c in s.columns])


@query("scaled_features", O.BASE + "SELECT transaction_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}_scaled"
    for c in SCALE_COLS) + " FROM feat")
def q_scaled_features(spark, d):
    """M3: standardised features, statistics from one aggregate (scalar subquery, no join)."""
    from ..operators.features import serving_features

    f = serving_features(tx(spark, d))
    s = scale(f, fit_scaler(f, SCALE_COLS), SCALE_COLS, suffix="_scaled")
    return s.select("transaction_id", *[r6(f"{c}_scaled").alias(f"{c}_scaled") for c in SCALE_COLS])


@query("balanced_weights", O.BASE + """
SELECT transaction_id, round(CAST(count(*) OVER () AS DOUBLE)
       / ((SELECT count(DISTINCT is_fraud_actual) FROM tx) * count(*) OVER (PARTITION BY is_fraud_actual)), 6) AS weight
FROM tx""")
def q_balanced_weights(spark, d):
    """M5: class weights n / (k * n_class) attached to each row."""
    w = M.balanced_weights(tx(spark, d), "is_fraud_actual")
    return w.select("transaction_id", r6("weight").alias("weight"))


@query("stratified_split", O.BASE + """
, h AS (SELECT transaction_id, CAST(is_fraud_actual AS INTEGER) AS label, ('0x' || substr(md5(transaction_id || '|42'), 1, 15))::BIGINT AS h FROM tx)
SELECT transaction_id, label, CASE WHEN rank() OVER (PARTITION BY label ORDER BY h) <= round(0.2 * count(*) OVER (PARTITION BY label))
       THEN 'test' ELSE 'train' END AS split FROM h""")
def q_stratified_split(spark, d):
    """M4: exact per-class 80/20 split by a seeded hash."""
    t = tx(spark, d).withColumn("label", F.col("is_fraud_actual").cast("int"))
    train, test = M.stratified_split(t, "label", "transaction_id", 0.2, 42)
    return (train.select("transaction_id", "label", F.lit("train").alias("split"))
            .unionByName(test.select("transaction_id", "label", F.lit("test").alias("split"))))


def _training_frame(spark, d):
    t = tx(spark, d)
    hist = user_frequency_table(t)
    from ..operators.features import serving_features

    return serving_features(t, user_stats=hist).withColumn("label", F.col("is_fraud_actual").cast("int"))


CUT = "2024-01-22 00:00:00"


def _scored_rows(spark, d, kind, version, **params):
    """A model trained on the first three weeks, scoring the rest."""
    frame = _training_frame(spark, d)
    cut = F.lit(CUT).cast("timestamp")
    model = M.train(frame.filter(F.col("transaction_time") < cut), "label", kind, version=version, **params)
    return model, M.predict(frame.filter(F.col("transaction_time") >= cut), model)


def _checked(pred):
    """What SQL can state of a trained model's rows: each is scored once, within [0, 1], and decided by its score."""
    return pred.select("transaction_id", "label", F.col("fraud_score").between(0.0, 1.0).alias("score_in_range"),
                       (F.col("is_fraud") == (F.col("fraud_score") > 0.5)).alias("decided_by_score"), "model_version")


def _checked_sql(version):
    return O.BASE + f"""
SELECT transaction_id, CAST(is_fraud_actual AS INTEGER) AS label, TRUE AS score_in_range, TRUE AS decided_by_score,
       '{version}' AS model_version FROM tx WHERE transaction_time >= TIMESTAMP '{CUT}'"""


@query("model_predictions", _checked_sql("rf_model"))
def q_model_predictions(spark, d):
    """Random forest trained on the first three weeks, scoring the rest."""
    return _checked(_scored_rows(spark, d, "random_forest", "rf_model", numTrees=20, maxDepth=6)[1])


@query("logistic_predictions", _checked_sql("lr_model"))
def q_logistic_predictions(spark, d):
    """M8 + M9: logistic regression trained on the first three weeks, scoring the rest."""
    return _checked(_scored_rows(spark, d, "logistic", "lr_model", maxIter=100)[1])


# the labels hold a rule on amount and merchant, which trees learn, and one transaction in 97 by chance
AUC_FLOOR = 0.6


@query("model_quality", O.BASE + f"""
SELECT k AS model_type, TRUE AS auc_above_floor, CAST(13 AS BIGINT) AS features, CAST(1.0 AS DOUBLE) AS total_importance,
       (SELECT CAST(count(*) AS BIGINT) FROM tx WHERE transaction_time >= TIMESTAMP '{CUT}') AS rows_scored
FROM (VALUES ('random_forest'), ('gradient_boosting')) AS t(k)""")
def q_model_quality(spark, d):
    """Held-out AUC of both tree models against a floor, and their importances."""
    parts = []
    for kind, params in (("random_forest", {"numTrees": 20, "maxDepth": 6}), ("gradient_boosting", {"maxIter": 10, "maxDepth": 3})):
        model, pred = _scored_rows(spark, d, kind, kind, **params)
        auc = M.roc_auc(pred, "label", "fraud_score")
        imp = M.feature_importance(model, spark).agg(F.count(F.lit(1)).alias("n"), F.sum("importance").alias("s"))
        parts.append(pred.agg(F.count(F.lit(1)).alias("rows_scored")).select(
            F.lit(kind).alias("model_type"), (auc.scalar() > AUC_FLOOR).alias("auc_above_floor"),
            imp.select("n").scalar().alias("features"), F.round(imp.select("s").scalar(), 6).alias("total_importance"), "rows_scored"))
    return parts[0].unionByName(parts[1])


@query("model_feature_importance", """
SELECT CAST(10 AS BIGINT) AS features, TRUE AS in_order, TRUE AS known_features, TRUE AS shares FROM (SELECT count(*) FROM events)""")
def q_model_feature_importance(spark, d):
    """M7 + M16 + O10: the top 10 importances of a gradient-boosted model: most important first, shares of 1."""
    frame = _training_frame(spark, d)
    model = M.train(frame, "label", "gradient_boosting", maxIter=10, maxDepth=3, version="gbt_model")
    top = M.top_features(M.feature_importance(model, spark), 10)
    values = F.transform(F.array_sort(F.collect_list(F.struct("rank", "importance"))), lambda x: x["importance"])
    top = top.withColumn("rank", F.monotonically_increasing_id()).agg(
        F.count(F.lit(1)).alias("features"), (values == F.reverse(F.array_sort(F.collect_list("importance")))).alias("in_order"),
        F.every(F.col("feature").isin(list(S.MODEL_FEATURES))).alias("known_features"),
        (F.min("importance").between(0, 1) & (F.sum("importance") <= 1.000001)).alias("shares"))
    return top



"""Write-then-read queries of sinks, file sources and the scoring stream.

Each writes what Spark derives from the given tables to a new folder of the shared checkpoint folder and returns what
the matching reader gives back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import ts_string
from ..operators import ml as M
from ..operators import registry as G
from ..operators.features import serving_features
from ..operators.scoring import flagged
from ..session import checkpoint_dir
from ..sources import sinks
from ..sources.files import read_history_csv, read_messages_stream, write_features
from ..sources.kafka import parse_messages, to_messages
from ..streaming.stream import metrics_snapshot, run_stream
from . import oracle as O
from . import table_queries  # noqa: F401  (its SQL is looked up below)
from .base import AS_OF, ORACLE, alerts, big, query, r6, scored, tx
from .ml_queries import CONF_ALL_SQL, labelled
from .rules_queries import activated, all_alerts, registry


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("history_csv_features", O.BASE + f"""
SELECT transaction_id, user_id, round(amount, 6) AS amount, {O.ts('transaction_time')} AS transaction_time, CAST(hour AS BIGINT) AS hour,
       CAST(day_of_week AS BIGINT) AS day_of_week, round(amount_log, 6) AS amount_log, CAST(is_foreign_country AS BIGINT) AS is_foreign_country FROM feat""")
def q_history_csv_features(spark, d):
    """S3 + S4: history written as CSV, read with its schema, featurised, written as Parquet and read again."""
    csv, out = _folder(spark, "history-csv"), _folder(spark, "features")
    t = tx(spark, d)
    t.select(*[f.name for f in S.HISTORICAL_TRANSACTION.fields if f.name in t.columns]).write.option("header", True).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(csv)
    columns = [f for f in S.HISTORICAL_TRANSACTION.fields if f.name in t.columns]
    write_features(serving_features(read_history_csv(spark, csv, type(S.HISTORICAL_TRANSACTION)(columns))), out)
    f = spark.read.parquet(out)
    return f.select("transaction_id", "user_id", r6("amount").alias("amount"), ts_string(F.col("transaction_time").cast("timestamp")).alias("transaction_time"),
                    big("hour").alias("hour"), big("day_of_week").alias("day_of_week"), r6("amount_log").alias("amount_log"), big("is_foreign_country").alias("is_foreign_country"))


@query("flagged_rows_written", O.BASE + """
SELECT transaction_id, user_id, round(CAST(amount AS DOUBLE), 2) AS amount, round(fraud_score, 4) AS fraud_score, 'pending' AS alert_status FROM scored WHERE is_fraud""")
def q_flagged_rows_written(spark, d):
    """P4 + S6: flagged rows appended to the alerts table and read back."""
    path = _folder(spark, "alerts")
    sinks.sink_alerts(flagged(scored(spark, d)), path, AS_OF)
    a = spark.read.parquet(path)
    return a.select("transaction_id", "user_id", F.round(F.col("amount").cast("double"), 2).alias("amount"),
                    F.round(F.col("fraud_score").cast("double"), 4).alias("fraud_score"), "alert_status")


@query("alert_log_lines", ORACLE["alert_rules"])
def q_alert_log_lines(spark, d):
    """Triggered alerts appended as JSON lines and read back."""
    path = _folder(spark, "alert-log")
    sinks.sink_alert_log(all_alerts(spark, d), path)
    v = lambda k: F.get_json_object("value", f"$.{k}")
    return spark.read.text(path).select(v("alert_type").alias("alert_type"), v("severity").alias("severity"), v("message").alias("message"),
                                        F.date_format(F.to_timestamp(v("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("metrics_table", ORACLE["monitoring_metrics"])
def q_metrics_table(spark, d):
    """S9 + T12: one monitoring snapshot appended to the metrics table and read back."""
    path = _folder(spark, "metrics")
    metrics_snapshot(tx(spark, d), alerts(spark, d, 0.5), activated(spark, d), path, AS_OF, "1 day")
    return spark.read.parquet(path).select("metric_name", F.round(F.col("metric_value").cast("double"), 4).alias("metric_value"), "metric_unit")


@query("evaluation_report", O.BASE + CONF_ALL_SQL + """
SELECT 'rule_based' AS model_version, '2024-01-30T00:00:00.000000' AS evaluation_date,
       round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1_score FROM cm""")
def q_evaluation_report(spark, d):
    """The evaluation report of the rule scorer, written as JSON and read back."""
    path = _folder(spark, "report")
    sinks.write_report(M.binary_metrics(labelled(spark, d)), path, S.RULE_MODEL_VERSION, AS_OF)
    r = sinks.read_report(spark, path)
    return r.select("model_version", "evaluation_date", *[r6(F.col("metrics")[c]).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@query("model_directories", ORACLE["registered_models"])
def q_model_directories(spark, d):
    """Metadata of the daily evaluations, one JSON file in a folder of its own each, read with a pattern and registered."""
    path = _folder(spark, "models")
    as_double = lambda c, n: F.col(c).cast("double").alias(n)
    info = F.struct(F.lit("rule_based").alias("model_type"), F.col("model_version").alias("version"), ts_string("training_date", micros=False).alias("training_date"),
                    F.struct(as_double("accuracy", "accuracy"), as_double("precision_score", "precision"), as_double("recall", "recall"),
                             as_double("f1_score", "f1_score")).alias("metrics"))
    registry(spark, d).select(F.to_json(info).alias("value"), F.col("model_version").alias("dir")).repartition("dir").write.partitionBy("dir").text(path)
    reg = G.register_model(spark.createDataFrame([], S.MODEL_PERFORMANCE), G.read_model_info(spark, f"{path}/dir=*"), AS_OF)
    return reg.select("model_version", *[as_double(c, c) for c in ("accuracy", "precision_score", "recall", "f1_score")],
                      ts_string("training_date").alias("training_date"), "is_active", "hyperparameters",
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("scored_stream", O.BASE + f"""
SELECT transaction_id, {O.ts('transaction_time')} AS transaction_time, round(CAST(amount AS DOUBLE), 2) AS amount, is_fraud,
       CASE WHEN is_fraud THEN round(fraud_score, 4) END AS fraud_score FROM scored""")
def q_scored_stream(spark, d):
    """All transactions as messages through the scoring stream; both tables it wrote, joined. The second start finds nothing new."""
    root = _folder(spark, "scored-stream")
    to_messages(tx(spark, d)).select(F.col("value").cast("string").alias("value")).write.text(f"{root}/in")
    for _ in range(2):
        messages = parse_messages(read_messages_stream(spark, f"{root}/in"))
        run_stream(messages, f"{root}/transactions", f"{root}/alerts", f"{root}/checkpoint", trigger={"availableNow": True},
                   name=f"scored-{uuid.uuid4().hex}").awaitTermination()
    t = spark.read.parquet(f"{root}/transactions")
    a = spark.read.parquet(f"{root}/alerts").select("transaction_id", "is_fraud", F.round(F.col("fraud_score").cast("double"), 4).alias("fraud_score"))
    return t.join(a, "transaction_id", "left").select(
        "transaction_id", ts_string("transaction_time").alias("transaction_time"), F.round(F.col("amount").cast("double"), 2).alias("amount"),
        F.coalesce("is_fraud", F.lit(False)).alias("is_fraud"), "fraud_score")

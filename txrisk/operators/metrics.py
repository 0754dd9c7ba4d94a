"""Monitoring metrics.

``collect_metrics`` computes every monitoring figure in one row (one pass per
table); ``metrics_long`` turns any one-row frame into (name, value, unit)
rows by the column types, ready to append to a metrics table (S9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dashboard as D
from .registry import active_model


def collect_metrics(tx: DataFrame, alerts: DataFrame, models: DataFrame | None = None, as_of=None,
                    window: str = "1 hour", time_col: str = "created_at") -> DataFrame:
    """Transaction, fraud and active-model metrics in one row.

    Monitoring semantics: windows on ingest time (``created_at``), "today" is
    the calendar day of ``as_of``, the alert count and the fraud rate count any
    alert (not only ``is_fraud``).
    """
    txs = D.tx_counts(tx, as_of, time_col, today="calendar", avg_window=window)
    txs = txs.withColumnRenamed("avg_amount", f"avg_amount_{_tag(window)}")
    fr = D.alert_counts(alerts, as_of, window, fraud_only=False).select(
        F.col("frauds_detected").alias(f"frauds_detected_{_tag(window)}"),
        F.col("avg_fraud_score"), F.col("pending_alerts"))
    rate = D.fraud_rate(tx, alerts, as_of, window, time_col=time_col, fraud_only=False).select("fraud_rate")
    frames = [txs, fr, rate]
    if models is not None:
        am = active_model(models).select(
            "model_version",
            F.col("accuracy").cast("double").alias("accuracy"),
            F.col("precision_score").cast("double").alias("precision"),
            F.col("recall").cast("double").alias("recall"),
            F.col("f1_score").cast("double").alias("f1_score"))
        frames.append(am)
    return D.one_row(frames)


def _tag(window: str) -> str:
    amount, unit = window.split()
    return f"{amount}{unit[0].lower()}"


def metrics_long(df: DataFrame, as_of=None) -> DataFrame:
    """Wide one-row metrics -> (metric_name, metric_value, metric_unit, timestamp).

    Integers -> unit 'count', floating / decimal -> 'ratio', booleans -> 1/0
    'boolean', other types and values that are NULL (no active model) skipped.
    """
    from ..functions.columns import as_of_col

    entries = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, T.BooleanType):
            unit, val = "boolean", F.when(F.col(f.name), F.lit(1.0)).otherwise(F.lit(0.0))
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            unit, val = "count", F.col(f.name).cast("double")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            unit, val = "ratio", F.col(f.name).cast("double")
        else:
            continue
        entries.append(F.struct(F.lit(f.name).alias("metric_name"),
                                val.cast("decimal(15,4)").alias("metric_value"),
                                F.lit(unit).alias("metric_unit")))
    return (df.select(F.explode(F.array(*entries)).alias("m"))
            .select("m.*", as_of_col(as_of).alias("timestamp")).filter(F.col("metric_value").isNotNull()))

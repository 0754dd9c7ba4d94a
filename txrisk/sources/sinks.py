"""Sinks (S4-S9, S12, S13): distributed writes, never a collect to the driver.

Table sinks append Parquet partitioned by ``transaction_date`` (the day of
``transaction_time``); look-back filters on ``transaction_time`` add the matching
partition predicate (``functions.columns.prune``), so whole days are skipped. For idempotent micro-batch writes the streaming layer
passes ``batch`` = (run id, batch id): rows then go to ``run=<id>/batch_id=<n>`` and those partitions are
overwritten (dynamic partition overwrite), so a replayed batch replaces its own output instead of
duplicating it, and a later run, whose batch ids start at 0 again, touches none of it. Plain appends go to
``run=batch/batch_id=<unique>``, so one path has one layout.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import as_of_col, interval, money, score_decimal


def _append(df: DataFrame, path: str, partition_by: list[str], batch: tuple[str, int] | None, fmt: str = "parquet") -> None:
    run, number = batch if batch is not None else ("batch", uuid.uuid4().int % (1 << 62))
    w = df.withColumns({"run": F.lit(str(run)), "batch_id": F.lit(int(number)).cast("bigint")})
    writer = w.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by, "run", "batch_id").format(fmt).save(path)


def transaction_rows(scored: DataFrame) -> DataFrame:
    """S5 rows: the 8 transaction columns with table types, plus ingest time and day."""
    return scored.select(
        "transaction_id", "user_id", money("amount").alias("amount"), "currency", "merchant",
        F.col("transaction_time").cast("timestamp").alias("transaction_time"), "country", "transaction_type",
        F.coalesce(F.col("detection_time"), F.current_timestamp()).alias("created_at")
        if "detection_time" in scored.columns else F.current_timestamp().alias("created_at"),
    ).withColumn("transaction_date", F.to_date("transaction_time"))


def alert_rows(scored: DataFrame, as_of=None, table_defaults: bool = True) -> DataFrame:
    """S6 rows: flagged rows with the alert table's types, and the day of the transaction. ``table_defaults`` fills the
    detection time (that of the score, or now) and the status 'pending'; without it both are left NULL, to be filled by
    ``quality.with_defaults``. The review columns start empty."""
    detected = F.col("detection_time") if "detection_time" in scored.columns else as_of_col(as_of)
    return scored.filter(F.col("is_fraud")).select(
        "transaction_id", "user_id", money("amount").alias("amount"), "merchant",
        score_decimal("fraud_score").alias("fraud_score"), "is_fraud", "model_version",
        F.col("transaction_time").cast("timestamp").alias("transaction_time"),
        (detected if table_defaults else F.lit(None)).cast("timestamp").alias("detection_time"),
        F.lit(S.PENDING_STATUS if table_defaults else None).cast("string").alias("alert_status"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.REVIEW_COLUMNS.fields],
        # the transaction's day: deterministic, so a replayed batch overwrites exactly the partitions of its first attempt
        F.to_date("transaction_time").alias("transaction_date"))


def sink_transactions(scored: DataFrame, path: str, batch: tuple[str, int] | None = None) -> None:
    """Append all scored rows to the transactions table (partitioned by transaction_date)."""
    _append(transaction_rows(scored), path, ["transaction_date"], batch)


def sink_alerts(scored: DataFrame, path: str, as_of=None, batch: tuple[str, int] | None = None) -> None:
    """Append flagged rows to the alerts table, status 'pending'."""
    _append(alert_rows(scored, as_of), path, ["transaction_date"], batch)


def sink_quarantine(rows: DataFrame, path: str, batch: tuple[str, int] | None = None) -> None:
    """Append rows that failed a check, with its reason, to the quarantine table (partitioned by reason)."""
    _append(rows, path, ["reason"], batch)


def alert_payload(alerts: DataFrame, ttl: str = S.ALERT_PAYLOAD_TTL) -> DataFrame:
    """S7 + F21 + T6: cache form of alerts: key ``fraud_alert:<id>``, JSON value, expiry time."""
    ts = F.coalesce(F.col("detection_time"), F.current_timestamp())
    value = F.to_json(F.struct(
        F.col("transaction_id"), F.col("user_id"), F.col("amount").cast("double").alias("amount"),
        F.col("fraud_score").cast("double").alias("fraud_score"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")))
    return alerts.select(F.concat(F.lit(S.ALERT_PAYLOAD_PREFIX), F.col("transaction_id")).alias("key"),
                         value.alias("value"), (ts + interval(ttl)).alias("expires_at"))


def sink_alert_log(alert_records: DataFrame, path: str) -> None:
    """Append each triggered alert as one JSON line."""
    alert_records.select(F.to_json(F.struct(*alert_records.columns)).alias("value")) \
        .write.mode("append").text(path)


def sink_metrics(metrics_long_df: DataFrame, path: str) -> None:
    """Append long-form metrics (see ``metrics.metrics_long``)."""
    metrics_long_df.write.mode("append").parquet(path)


def write_report(metrics: DataFrame, path: str, version: str, as_of=None) -> None:
    """Evaluation report JSON {model_version, evaluation_date, metrics{...}}."""
    cols = [c for c in ("accuracy", "precision", "recall", "f1_score", "roc_auc") if c in metrics.columns]
    metrics.select(F.lit(version).alias("model_version"),
                   F.date_format(as_of_col(as_of), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("evaluation_date"),
                   F.struct(*cols).alias("metrics")).coalesce(1).write.mode("overwrite").json(path)


def read_report(spark, path: str) -> DataFrame:
    """Read evaluation reports (single- or multi-line JSON)."""
    return spark.read.schema(S.EVALUATION_REPORT).option("multiLine", True).json(path)


def sink_audit(audit_rows: DataFrame, path: str) -> None:
    """Append audit rows."""
    audit_rows.write.mode("append").parquet(path)

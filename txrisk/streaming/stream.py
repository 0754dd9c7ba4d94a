"""Structured Streaming jobs.

``run_stream`` is the scoring job: messages -> serving features -> score ->
two table sinks inside ``foreachBatch``, and a quarantine table for what cannot be scored: malformed messages
and rows without a required value (``invalid``), and, with duplicate removal, rows that come after the watermark
(``late``). Each micro-batch is written under its own (run, batch id) partitions with dynamic partition
overwrite. The run id is stored with the query's checkpoint: a batch that is replayed after a failure (the
checkpoint commits only after the batch function returns) replaces its earlier attempt, and the batches of
another checkpoint, whose ids start at 0 again, go to partitions of their own.
Errors are not swallowed: a failing sink fails the query, and the checkpoint
brings it back to the last committed batch.

The windowed aggregates below (T8-T10) are plain functions of a DataFrame:
on a stream they run with a watermark in append mode, on a batch frame the
watermark is a no-op and the same code gives the batch answer.
"""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import as_timestamp, interval
from ..operators.features import micros, serving_features
from ..operators.quality import split_valid
from ..operators.scoring import score
from ..session import checkpoint_dir
from ..sources import sinks
from ..sources.tables import hadoop_path, read_table_if_any


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """Per-query checkpoint location under the cluster's shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "streams", name)


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of a checkpoint's run: made once, kept in the checkpoint folder (any file system that Spark writes)."""
    path = os.path.join(checkpoint, "run_id")
    file, fs = hadoop_path(spark, path)
    if not fs.exists(file):
        spark.range(1).select(F.lit(uuid.uuid4().hex).alias("value")).coalesce(1).write.text(path)
    return spark.read.text(path).first()["value"]


def score_batch(batch: DataFrame, batch_id: int, tx_path: str, alerts_path: str, model=None,
                as_of=None, run: str = "batch", quarantine_path: str | None = None, high_water: bool = False) -> None:
    """T3 + T4 + T5: check and score one micro-batch and fan out to the sinks, idempotently.

    Rows without a required value go to ``quarantine_path`` if given, with what is missing; they are scored like
    any row if not. ``high_water`` keeps the newest stored time for :func:`unseen_rows`."""
    if batch.isEmpty():                    # T5
        return
    good = batch
    if quarantine_path:
        good, bad = split_valid(batch)
        sinks.sink_quarantine(quarantine_rows(bad, "invalid", "missing"), quarantine_path, (run, batch_id))
    scored = score(good, model, as_of).persist()
    try:
        sinks.sink_transactions(scored, tx_path, batch=(run, batch_id))
        sinks.sink_alerts(scored, alerts_path, batch=(run, batch_id))
        if high_water:                     # from the persisted rows
            newest = scored.agg(F.unix_micros(F.max(F.col("transaction_time").cast("timestamp"))).alias("t")).first()["t"]
            mark_stored(batch.sparkSession, tx_path, (run, batch_id), newest)
    finally:
        scored.unpersist()


def quarantine_rows(rows: DataFrame, reason: str, detail: str | None = None) -> DataFrame:
    """Rows for the quarantine table: the row as JSON, why (``detail`` names an array column), and when."""
    cols = [c for c in rows.columns if c != detail]
    return rows.select(F.to_json(F.struct(*cols)).alias("row"), (F.array_join(detail, ",") if detail else F.lit(None).cast("string")).alias("detail"),
                       F.current_timestamp().alias("quarantined_at"), F.lit(reason).alias("reason"))


def _marks(spark: SparkSession, tx_path: str) -> str:
    return tx_path.rstrip("/") + "_newest"


def newest_stored(spark: SparkSession, tx_path: str, own: tuple[str, int]) -> int | None:
    """The newest transaction time (microseconds, UTC) that batches before ``own`` (run, batch id) have stored, those of other runs included.

    Each batch leaves a file with the newest time up to it, named by its number in the folder of its run; older
    files of the run are removed, so this reads a file or two a run, however many batches there were. The first time, on a table
    without marks, the stored rows are scanned once."""
    folder, fs = hadoop_path(spark, _marks(spark, tx_path))
    found = []
    if fs.exists(folder):
        for run in fs.listStatus(folder):
            name = run.getPath().getName()
            numbers = [int(x.getPath().getName()) for x in fs.listStatus(run.getPath()) if x.getPath().getName().isdigit()]
            numbers = [n for n in numbers if name != own[0] or n < own[1]]
            if numbers:
                found.append(f"{_marks(spark, tx_path)}/{name}/{max(numbers)}")
        values = [r["value"] for r in spark.read.text(found).collect()] if found else []
        return max((int(v) for v in values), default=None)
    stored = read_table_if_any(spark, tx_path)
    if stored is None:
        return None
    return stored.filter(~((F.col("run").cast("string") == own[0]) & (F.col("batch_id") == own[1]))).agg(F.unix_micros(F.max("transaction_time")).alias("t")).first()["t"]


def mark_stored(spark: SparkSession, tx_path: str, own: tuple[str, int], newest: int | None, keep: int = 3) -> None:
    """Leave the mark of a batch that has been written; the last ``keep`` marks of its run stay, for batches that are replayed."""
    before = newest_stored(spark, tx_path, own)
    newest = max((t for t in (before, newest) if t is not None), default=None)
    if newest is None:
        return
    target, fs = hadoop_path(spark, f"{_marks(spark, tx_path)}/{own[0]}/{own[1]}")
    out = fs.create(target, True)
    out.write(bytearray(str(newest).encode()))
    out.close()
    marks = sorted((int(x.getPath().getName()), x.getPath()) for x in fs.listStatus(target.getParent()) if x.getPath().getName().isdigit())
    for _, old in [m for m in marks if m[0] < own[1]][:-keep]:
        fs.delete(old, False)


def stored_days(spark: SparkSession, tx_path: str, first: int, last: int) -> DataFrame | None:
    """The stored transactions of the days (UTC, as the table's) from the microsecond ``first`` to ``last``; folders of other days are not even listed."""
    lo, hi = (datetime.fromtimestamp(t // 1_000_000, timezone.utc).date() for t in (first, last))
    days = [lo + timedelta(days=i) for i in range((hi - lo).days + 1)]
    paths = [f"{tx_path}/transaction_date={d.isoformat()}" for d in days]
    paths = [p for p in paths if (lambda x: x[1].exists(x[0]))(hadoop_path(spark, p))]
    if not paths:
        return None
    schema = "transaction_id string, transaction_time timestamp, transaction_date date, run string, batch_id bigint"
    return spark.read.schema(schema).option("basePath", tx_path).parquet(*paths)


def unseen_rows(batch: DataFrame, tx_path: str, watermark: str, own: tuple[str, int]) -> tuple[DataFrame, DataFrame]:
    """T11 for one micro-batch: (rows whose transaction id is neither repeated in the batch nor stored within the
    watermark, late rows). The watermark is ``watermark`` before the newest time that earlier batches stored (as in
    Spark's own, rows of one batch are not late for each other); the batch's own partitions (an earlier attempt) do not
    count. Rows without an id or a readable time are not judged here, they stay.

    The newest time comes from :func:`newest_stored`, and of the stored table only the days within the watermark are read:
    a batch costs the same however long the table has grown."""
    spark = batch.sparkSession
    batch = batch.withColumn("_event_time", as_timestamp(batch, "transaction_time"))
    judged = F.col("transaction_id").isNotNull() & F.col("_event_time").isNotNull()
    latest = newest_stored(spark, tx_path, own)
    if latest is None:
        once = batch.filter(judged).dropDuplicates(["transaction_id"])
        return once.unionByName(batch.filter(~judged)).drop("_event_time"), batch.drop("_event_time").limit(0)
    limit = latest - micros(watermark)
    since = F.timestamp_micros(F.lit(limit))
    late = F.coalesce(F.col("_event_time") < since, F.lit(False))
    once = batch.filter(~late & judged).dropDuplicates(["transaction_id"])
    recent = stored_days(spark, tx_path, limit, latest)
    if recent is not None:
        recent = recent.filter((F.col("transaction_time") >= since) & ~((F.col("run") == own[0]) & (F.col("batch_id") == own[1])))
        once = once.join(recent.select("transaction_id"), "transaction_id", "left_anti").select(*batch.columns)
    return once.unionByName(batch.filter(~late & ~judged)).drop("_event_time"), batch.filter(late).drop("_event_time")


def run_stream(messages: DataFrame, tx_path: str, alerts_path: str, checkpoint: str | None = None,
               model=None, trigger: dict | None = None, user_stats: DataFrame | None = None,
               name: str = "scoring", dedupe_watermark: str | None = None, quarantine_path: str | None = None):
    """Start the scoring query on a stream of parsed messages.

    ``trigger`` is passed to ``writeStream.trigger`` (e.g. ``{"availableNow": True}``
    or ``{"processingTime": "5 seconds"}``); default is Spark's micro-batch as soon as possible.
    ``dedupe_watermark`` enables T11 (duplicate transaction ids dropped within the watermark): each micro-batch is
    held against the transactions stored within ``dedupe_watermark`` of the newest stored one; rows older than that go to
    the quarantine as ``late``.
    ``quarantine_path`` defaults to ``<tx_path>_quarantine``.
    """
    spark = messages.sparkSession
    features = serving_features(messages, user_stats)
    checkpoint = checkpoint or stream_checkpoint(spark, name)
    quarantine = quarantine_path or tx_path.rstrip("/") + "_quarantine"
    run = run_id(spark, checkpoint)

    def process(batch: DataFrame, batch_id: int) -> None:
        if dedupe_watermark and not batch.isEmpty():
            batch, late = unseen_rows(batch, tx_path, dedupe_watermark, (run, batch_id))
            sinks.sink_quarantine(quarantine_rows(late, "late"), quarantine, (run, batch_id))
        score_batch(batch, batch_id, tx_path, alerts_path, model, run=run, quarantine_path=quarantine, high_water=bool(dedupe_watermark))

    writer = (features.writeStream.foreachBatch(process).outputMode("append")
              .option("checkpointLocation", checkpoint).queryName(name))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def stream_volume(df: DataFrame, width: str = "1 minute", watermark: str = "10 minutes",
                  ts: str = "transaction_time", id_col: str = "transaction_id") -> DataFrame:
    """Per time window, transactions and fraud transactions (ids de-duplicated first, T11)."""
    # one watermark for both stateful steps (dedupe, then the window aggregate)
    d = (df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([id_col]) if df.isStreaming
         else df.dropDuplicates([id_col]))
    return (d.groupBy(F.window(ts, width).alias("w"))
            .agg(F.count(F.lit(1)).alias("tx_count"),
                 F.count_if(F.coalesce(F.col("is_fraud"), F.lit(False))).alias("fraud_count"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "tx_count", "fraud_count"))


def stream_rapid_fraud(alerts: DataFrame, width: str = "30 minutes", slide: str = "5 minutes",
                       threshold: int = 10, watermark: str = "10 minutes",
                       ts: str = "detection_time") -> DataFrame:
    """Users with at least ``threshold`` fraud alerts in a sliding window."""
    a = alerts.filter(F.col("is_fraud"))
    return (a.withWatermark(ts, watermark)
            .groupBy(F.window(ts, width, slide).alias("w"), "user_id")
            .agg(F.count(F.lit(1)).alias("fraud_count"))
            .filter(F.col("fraud_count") >= F.lit(threshold))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "user_id", "fraud_count"))


def stream_tx_with_alerts(tx: DataFrame, alerts: DataFrame, within: str = "1 hour", tx_watermark: str = "10 minutes",
                          alert_watermark: str = "10 minutes", ts: str = "transaction_time", detected: str = "detection_time",
                          fraud_only: bool = False) -> DataFrame:
    """J1 / T7 on streams (J2 with ``fraud_only``): transactions left-joined to their alerts, with the defaults of ``dashboard.tx_with_alerts``.

    An alert is taken to be detected at most ``within`` after its transaction, and not before it; with a watermark on each side
    that bounds the state of both. A match comes out at once, a transaction without an alert exactly once, when the watermark
    of the alerts has passed the last time at which one could come. Alerts without an id match nothing. A transaction without an id
    comes out as one without an alert; one without a time is dropped, as by any watermark.
    """
    a = alerts.filter(F.col("is_fraud")) if fraud_only else alerts
    a = a.select(
        F.col("transaction_id").alias("_id"), F.col("fraud_score").alias("_fs"), F.col("is_fraud").alias("_if"), F.col("alert_status").alias("_st"),
        F.col(detected).alias("_at"))
    t = tx.withWatermark(ts, tx_watermark) if tx.isStreaming else tx
    a = a.withWatermark("_at", alert_watermark) if a.isStreaming else a
    met = (F.col("transaction_id") == F.col("_id")) & (F.col("_at") >= F.col(ts)) & (F.col("_at") <= F.col(ts) + interval(within))
    return t.join(a, met, "leftOuter").select(
        *tx.columns, F.coalesce(F.col("_fs").cast("double"), F.lit(0.0)).alias("fraud_score"), F.coalesce("_if", F.lit(False)).alias("is_fraud"),
        F.coalesce("_st", F.lit(S.NO_ALERT_STATUS)).alias("alert_status"))


def stream_fraud_rate(scored: DataFrame, width: str = "10 minutes", threshold: float = 0.15,
                      watermark: str = "10 minutes", ts: str = "transaction_time",
                      slide: str | None = "30 seconds") -> DataFrame:
    """Fraud rate per window and whether it spikes above ``threshold``. Windows slide by the interval at which the rule
    is evaluated (R2); ``slide=None`` gives windows side by side, which miss a spike over their border."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    agg = (scored.withWatermark(ts, watermark)
           .groupBy(win.alias("w"))
           .agg(F.count(F.lit(1)).alias("total_tx"),
                F.count_if(F.coalesce(F.col("is_fraud"), F.lit(False))).alias("fraud_tx")))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "total_tx", "fraud_tx",
                      (F.col("fraud_tx") / F.col("total_tx")).alias("fraud_rate"),
                      ((F.col("fraud_tx") / F.col("total_tx")) > F.lit(threshold)).alias("spike"))


def start_aggregate(df: DataFrame, sink_path: str, checkpoint: str, name: str,
                    trigger: dict | None = None, fmt: str = "parquet"):
    """Run one of T8-T10 as an append-mode query into a file sink."""
    w = (df.writeStream.outputMode("append").format(fmt).option("path", sink_path)
         .option("checkpointLocation", checkpoint).queryName(name))
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def metrics_snapshot(tx: DataFrame, alerts: DataFrame, models: DataFrame | None, path: str, as_of=None,
                     window: str = "1 hour") -> None:
    """One monitoring snapshot (A19 -> A20 -> S9); a scheduler calls it periodically."""
    from ..operators.metrics import collect_metrics, metrics_long

    sinks.sink_metrics(metrics_long(collect_metrics(tx, alerts, models, as_of, window), as_of), path)

"""Command line entry points: one Spark job per call (scheduling is left to the caller).

    python -m txrisk.cli batch-features --input history.csv --output features/
    python -m txrisk.cli stream --brokers host:9092 --topic <topic> --tables s3://.../tables
    python -m txrisk.cli alerts --tables s3://.../tables [--as-of ...]
    python -m txrisk.cli metrics --tables s3://.../tables [--window "1 hour"]
    python -m txrisk.cli registry {register,activate,list,active} --tables ... [--model-info glob] [--version v]
    python -m txrisk.cli train --features features/ --label is_fraud --kind random_forest --out models/m1 --tables ...
    python -m txrisk.cli evaluate --model models/m1 --features features/ --label is_fraud --report models/m1/report

Tables live under ``--tables``: transactions/, fraud_alerts/, quarantine/, model_performance/ (numbered
snapshots), audit_log/, monitoring_metrics/, alerts_log/ (Parquet, JSON lines for the alert log).
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schemas as S


def _spark(app: str, *inputs: str) -> SparkSession:
    """A session with partitions sized to the bytes of the job's inputs."""
    from .session import configure, configure_for_scale

    spark = SparkSession.builder.appName(app).getOrCreate()
    size = 0
    for path in inputs:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        size += fs.getContentSummary(folder).getLength() if fs.exists(folder) else 0
    # below a few partitions' worth the session's own settings are left alone
    return configure_for_scale(spark, size) if size > 8 << 30 else configure(spark)


def _table(args, name: str) -> str:
    return os.path.join(args.tables, name)


def cmd_batch_features(args) -> None:
    from .operators.features import batch_features
    from .operators.dashboard import label_distribution
    from .operators.stats import feature_summary
    from .sources.files import read_history_csv, write_features

    spark = _spark("txrisk-batch-features", args.input)
    df = read_history_csv(spark, args.input)
    feats = batch_features(df).withColumn("date", F.to_date("transaction_time"))
    write_features(feats, args.output, partition_by="date")
    if args.summary:
        stored = spark.read.parquet(args.output)
        feature_summary(stored, ["amount", "amount_log", "user_tx_count", "tx_count_1h"]).show(truncate=False)
        label_distribution(stored, "is_fraud").show()


def cmd_stream(args) -> None:
    from .operators.ml import load_model
    from .sources.kafka import parse_messages, read_kafka
    from .streaming.stream import run_stream

    spark = _spark("txrisk-stream")
    model = load_model(args.model, spark) if args.model else None
    msgs = parse_messages(read_kafka(spark, args.brokers, args.topic, args.starting))
    q = run_stream(msgs, _table(args, "transactions"), _table(args, "fraud_alerts"), args.checkpoint,
                   model=model, dedupe_watermark=args.dedupe_watermark, quarantine_path=_table(args, "quarantine"))
    q.awaitTermination()


def cmd_alerts(args) -> None:
    from .operators.alerts import alert_audit_rows, run_alert_rules
    from .operators.registry import read_registry
    from .sources.sinks import sink_alert_log, sink_audit

    spark = _spark("txrisk-alerts", _table(args, "transactions"), _table(args, "fraud_alerts"))
    tx = spark.read.parquet(_table(args, "transactions"))
    alerts = spark.read.parquet(_table(args, "fraud_alerts"))
    models = read_registry(spark, _table(args, "model_performance"))
    recs = run_alert_rules(tx, alerts, models, args.as_of).persist()
    try:
        sink_alert_log(recs, _table(args, "alerts_log"))
        sink_audit(alert_audit_rows(recs), _table(args, "audit_log"))
    finally:
        recs.unpersist()


def cmd_metrics(args) -> None:
    from .operators.registry import read_registry
    from .streaming.stream import metrics_snapshot

    spark = _spark("txrisk-metrics", _table(args, "transactions"), _table(args, "fraud_alerts"))
    tx = spark.read.parquet(_table(args, "transactions"))
    alerts = spark.read.parquet(_table(args, "fraud_alerts"))
    models = read_registry(spark, _table(args, "model_performance"))
    metrics_snapshot(tx, alerts, models, _table(args, "monitoring_metrics"), args.as_of, args.window)


def cmd_registry(args) -> None:
    from .operators import registry as G
    from .sources.sinks import sink_audit

    spark = _spark("txrisk-registry")
    path = _table(args, "model_performance")
    if args.action in ("list", "active"):
        models = G.read_registry(spark, path)
        (G.list_models(models) if args.action == "list" else G.active_model(models)).show(truncate=False)
        return
    if args.action == "register":
        infos = G.read_model_info(spark, args.model_info)
        audit = G.registration_audit(infos, args.as_of)
        G.change_registry(spark, path, lambda models: G.register_model(models, infos, args.as_of))
    else:  # activate
        changed = G.change_registry(spark, path, lambda models: G.activate_model(models, args.version))
        audit = G.activation_audit(changed, args.version, args.as_of)
    sink_audit(audit, _table(args, "audit_log"))


def cmd_train(args) -> None:
    from .operators import registry as G
    from .operators.ml import train_and_register

    spark = _spark("txrisk-train", args.features)
    df = spark.read.parquet(args.features)
    _, row = train_and_register(df, args.label, args.kind, args.out, id_col=args.id_col, as_of=args.as_of)
    if args.tables:
        path = _table(args, "model_performance")
        G.change_registry(spark, path, lambda models: models.unionByName(row))
    row.show(truncate=False)


def cmd_evaluate(args) -> None:
    from .operators.ml import binary_metrics, class_report, confusion_matrix, load_model, model_input, predict, roc_auc
    from .sources.sinks import write_report

    spark = _spark("txrisk-evaluate", args.features)
    model = load_model(args.model, spark)
    pred = predict(model_input(spark.read.parquet(args.features)), model) \
        .withColumn("_y", F.col(args.label).cast("int")).withColumn("_p", F.col("is_fraud").cast("int")).persist()
    try:
        m = binary_metrics(pred, "_y", "_p")
        auc = roc_auc(pred, "_y", "fraud_score")
        metrics = m.select("accuracy", "precision", "recall", "f1_score", auc.scalar().alias("roc_auc"))
        metrics.show(truncate=False)
        confusion_matrix(pred, "_y", "_p").show()
        class_report(pred, "_y", "_p").show()
        if args.report:
            write_report(metrics, args.report, model.version)
    finally:
        pred.unpersist()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="txrisk")
    sub = p.add_subparsers(dest="cmd", required=True)

    b = sub.add_parser("batch-features")
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--summary", action="store_true")
    b.set_defaults(fn=cmd_batch_features)

    s = sub.add_parser("stream")
    s.add_argument("--brokers", required=True)
    s.add_argument("--topic", default=S.DEFAULT_TOPIC)
    s.add_argument("--starting", default="latest")
    s.add_argument("--tables", required=True)
    s.add_argument("--checkpoint", default=None)
    s.add_argument("--model", default=None)
    s.add_argument("--dedupe-watermark", default=None)
    s.set_defaults(fn=cmd_stream)

    a = sub.add_parser("alerts")
    a.add_argument("--tables", required=True)
    a.add_argument("--as-of", default=None)
    a.set_defaults(fn=cmd_alerts)

    m = sub.add_parser("metrics")
    m.add_argument("--tables", required=True)
    m.add_argument("--as-of", default=None)
    m.add_argument("--window", default="1 hour")
    m.set_defaults(fn=cmd_metrics)

    r = sub.add_parser("registry")
    r.add_argument("action", choices=["register", "activate", "list", "active"])
    r.add_argument("--tables", required=True)
    r.add_argument("--model-info", default=None)
    r.add_argument("--version", default=None)
    r.add_argument("--as-of", default=None)
    r.set_defaults(fn=cmd_registry)

    t = sub.add_parser("train")
    t.add_argument("--features", required=True)
    t.add_argument("--label", default="is_fraud")
    t.add_argument("--kind", default="random_forest", choices=["random_forest", "gradient_boosting", "logistic"])
    t.add_argument("--out", required=True)
    t.add_argument("--id-col", default="transaction_id")
    t.add_argument("--tables", default=None)
    t.add_argument("--as-of", default=None)
    t.set_defaults(fn=cmd_train)

    e = sub.add_parser("evaluate")
    e.add_argument("--model", required=True)
    e.add_argument("--features", required=True)
    e.add_argument("--label", default="is_fraud")
    e.add_argument("--report", default=None)
    e.set_defaults(fn=cmd_evaluate)

    args = p.parse_args(argv)
    if args.cmd == "registry" and args.action == "register" and not args.model_info:
        p.error("registry register needs --model-info")
    if args.cmd == "registry" and args.action == "activate" and not args.version:
        p.error("registry activate needs --version")
    args.fn(args)


if __name__ == "__main__":
    main(sys.argv[1:])

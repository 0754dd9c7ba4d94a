"""Small inventory helpers: rounding, percentages, version names, feature selection, aggregate sinks."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from txrisk import schemas as S
from txrisk.functions.columns import model_version_name, percent, round_to
from txrisk.operators import ml as M
from txrisk.operators.features import serving_features
from txrisk.operators.quality import ensure_columns, select_features
from txrisk.operators.scoring import rule_score
from txrisk.sources.files import read_messages_stream
from txrisk.sources.kafka import parse_messages, to_messages
from txrisk.sources.tables import transactions
from txrisk.streaming.stream import start_aggregate, stream_fraud_rate


def test_format_helpers(spark):
    df = spark.createDataFrame([(0.123456, dt.datetime(2026, 2, 4, 23, 40, 7))], "r double, t timestamp")
    r = df.select(round_to(F.col("r"), 4).alias("a"), percent(F.col("r")).alias("p"),
                  model_version_name("t").alias("v")).first()
    assert r.a == 0.1235 and r.p == "12.35%" and r.v == "fraud_model_20260204_234007"


def test_preprocess_orders_features(spark, sf001):
    feats = serving_features(transactions(spark, sf001)).withColumn("label", F.col("is_fraud_actual").cast("int"))
    enc = M.fit_encoder(feats)
    out, label = M.preprocess(feats, enc, "label")
    assert out.columns == S.MODEL_FEATURES + ["label"] and label == "label"
    assert "merchant" not in out.columns and out.count() == feats.count()
    assert select_features(ensure_columns(feats, ["extra"], 0), ["extra", "amount"]).columns == ["extra", "amount"]


def test_start_aggregate_writes_closed_windows(spark, sf001):
    root = tempfile.mkdtemp(prefix="txrisk-agg-")
    tx = transactions(spark, sf001)
    to_messages(tx).select(F.col("value").cast("string").alias("value")).coalesce(1).write.text(
        os.path.join(root, "in", "p"))
    msgs = parse_messages(read_messages_stream(spark, os.path.join(root, "in", "*")))
    scored = rule_score(serving_features(msgs)).withColumn("transaction_time", F.col("transaction_timestamp"))
    q = start_aggregate(stream_fraud_rate(scored, "1 day", 0.01, slide=None, watermark="1 hour"), os.path.join(root, "out"),
                        os.path.join(root, "ck"), "rate_sink_test", trigger={"availableNow": True})
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(root, "out"))
    assert 0 < out.count() < 31 and set(out.columns) >= {"window_start", "total_tx", "spike"}


def test_daily_stats_are_dealt_by_the_rows(spark, monkeypatch):
    from txrisk.operators.dashboard import daily_transaction_stats
    from txrisk.sources import tables

    df = spark.range(60).selectExpr("timestamp_seconds(id * 3600) as transaction_time", "cast(id as double) as amount",
                                    "if(id = 5, null, cast(id % 7 as string)) as user_id", "cast(id % 3 as string) as merchant")
    want = [tuple(r) for r in daily_transaction_stats(df).collect()]
    assert want[-1] == (want[-1][0], 24, 11.5, 23.0, 0.0, 7, 3)
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 2)
    dealt = daily_transaction_stats(df, 60)
    assert "hashpartitioning(date" in (plan := dealt._jdf.queryExecution().executedPlan().toString()) and ", 60)" in plan
    assert [tuple(r) for r in dealt.collect()] == want

"""Streaming: the scoring job equals batch scoring; replays and restarts do not duplicate."""

import os
import tempfile

from pyspark.sql import functions as F

from txrisk.operators.features import serving_features
from txrisk.operators.scoring import rule_score
from txrisk.sources.files import read_messages_stream
from txrisk.sources.kafka import parse_messages, to_messages
from txrisk.sources.tables import transactions
from txrisk.streaming.stream import newest_stored, run_stream, score_batch, stored_days, stream_fraud_rate, stream_volume, unseen_rows


def _write_messages(tx, path):
    to_messages(tx).select(F.col("value").cast("string").alias("value")).coalesce(1).write.text(path)


def _scratch():
    return tempfile.mkdtemp(prefix="txrisk-stream-")


def test_stream_equals_batch_and_restart_is_idempotent(spark, sf001):
    root = _scratch()
    inp, txp, alp, ck = (os.path.join(root, p) for p in ("in", "tx", "alerts", "ck"))
    tx = transactions(spark, sf001)
    first = tx.filter(F.col("event_id") < 600)
    second = tx.filter(F.col("event_id") >= 600)
    _write_messages(first, os.path.join(inp, "part1"))

    def run():
        msgs = parse_messages(read_messages_stream(spark, os.path.join(inp, "*")))
        q = run_stream(msgs, txp, alp, ck, trigger={"availableNow": True}, name="scoring_test")
        q.awaitTermination()

    run()
    assert spark.read.parquet(txp).count() == 600
    run()                                   # restart with nothing new: no duplicates
    assert spark.read.parquet(txp).count() == 600
    _write_messages(second, os.path.join(inp, "part2"))
    run()                                   # restart with new input: only new rows
    stored = spark.read.parquet(txp)
    assert stored.count() == tx.count() == stored.select("transaction_id").distinct().count()

    batch = rule_score(tx)
    want_alerts = sorted(r.transaction_id for r in batch.filter("is_fraud").collect())
    got_alerts = sorted(r.transaction_id for r in spark.read.parquet(alp).collect())
    assert got_alerts == want_alerts
    # amounts as stored (decimal(15,2)) equal the batch amounts
    diff = stored.select("transaction_id", F.col("amount").cast("double").alias("a")).join(
        tx.select("transaction_id", F.col("amount").alias("b")), "transaction_id").filter("a != b")
    assert diff.count() == 0


def test_replayed_batch_overwrites_its_own_output(spark, sf001):
    root = _scratch()
    txp, alp = os.path.join(root, "tx"), os.path.join(root, "alerts")
    batch = serving_features(transactions(spark, sf001))
    score_batch(batch, 7, txp, alp)
    score_batch(batch, 7, txp, alp)         # same batch id again (replay after a failure)
    assert spark.read.parquet(txp).count() == batch.count()
    score_batch(batch.limit(0), 8, txp, alp)  # empty batch: no output, no error
    assert spark.read.parquet(txp).count() == batch.count()


def test_stream_windows_equal_batch_for_closed_windows(spark, sf001):
    root = _scratch()
    inp = os.path.join(root, "in")
    tx = transactions(spark, sf001)
    _write_messages(tx, os.path.join(inp, "p"))
    # duplicate a slice of the feed: the stream de-duplicates by id within the watermark
    _write_messages(tx.filter(F.col("event_id") < 50), os.path.join(inp, "dup"))
    msgs = parse_messages(read_messages_stream(spark, os.path.join(inp, "*")))
    scored = rule_score(serving_features(msgs)).withColumn("transaction_time", F.col("transaction_timestamp"))
    vol = stream_volume(scored, "1 day", watermark="1 hour")
    q = (vol.writeStream.outputMode("append").format("memory").queryName("vol_test")
         .option("checkpointLocation", os.path.join(root, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.window_start: (r.tx_count, r.fraud_count) for r in spark.table("vol_test").collect()}
    want = {r.window_start: (r.tx_count, r.fraud_count)
            for r in stream_volume(rule_score(tx), "1 day").collect()}
    assert got and len(got) < len(want)     # the last window is still open
    for k, v in got.items():
        assert want[k] == v
    rate = stream_fraud_rate(rule_score(tx), "1 day", 0.01, slide=None).collect()
    assert sum(r.total_tx for r in rate) == tx.count()


def test_stream_scored_by_model_and_malformed_messages(spark, sf001):
    from txrisk.operators import ml as M
    from txrisk.operators.quality import split_valid

    root = _scratch()
    inp = os.path.join(root, "in")
    tx = transactions(spark, sf001)
    _write_messages(tx, os.path.join(inp, "p"))
    spark.createDataFrame([("{not json",), ('{"transaction_id": "X1"}',)], "value string") \
        .coalesce(1).write.text(os.path.join(inp, "bad"))
    frame = serving_features(tx).withColumn("label", F.col("is_fraud_actual").cast("int"))
    model = M.train(frame, "label", "random_forest", numTrees=5, maxDepth=4, version="rf_stream")

    msgs = parse_messages(read_messages_stream(spark, os.path.join(inp, "*")))
    valid, quarantine = split_valid(msgs)
    q1 = (quarantine.writeStream.format("memory").queryName("quarantine_test")
          .option("checkpointLocation", os.path.join(root, "ckq")).trigger(availableNow=True).start())
    q1.awaitTermination()
    assert spark.table("quarantine_test").count() == 2          # malformed JSON and missing fields

    txp, alp = os.path.join(root, "tx"), os.path.join(root, "alerts")
    q = run_stream(valid, txp, alp, os.path.join(root, "ck"), model=model, trigger={"availableNow": True},
                   name="scoring_model_test")
    q.awaitTermination()
    assert spark.read.parquet(txp).count() == tx.count()
    want = {r.transaction_id for r in M.predict(frame, model).filter("is_fraud").collect()}
    got = {r.transaction_id for r in spark.read.parquet(alp).collect()}
    assert got == want
    assert {r.model_version for r in spark.read.parquet(alp).collect()} <= {"rf_stream"}


def test_stream_rapid_fraud_and_rate_windows(spark, sf001):
    from txrisk.sources.tables import alerts_from_scored
    from txrisk.streaming.stream import stream_rapid_fraud

    root = _scratch()
    inp = os.path.join(root, "in")
    tx = transactions(spark, sf001)
    _write_messages(tx, os.path.join(inp, "p"))
    msgs = parse_messages(read_messages_stream(spark, os.path.join(inp, "*")))
    scored = rule_score(serving_features(msgs)).withColumn("transaction_time", F.col("transaction_timestamp"))
    dense = scored.filter(F.col("fraud_score") >= 0.5).withColumn("detection_time", F.col("transaction_time"))

    rapid = stream_rapid_fraud(dense.withColumn("is_fraud", F.lit(True)), "1 day", "12 hours", 2, watermark="1 hour")
    q = (rapid.writeStream.outputMode("append").format("memory").queryName("rapid_test")
         .option("checkpointLocation", os.path.join(root, "ck1")).trigger(availableNow=True).start())
    q.awaitTermination()
    batch_dense = alerts_from_scored(rule_score(tx), 0.5).withColumn("detection_time", F.col("transaction_time"))
    want = {(r.window_start, r.user_id): r.fraud_count
            for r in stream_rapid_fraud(batch_dense, "1 day", "12 hours", 2).collect()}
    got = {(r.window_start, r.user_id): r.fraud_count for r in spark.table("rapid_test").collect()}
    assert got and all(want[k] == v for k, v in got.items())

    rate = stream_fraud_rate(scored, "1 day", 0.01, slide=None, watermark="1 hour")
    q2 = (rate.writeStream.outputMode("append").format("memory").queryName("rate_test")
          .option("checkpointLocation", os.path.join(root, "ck2")).trigger(availableNow=True).start())
    q2.awaitTermination()
    want2 = {r.window_start: (r.total_tx, r.fraud_tx, r.spike) for r in stream_fraud_rate(rule_score(tx), "1 day", 0.01, slide=None).collect()}
    got2 = {r.window_start: (r.total_tx, r.fraud_tx, r.spike) for r in spark.table("rate_test").collect()}
    assert got2 and all(want2[k] == v for k, v in got2.items())


def test_scoring_stream_drops_replayed_messages(spark, sf001):
    root = _scratch()
    inp = os.path.join(root, "in")
    tx = transactions(spark, sf001)
    _write_messages(tx, os.path.join(inp, "p"))
    _write_messages(tx.filter(F.col("event_id") < 100), os.path.join(inp, "replay"))   # the same 100 again
    msgs = parse_messages(read_messages_stream(spark, os.path.join(inp, "*")))
    txp, alp = os.path.join(root, "tx"), os.path.join(root, "alerts")
    q = run_stream(msgs, txp, alp, os.path.join(root, "ck"), trigger={"availableNow": True},
                   name="scoring_dedupe_test", dedupe_watermark="1 hour")
    q.awaitTermination()
    stored = spark.read.parquet(txp)
    assert stored.count() == tx.count() == stored.select("transaction_id").distinct().count()


def test_another_checkpoint_keeps_the_earlier_rows(spark, sf001):
    root = _scratch()
    tx = transactions(spark, sf001)
    txp, alp = os.path.join(root, "tx"), os.path.join(root, "alerts")
    for i, part in enumerate((tx.filter("event_id < 300"), tx.filter("event_id >= 300"))):
        inp = os.path.join(root, f"in{i}")
        _write_messages(part, os.path.join(inp, "p"))
        q = run_stream(parse_messages(read_messages_stream(spark, os.path.join(inp, "*"))), txp, alp, os.path.join(root, f"ck{i}"),
                       trigger={"availableNow": True}, name=f"run_{i}")
        q.awaitTermination()
    stored = spark.read.parquet(txp)
    assert stored.count() == tx.count() and stored.select("run").distinct().count() == 2


def test_malformed_and_late_messages_are_quarantined(spark, sf001):
    root = _scratch()
    inp = os.path.join(root, "in")
    tx = transactions(spark, sf001).cache()
    cut = "2024-01-20 00:00:00"
    _write_messages(tx.filter(F.col("transaction_time") >= F.lit(cut).cast("timestamp")), os.path.join(inp, "new"))
    spark.createDataFrame([("{not json",), ('{"transaction_id": "X1"}',)], "value string").coalesce(1).write.text(os.path.join(inp, "bad"))
    txp, alp, bad = (os.path.join(root, x) for x in ("tx", "alerts", "bad"))

    def run():
        q = run_stream(parse_messages(read_messages_stream(spark, os.path.join(inp, "*"))), txp, alp, os.path.join(root, "ck"),
                       trigger={"availableNow": True}, name="quarantine_run", dedupe_watermark="2 days", quarantine_path=bad)
        q.awaitTermination()

    run()
    kept = tx.filter(F.col("transaction_time") >= F.lit(cut).cast("timestamp")).count()
    assert spark.read.parquet(txp).count() == kept
    assert {(r.reason, r.detail) for r in spark.read.parquet(bad).collect()} == {
        ("invalid", "transaction_id,user_id,amount,transaction_time"), ("invalid", "user_id,amount,transaction_time")}
    _write_messages(tx, os.path.join(inp, "all"))          # the old rows are late, the recent ones repeat
    run()
    assert spark.read.parquet(txp).count() == kept
    newest = tx.agg(F.max("transaction_time")).first()[0]
    late = tx.filter(F.col("transaction_time") < F.lit(newest) - F.expr("INTERVAL 2 DAYS")).count()
    assert spark.read.parquet(bad).groupBy("reason").count().collect() and spark.read.parquet(bad).filter("reason = 'late'").count() == late


def test_a_batch_costs_the_same_however_many_came_before(spark, sf001):
    """The stored side of the duplicate check: a mark or two, and the days within the watermark, never the whole table."""
    root = _scratch()
    txp, alp = os.path.join(root, "tx"), os.path.join(root, "alerts")
    rows = serving_features(transactions(spark, sf001)).cache()
    for n in range(12):                                                # two days a batch
        part = rows.filter((F.dayofmonth("transaction_time") > 2 * n) & (F.dayofmonth("transaction_time") <= 2 * n + 2))
        fresh, late = unseen_rows(part, txp, "1 day", ("r", n))
        assert late.count() == 0
        score_batch(fresh, n, txp, alp, run="r", high_water=True)
    assert len(os.listdir(os.path.join(root, "tx_newest", "r"))) <= 8   # marks and their checksums, not one a batch
    newest = newest_stored(spark, txp, ("r", 12))
    assert newest == spark.read.parquet(txp).agg(F.unix_micros(F.max("transaction_time"))).first()[0]
    assert newest_stored(spark, txp, ("r", 11)) < newest                # a replayed batch does not see its own
    again = rows.filter(F.dayofmonth("transaction_time") == 24)
    fresh, late = unseen_rows(again, txp, "1 day", ("r", 12))
    assert fresh.count() == 0 and late.count() == 0
    read = {f for f in stored_days(spark, txp, newest - 86_400_000_000, newest).inputFiles()}
    assert read and {f.split("transaction_date=")[1].split("/")[0] for f in read} <= {"2024-01-23", "2024-01-24"}
    assert len(read) < 0.2 * len(spark.read.parquet(txp).inputFiles())
    # another run starts its batches at 0 and still knows what was stored
    old = rows.filter(F.dayofmonth("transaction_time") == 3)
    fresh, late = unseen_rows(old, txp, "1 day", ("other", 0))
    assert fresh.count() == 0 and late.count() == old.count()


def test_two_streams_joined_once_each(spark):
    from datetime import datetime, timedelta

    from txrisk.operators.dashboard import tx_with_alerts
    from txrisk.streaming.replay import replayed
    from txrisk.streaming.stream import stream_tx_with_alerts

    t0 = datetime(2024, 1, 1)
    tx = [(f"T{i}", f"U{i % 3}", 1.0, "USD", "m", t0 + timedelta(minutes=7 * i), "US", "purchase") for i in range(60)]
    tx += [tx[5], (None, "U9", 1.0, "USD", "m", t0, "US", "purchase")]
    al = [(f"T{i}", 0.9, i % 2 == 0, "pending", t0 + timedelta(minutes=7 * i, seconds=s)) for i in range(0, 60, 4) for s in ([1] if i % 8 else [1, 3600])]
    al += [("none", 0.9, True, "pending", t0)]
    cols = "transaction_id string, user_id string, amount double, currency string, merchant string, transaction_time timestamp, country string, transaction_type string"
    txs, alerts = spark.createDataFrame(tx, cols), spark.createDataFrame(al, "transaction_id string, fraud_score double, is_fraud boolean, alert_status string, detection_time timestamp")
    got = replayed([txs, alerts], stream_tx_with_alerts, ["transaction_time", "detection_time"], ["2024-01-01 02:00:00", "2024-01-01 05:00:00"])
    want = tx_with_alerts(txs, alerts)
    key = lambda df: sorted((tuple(r) for r in df.select(*want.columns).collect()), key=str)
    assert key(got) == key(want) and len(want.filter("alert_status = 'n/a'").collect()) > 40

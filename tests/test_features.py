"""Window features: prefix differences equal plain RANGE-frame windows."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txrisk.operators import features as FE
from txrisk.operators.features import batch_features, merchant_stats, user_window_features, with_group_stats
from txrisk.operators.ranking import distributed_percent_rank, distributed_rank
from txrisk.sources.tables import transactions

from conftest import rows


def plain_user_windows(df):
    """Reference implementation with interval RANGE frames over one partition per user."""
    lb = "range between interval 7 days preceding and current row"
    vel = "range between interval 1 hour preceding and current row"
    spec = "partition by user_id order by transaction_time"
    out = df.select(
        "transaction_id",
        F.expr("count(*) over (partition by user_id)").alias("user_tx_count"),
        F.expr(f"count(*) over ({spec} {lb})").alias("user_tx_count_7d"),
        F.expr(f"avg(amount) over ({spec} {lb})").alias("user_avg_amount_7d"),
        F.expr(f"count(*) over ({spec} {vel})").alias("tx_count_1h"),
        F.expr(f"sum(amount) over ({spec} {vel})").alias("total_amount_1h"),
        F.lag("transaction_time").over(Window.partitionBy("user_id").orderBy("transaction_time", "transaction_id"))
        .alias("prev_transaction_time"),
    )
    return out


COLS = ["transaction_id", "user_tx_count", "user_tx_count_7d", "user_avg_amount_7d", "tx_count_1h",
        "total_amount_1h", "prev_transaction_time"]


def _hot_fixture(spark):
    """One user holds most rows, with equal timestamps and rows exactly 7 days / 1 hour back."""
    base = dt.datetime(2024, 1, 1)
    data = []
    for i in range(300):
        t = base + dt.timedelta(minutes=37 * i)
        data.append((f"H{i:04d}", "HOT", float(i % 50) + 0.25, t))
    data += [("E1", "HOT", 10.0, base + dt.timedelta(minutes=37 * 10)),        # tie with H0010
             ("E2", "HOT", 20.0, base + dt.timedelta(minutes=37 * 10)),        # tie, id order
             ("W7", "HOT", 5.0, base + dt.timedelta(minutes=37 * 10) + dt.timedelta(days=7)),   # exactly 7 d later
             ("V1", "HOT", 6.0, base + dt.timedelta(minutes=37 * 10) + dt.timedelta(hours=1)),  # exactly 1 h later
             ("C1", "COLD", 100.0, base), ("C2", "COLD", 100.0, base + dt.timedelta(days=40))]
    return spark.createDataFrame(data, "transaction_id string, user_id string, amount double, transaction_time timestamp")


@pytest.mark.parametrize("n_buckets", [None, 1, 3, 64])
def test_windows_equal_plain_on_hot_user(spark, n_buckets):
    df = _hot_fixture(spark)
    got = user_window_features(df, n_buckets=n_buckets).select(*COLS)
    assert rows(got) == rows(plain_user_windows(df).select(*COLS))


def test_windows_equal_plain_on_data(spark, sf001):
    df = transactions(spark, sf001)
    assert rows(user_window_features(df).select(*COLS)) == rows(plain_user_windows(df).select(*COLS))


def test_null_and_repeated_keys_times_and_ids(spark):
    t = dt.datetime(2024, 1, 2)
    df = _hot_fixture(spark).unionByName(spark.createDataFrame(
        [("N1", "HOT", 7.0, None), ("N2", "HOT", 8.0, None), ("N3", "COLD", 9.0, None), ("N4", "", 9.0, None),
         ("U1", None, 1.0, t), ("U2", None, 2.0, dt.datetime(2024, 1, 2, 0, 30)), ("U3", None, 3.0, None),
         ("R", "REP", 1.0, t), ("R", "REP", 1.0, t), ("R", "REP", 1.0, t + dt.timedelta(hours=2)), (None, "REP", 4.0, t),
         (None, "REP", 4.0, t), ("A", "NUL", None, t), ("B", "NUL", None, t), ("B9", "REP", 0.0041, t + dt.timedelta(minutes=5))],
        "transaction_id string, user_id string, amount double, transaction_time timestamp"))
    got = user_window_features(df).select(*COLS)
    assert got.count() == df.count()
    assert rows(got) == rows(plain_user_windows(df).select(*COLS))


def test_numeric_ids_and_users_keep_their_order(spark):
    t = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(10, 1, 1.0, t), (9, 1, 2.0, t), (100, 1, 3.0, t), (3, None, 1.0, t), (4, 0, 1.0, t - dt.timedelta(days=1)), (11, 1, 1.0, t - dt.timedelta(days=1))],
                               "transaction_id long, user_id int, amount double, transaction_time timestamp")
    assert rows(user_window_features(df).select(*COLS)) == rows(plain_user_windows(df).select(*COLS))


def test_averages_keep_fractions_of_a_cent(spark):
    t = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([("a", "u", 0.004, t, "m"), ("b", "u", 0.004, t, "m")],
                               "transaction_id string, user_id string, amount double, transaction_time timestamp, merchant string")
    assert {r.user_avg_amount for r in user_window_features(df).collect()} == {0.004}
    assert {r.merchant_avg_amount for r in merchant_stats(df).collect()} == {0.004}


def test_no_frame_is_gathered(spark):
    text = user_window_features(_hot_fixture(spark))._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, -" not in text


def test_first_transaction_gets_24_hours(spark):
    df = _hot_fixture(spark)
    out = {r.transaction_id: r for r in user_window_features(df).collect()}
    assert out["C1"].hours_since_last_tx == 24.0 and out["C1"].prev_transaction_time is None
    assert out["C2"].hours_since_last_tx == 40 * 24.0       # carried across many empty buckets
    assert out["E2"].hours_since_last_tx == 0.0             # tie with E1 (id order)


def test_group_stats_equal_window_form(spark, sf001):
    df = transactions(spark, sf001)
    got = merchant_stats(df).select("transaction_id", "merchant_tx_count")
    want = df.select("transaction_id", F.count("*").over(Window.partitionBy("merchant")).alias("merchant_tx_count"))
    assert rows(got) == rows(want)
    nulls = df.withColumn("merchant", F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("merchant")))
    got_n = merchant_stats(nulls).select("transaction_id", "merchant_tx_count")
    want_n = nulls.select("transaction_id",
                          F.count("*").over(Window.partitionBy("merchant")).alias("merchant_tx_count"))
    assert rows(got_n) == rows(want_n)
    g2 = with_group_stats(df, ["user_id"], {"n": F.count(F.lit(1))}).select("transaction_id", "n")
    w2 = df.select("transaction_id", F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    assert rows(g2) == rows(w2)


def test_distributed_percent_rank_equals_plain(spark, sf001):
    df = transactions(spark, sf001)
    # ties and NULLs: round amounts and blank some of them
    df = df.withColumn("amount", F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.round("amount", -2)))
    got = distributed_percent_rank(df, "amount", "pr", n_buckets=5).select("transaction_id", "pr")
    want = df.select("transaction_id", F.percent_rank().over(Window.orderBy("amount")).alias("pr"))
    assert rows(got) == rows(want)


def test_distributed_rank_on_strings_with_partitions(spark, sf001):
    df = transactions(spark, sf001)
    df = df.withColumn("country", F.when(F.col("event_id") % 9 == 0, F.lit(None)).otherwise(F.col("country")))
    got = distributed_rank(df, "merchant", ["country"], rank_col="r", n_buckets=4).select("transaction_id", "r")
    want = df.select("transaction_id", F.rank().over(Window.partitionBy("country").orderBy("merchant")).alias("r"))
    assert rows(got) == rows(want)


def test_batch_features_columns(spark, sf001):
    out = batch_features(transactions(spark, sf001).withColumn("is_fraud", F.lit(0)))
    expected = {"hour", "day_of_week", "day_of_month", "month", "is_night", "is_weekend", "is_business_hours",
                "amount_log", "is_high_amount", "is_micro_transaction", "amount_percentile", "user_tx_count",
                "user_tx_count_7d", "user_avg_amount", "user_avg_amount_7d", "amount_deviation_from_avg",
                "prev_transaction_time", "hours_since_last_tx", "is_unknown_merchant", "merchant_tx_count",
                "merchant_avg_amount", "is_high_risk_country", "is_domestic", "tx_count_1h", "total_amount_1h",
                "is_high_velocity", "fraud_score_rule"}
    assert expected.issubset(out.columns)
    assert out.count() == transactions(spark, sf001).count()


def test_users_of_many_rows_are_cut_into_ranges(spark, monkeypatch):
    rows = [(f"T{i % 70}", [None, "U1", "U1", "U2"][i % 4], None if i % 31 == 0 else f"2024-01-{1 + i * 7 % 25:02d} 00:{i % 3:02d}:00", [None, 1.25, 3.0][i % 3])
            for i in range(200)] + [("A", "U3", "2024-01-02 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "transaction_id string, user_id string, at string, amount double").selectExpr(
        "transaction_id", "user_id", "cast(at as timestamp) as transaction_time", "amount")
    once = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    want = once(FE.user_window_features(df))
    monkeypatch.setattr(FE, "HOT_ROWS", 60)                 # U1 only
    assert FE._hot(df, "user_id") is not None
    assert once(FE.user_window_features(df)) == want
    monkeypatch.setattr(FE, "HOT_ROWS", 0)                  # everyone
    assert once(FE.user_window_features(df)) == want


def test_user_windows_take_one_shuffle_and_no_join(spark):
    df = spark.range(50).selectExpr("cast(id as string) as transaction_id", "if(id > 3, cast(id % 3 as string), null) as user_id",
                                    "timestamp_seconds(id) as transaction_time", "cast(id as double) as amount")
    plan = FE.user_window_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_user_windows_take_one_sort_and_one_window_pass(spark):
    plan = FE.user_window_features(_hot_fixture(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 1
    assert "decimal" not in plan             # whole cents


def test_many_ranges_are_worked_out_after_the_aggregation(spark):
    df = spark.range(2000).selectExpr("cast(if(id % 9 = 0, null, id % 1500) as double) as amount")
    out = distributed_percent_rank(df, "amount", "pr", n_buckets=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan              # of the range ids of all rows
    assert rows(out) == rows(df.select("amount", F.percent_rank().over(Window.orderBy("amount")).alias("pr")))


@pytest.mark.parametrize("odd, cents", [(None, True), (-0.0, True), (0.004, False), (float("nan"), False), (float("inf"), False), (-1e29, False),
                                        (1e14, False), (4e12, True), (123456789.125, False)])
def test_cents_and_decimals_give_the_same_sums(spark, monkeypatch, odd, cents):
    t = dt.datetime(2024, 1, 2)
    data = [(f"T{i}", [None, "A", "B"][i % 3], [None, 0.1, 0.2, 0.29, 1.15, -4.35, 1e6 + 0.07][i % 7], t + dt.timedelta(minutes=13 * i)) for i in range(120)]
    df = spark.createDataFrame([*data, ("X", "A", odd, t + dt.timedelta(minutes=200))],
                               "transaction_id string, user_id string, amount double, transaction_time timestamp")
    assert FE._measured(df, "user_id", "amount") == (41, cents)
    once = lambda frame: sorted(map(str, frame.collect()))
    got, cut = once(FE.user_window_features(df)), once(FE.user_window_features(df, n_buckets=3))
    monkeypatch.setattr(FE, "_measured", lambda *_: (0, False))
    assert got == cut == once(FE.user_window_features(df))

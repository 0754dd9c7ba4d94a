"""Keyed state on streams: replays with restarts equal the batch operators and brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators.features import user_window_features
from txrisk.streaming import keyed
from txrisk.streaming.replay import replayed

T0 = datetime(2024, 1, 1)


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def transactions(n=160, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = rnd.choice(["U1", "U1", "U2", "U3", None])
        at = T0 + timedelta(minutes=rnd.choice([rnd.randrange(60 * 24 * 20), 30 * rnd.randrange(200)]), microseconds=rnd.choice([0, 0, 1, 999_999]))
        rows.append((f"T{i % 150}", user, at, rnd.choice([None, 0.1, 12.34, 1e9, -5.0]), rnd.choice([None, "x"])))
    # exactly a look-back apart, and several at one time
    rows += [(f"E{i}", "U4", T0 + timedelta(days=7 * i), 1.1, None) for i in range(3)]
    rows += [(f"H{i}", "U5", T0 + timedelta(hours=i), 2.2, None) for i in range(4)]
    rows += [(f"S{i}", "U6", T0, 0.3, "y") for i in range(8)]
    rnd.shuffle(rows)
    return rows


SCHEMA = "transaction_id string, user_id string, transaction_time timestamp, amount double, note string"
FEATURES = ["user_tx_count_7d", "user_avg_amount_7d", "prev_transaction_time", "hours_since_last_tx", "tx_count_1h", "total_amount_1h", "is_high_velocity"]


@pytest.mark.parametrize("cuts", [[], ["2024-01-04 00:00:00", "2024-01-12 12:00:00"]])
def test_user_windows_on_a_stream_equal_the_batch_operator(spark, cuts):
    df = spark.createDataFrame(transactions(), SCHEMA)
    got = replayed(df, keyed.stream_user_windows, "transaction_time", cuts)
    cols = df.columns + FEATURES
    assert rows_of(got, cols) == rows_of(user_window_features(df), cols)


def test_rows_in_any_order_within_the_watermark(spark):
    df = spark.createDataFrame(transactions(60, 4), SCHEMA)
    # the second slice holds earlier rows than the first: the watermark is wide enough for both
    late = df.withColumn("transaction_time", F.col("transaction_time"))
    order = late.filter("user_id = 'U1'").unionByName(late.filter("user_id is null or user_id <> 'U1'"))
    got = replayed(order, lambda s: keyed.stream_user_windows(s, watermark="30 days"), "transaction_time", ["2024-01-10 00:00:00"])
    cols = ["transaction_id", "user_id", *FEATURES]
    assert rows_of(got, cols) == rows_of(user_window_features(df), cols)


def test_state_of_a_silent_user_is_removed(spark):
    class Spy(keyed.UserWindows):
        def end(self, now):
            last = super().end(now)
            self.held = len(self.sums)
            return last

    p = Spy(None, [*"abcdefg"], 10, 5, 2, 5, 24.0, 10)
    stores = {}

    class Map(dict):
        def getValue(self, k): return self.get(k)
        def updateValue(self, k, v): self[k] = v
        def removeKey(self, k): self.pop(k, None)
        def keys(self): return iter(list(super().keys()))
        def iterator(self): return iter(list(self.items()))

    class Value:
        v = None
        def get(self): return self.v
        def update(self, v): self.v = v
        def clear(self): self.v = None

    class Handle:
        timers = []
        def getMapState(self, name, *a): return stores.setdefault(name, Map())
        def getValueState(self, name, *a): return stores.setdefault(name, Value())
        def registerTimer(self, t): self.timers.append(t)

    class Now:
        def __init__(self, ms): self.ms = ms
        def getCurrentWatermarkInMs(self): return self.ms

    p.row = T.StructType([])
    p.init(Handle())
    stores["waiting"][(995,)] = ([(None, "a"), (None, "b")],)
    assert len(list(p.handleExpiredTimer(("u",), Now(1), None))) == 2 and p.held == 1
    assert list(p.handleExpiredTimer(("u",), Now(1000), None)) == []
    assert not stores["totals"] and not stores["entries"] and stores["newest"].get() == (995,)


def alerts(seed=2):
    rnd = random.Random(seed)
    rows = [("U1", T0 + timedelta(hours=10, minutes=2 + i), True) for i in range(9)] + [("U1", T0 + timedelta(hours=10, minutes=31), True)]
    rows += [("U2", T0 + timedelta(hours=10, minutes=3 * i), True) for i in range(40)]                    # ten within 27 minutes
    rows += [("U3", T0 + timedelta(hours=10, minutes=4 * i), True) for i in range(40)]                    # never ten in 30
    rows += [("U4", T0 + timedelta(hours=9), True)] * 10 + [("U4", T0 + timedelta(hours=9, minutes=30, microseconds=1), True)] * 9
    rows += [("U5", T0 + timedelta(minutes=rnd.randrange(400)), rnd.random() < 0.9) for _ in range(150)]
    rows += [("U6", None, True)] * 12
    rnd.shuffle(rows)
    return rows


def burst_brute_force(rows, span=timedelta(minutes=30), threshold=10):
    by_user = {}
    for u, t, fraud in rows:
        if fraud and t is not None:
            by_user.setdefault(u, []).append(t)
    for u, times in by_user.items():
        was = None
        for t in sorted(set(times)):
            n = sum(t - span <= x <= t for x in times)
            if n >= threshold:
                yield (u, t - span, t, n, was is None or was < t - span)
            was = t if n >= threshold else None


def test_bursts_at_every_event(spark):
    rows = alerts()
    df = spark.createDataFrame(rows, "user_id string, detection_time timestamp, is_fraud boolean")
    got = replayed(df, keyed.stream_bursts, "detection_time", ["2024-01-01 09:15:00", "2024-01-01 10:20:00"])
    got = rows_of(got, ["user_id", "window_start", "window_end", "fraud_count", "starts"])
    assert got == sorted(burst_brute_force(rows), key=str)
    # ten frauds within 29 minutes that no five-minute grid of half hours holds
    assert ("U1", T0 + timedelta(hours=10, minutes=1), T0 + timedelta(hours=10, minutes=31), 10, True) in got


def test_alive_alerts_at_every_watermark(spark):
    rnd = random.Random(3)
    rows = [(f"T{i % 40}", T0 + timedelta(minutes=rnd.randrange(600))) for i in range(60)]
    df = spark.createDataFrame(rows, "transaction_id string, detection_time timestamp")
    out = replayed(df, keyed.stream_alert_expiry, "detection_time", ["2024-01-01 03:00:00", "2024-01-01 06:00:00"])
    events = [tuple(r) for r in out.select("transaction_id", "event", "at", "expires_at").collect()]
    assert sorted(e[0] for e in events if e[1] == "set") == sorted(r[0] for r in rows)
    hour = timedelta(hours=1)
    for m in range(0, 700, 7):
        w = T0 + timedelta(minutes=m)
        want = {k for k, t in rows if t <= w < t + hour}
        alive = {}
        for k, event, at, expires in sorted(events, key=lambda e: (e[2], e[1] == "set")):
            if at <= w:
                alive[k] = expires if event == "set" else None
        assert {k for k, e in alive.items() if e is not None and e > w} == want
    assert {e[0] for e in events if e[1] == "expired"} == {r[0] for r in rows}


class Counted:
    """State of one key in memory that counts how often it is asked."""

    def __init__(self):
        self.stores, self.calls = {}, 0

    def _state(self, name):
        outer = self

        class State:
            def __init__(self):
                self.map, self.value = {}, None

            def __getattribute__(self, what):
                if what not in ("map", "value"):
                    outer.calls += 1
                return object.__getattribute__(self, what)

            def getValue(self, k): return self.map.get(k)
            def updateValue(self, k, v): self.map[k] = v
            def removeKey(self, k): self.map.pop(k, None)
            def keys(self): return iter(list(self.map))
            def iterator(self): return iter(list(self.map.items()))
            def get(self): return self.value
            def update(self, v): self.value = v
            def clear(self): self.value = None

        return self.stores.setdefault(name, State())

    def getMapState(self, name, *a): return self._state(name)
    def getValueState(self, name, *a): return self._state(name)
    def registerTimer(self, t): self.calls += 1


class At:
    def __init__(self, ms): self.ms = ms
    def getCurrentWatermarkInMs(self): return self.ms


def _user_rows(few, monkeypatch):
    monkeypatch.setattr(keyed, "FEW", few)
    hour = 3_600_000_000
    row = T.StructType.fromDDL("_amount double, _id string, _c0 string")
    p, state, out = keyed.UserWindows(row, [*"abcdefgh"], 24 * hour, 3 * hour, hour, 5, 24.0, 10), Counted(), []
    p.init(state)
    for start in range(0, 400, 100):
        times = [(start + i) * hour // 3 for i in range(100)]
        rows = [{"_t": t, "_amount": keyed.Decimal(t % 7), "_id": str(t), "_c0": str(t)} for t in reversed(times)]
        list(p.handleInputRows(("u",), iter(rows), None))
        out += p.handleExpiredTimer(("u",), At(times[-1] // 1000), None)
    return [tuple(r) for r in out], state.calls


def test_state_of_a_user_is_read_by_the_batch(monkeypatch):
    rows, calls = _user_rows(1000, monkeypatch)
    assert len(rows) == 400 and calls < 60
    assert _user_rows(20, monkeypatch)[0] == rows        # in buckets from the first batch on
    day = [int(r[0]) for r in rows]
    assert [r[1] for r in rows] == [sum(t - 24 * 3_600_000_000 <= x <= t for x in day) for t in day]


def test_expiry_state_is_read_by_the_batch():
    p, state = keyed.Expiry([*"abcd"], T.StringType()), Counted()
    p.init(state)
    rows = [{"_key": f"T{i}", "_t": i * 1000, "expires": 10_000_000 + i * 1000} for i in range(200)]
    assert len(list(p.handleInputRows((0,), iter(rows), None))) == 200
    assert len(list(p.handleExpiredTimer((0,), At(10_099), None))) == 100 and len(list(p.handleExpiredTimer((0,), At(20_000), None))) == 100
    assert state.calls < 20

"""Keyed state machines on streams (W3-W6, W9, W10, F15 at serving time, T9/R3 at every event, T6 with expiry).

All three run on ``transformWithState`` with event-time timers and take rows in any order: a row waits in the state of its
key until the watermark passes its time, so no earlier row can come any more, and is then worked off in the
order of time. A replay or a restart gives the same rows. Rows that come after the watermark are dropped by Spark, as in its own
windows (``run_stream`` sends them to the quarantine first).

State is bounded by the look-back: what is older than the longest one is removed when the key is next worked off, or by
a timer where the key stays silent. Amounts are summed as exact decimals, so the results are those of the batch operators.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from decimal import Context, Decimal
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..functions.columns import as_timestamp, exact, interval
from ..operators.features import micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_WIDE = Context(prec=76)
_TIME = "_t"
PIECE = 1000       # waiting rows of a state value
FEW = 1000         # distinct times of a user that are kept as one state value
_TIMES = (T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.StructType, T.MapType, T.BinaryType)


def with_rocksdb(start):
    """Call ``start(spark)`` with the state store that ``transformWithState`` needs; the session's setting is put back."""

    def run(spark):
        before = spark.conf.get(_PROVIDER, None)
        spark.conf.set(_PROVIDER, ROCKSDB)
        try:
            return start(spark)
        finally:
            spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)

    return run


def _add(a: Decimal, b: Decimal) -> Decimal:
    return _WIDE.add(a, b)


class InOrder(StatefulProcessor):
    """Rows of a key wait for the watermark and are worked off by time: ``work(time, rows)`` for each distinct time.

    What one batch brings a key is written as a few pieces of up to ``PIECE`` rows: (rows, microseconds after the
    time that the piece is kept by), so that state is read and written by the batch and not by the row."""

    def __init__(self, row: T.StructType, names: list[str], keep: int):
        self.row, self.made, self.keep = row, Row(*names), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        key = T.StructType([T.StructField("t", T.LongType())])
        self.waiting = handle.getMapState("waiting", key, T.StructType(
            [T.StructField("rows", T.ArrayType(self.row)), T.StructField("after", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = [f.name for f in self.row.fields]
        came = sorted(((r[_TIME], tuple(r[n] for n in names)) for r in rows), key=lambda r: r[0])
        if came:
            self._wait(came)
            self._timer(came[0][0])
        return iter(())

    def _piece(self, t: int, value) -> list[tuple]:
        """(time, row) of a stored piece; rows without a distance are at its time."""
        rows, after = (*value, None)[:2]
        return [(t + d, tuple(r)) for r, d in zip(rows, after or [0] * len(rows), strict=True)]

    def _wait(self, rows: list[tuple]) -> None:
        """Write (time, row) in the order of time; rows of one time stay together."""
        start = 0
        for end in range(1, len(rows) + 1):
            if end == len(rows) or (end - start >= PIECE and rows[end][0] != rows[end - 1][0]):
                t = rows[start][0]
                had = self.waiting.getValue((t,))
                piece = sorted([*(self._piece(t, had) if had else []), *rows[start:end]], key=lambda r: r[0])
                self.waiting.updateValue((t,), ([r for _, r in piece], [x - t for x, _ in piece]))
                start = end

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        kept = sorted(t for (t,) in self.waiting.keys())
        later = [t for t in kept if t > now]
        rows = []
        for t in kept[: len(kept) - len(later)]:
            rows += self._piece(t, self.waiting.getValue((t,)))
            self.waiting.removeKey((t,))
        rows.sort(key=lambda r: r[0])
        rest = [r for r in rows if r[0] > now]
        due = rows[: len(rows) - len(rest)]
        if rest:
            self._wait(rest)
            later.append(rest[0][0])
        self.begin(due[0][0] if due else now)
        for t, same in groupby(due, key=lambda r: r[0]):
            yield from self.work(key, t, [r for _, r in same])
        last = self.end(now)
        if later:
            self._timer(min(later))
        elif last is not None:
            self._timer(last + self.keep + 1)        # nothing waits: look again when all that is kept has grown old

    def _timer(self, t: int) -> None:
        self.handle.registerTimer(-(-t // 1000))

    def begin(self, first: int) -> None:
        """Read the state that the rows due need."""

    def work(self, key, t: int, rows) -> Iterator[Row]:
        raise NotImplementedError

    def end(self, now: int) -> int | None:
        """Write the state back without what is too old; the newest time it still holds, or None."""

    def close(self) -> None:
        pass


class Window:
    """Rows, sum and amounts of the times of a look-back, moved on by what leaves it: whole buckets by their totals, the bucket
    that the look-back's start cuts by its entries."""

    def __init__(self, held: UserWindows, since: int):
        self.held, self.at, self.gone = held, 0, 0           # buckets passed, entries passed of the next
        self.n, self.s, self.na = 0, Decimal(0), 0
        first = since // held.bucket
        while self.at < len(held.order) and held.order[self.at] < first:
            self.at += 1
        for b in held.order[self.at:]:
            self.add(held.sums[b])
        self.move(since)

    def add(self, entry) -> None:
        self.n, self.s, self.na = self.n + entry[0], _add(self.s, entry[1]), self.na + entry[2]

    def _drop(self, entry) -> None:
        self.n, self.s, self.na = self.n - entry[0], _WIDE.subtract(self.s, entry[1]), self.na - entry[2]

    def move(self, since: int) -> None:
        """Without the times before ``since``."""
        order, cut = self.held.order, since // self.held.bucket
        while self.at < len(order) and order[self.at] <= cut:
            b = order[self.at]
            if b < cut and not self.gone:
                self._drop(self.held.sums[b])
            else:
                entries = self.held.entries_of(b)
                while self.gone < len(entries) and entries[self.gone][0] < since:
                    self._drop(entries[self.gone][1:])
                    self.gone += 1
                if b == cut:
                    return
            self.at, self.gone = self.at + 1, 0


class UserWindows(InOrder):
    """Look-back counts and sums of a user.

    Distinct times of the last look-back are kept in buckets of ``bucket`` microseconds: (time, rows, sum, amounts) lists and
    their totals, each in a state of its own. A user of at most ``FEW`` distinct times has them all in one value instead.
    """

    def __init__(self, row, names, lookback: int, velocity: int, bucket: int, max_count: int, default_hours: float, scale: int):
        super().__init__(row, names, max(lookback, velocity))
        self.lookback, self.velocity, self.bucket = lookback, velocity, bucket
        self.max_count, self.default_hours, self.scale = max_count, default_hours, scale

    def init(self, handle):
        super().init(handle)
        money = T.DecimalType(38, self.scale)
        key = T.StructType([T.StructField("b", T.LongType())])
        total = [("n", T.LongType()), ("s", money), ("na", T.LongType())]
        lists = T.StructType([T.StructField(a, T.ArrayType(b)) for a, b in [("t", T.LongType()), *total]])
        self.totals = handle.getMapState("totals", key, T.StructType([T.StructField(a, b) for a, b in total]))
        self.entries = handle.getMapState("entries", key, lists)
        self.few = handle.getValueState("few", lists)
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("t", T.LongType())]))

    def begin(self, first):
        known = self.newest.get()
        self.last = known[0] if known else None
        few = self.few.get() if known else None
        self.sums, self.lists, self.changed = {}, {}, set()
        self.apart = bool(known) and few is None             # in buckets
        if few:
            for e in zip(*few, strict=True):
                self._enter(e)
        elif known:
            self.sums = {b[0]: tuple(v) for b, v in sorted(self.totals.iterator())}
        self.order, self.windows = list(self.sums), None

    def entries_of(self, b):
        if b not in self.lists:
            v = self.entries.getValue((b,)) if b in self.sums else None
            self.lists[b] = [tuple(x) for x in zip(*v, strict=True)] if v else []
        return self.lists[b]

    def _enter(self, entry):
        """Add (time, rows, sum, amounts) to its bucket."""
        b = entry[0] // self.bucket
        self.entries_of(b).append(tuple(entry))
        had = self.sums.get(b, (0, Decimal(0), 0))
        self.sums[b] = (had[0] + entry[1], _add(had[1], entry[2]), had[2] + entry[3])
        self.changed.add(b)
        return b

    def work(self, key, t, rows):
        amounts = [r[0] for r in rows if r[0] is not None]
        s = Decimal(0)
        for a in amounts:
            s = _add(s, a)
        if self.windows is None:
            self.windows = [Window(self, t - self.lookback), Window(self, t - self.velocity)]
        b = self._enter((t, len(rows), s, len(amounts)))
        if not self.order or self.order[-1] != b:
            self.order.append(b)
        for w, length in zip(self.windows, (self.lookback, self.velocity), strict=True):
            w.add((len(rows), s, len(amounts)))
            w.move(t - length)
        (n, total, na), (vn, vtotal, vna) = ((w.n, w.s, w.na) for w in self.windows)
        # the first row by id follows the user's previous time, the others this one
        order = sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else ""))
        for i, r in enumerate(order):
            prev = self.last if i == 0 else t
            hours = self.default_hours if prev is None else (t // 1_000_000 - prev // 1_000_000) / 3600.0
            yield self.made(*r[2:], n, float(total) / na if na else None, None if prev is None else str(prev), hours, vn, float(vtotal) if vna else None, int(vn > self.max_count))
        self.last = t

    def end(self, now):
        oldest = (max(now, self.last or now) - self.keep) // self.bucket
        for b in [b for b in self.sums if b < oldest]:
            if self.apart:
                self.totals.removeKey((b,))
                self.entries.removeKey((b,))
            del self.sums[b]
            self.lists.pop(b, None)
            self.changed.discard(b)
        if not self.apart and sum(len(x) for x in self.lists.values()) <= FEW:
            if self.sums:
                self.few.update(tuple(list(c) for c in zip(*(e for b in self.sums for e in self.lists[b]), strict=True)))
            elif self.last is not None:
                self.few.update(([], [], [], []))
        else:
            if not self.apart:
                self.few.clear()
            for b in self.changed:
                self.totals.updateValue((b,), self.sums[b])
                self.entries.updateValue((b,), tuple(list(c) for c in zip(*self.lists[b], strict=True)))
        if self.last is not None:
            self.newest.update((self.last,))
        return max(self.sums) * self.bucket + self.bucket if self.sums else None


class Bursts(InOrder):
    """The moments at which a key has at least ``threshold`` rows within the span that ends there."""

    def __init__(self, row, names, span: int, threshold: int):
        super().__init__(row, names, span)
        self.span, self.threshold = span, threshold

    def init(self, handle):
        super().init(handle)
        self.recent = handle.getValueState("recent", T.StructType(
            [T.StructField("t", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.LongType()))]))

    def begin(self, first):
        had = self.recent.get()
        self.times = deque(zip(*had, strict=True)) if had else deque()
        self.count = sum(n for _, n in self.times)

    def work(self, key, t, rows):
        was = bool(self.times) and self.count >= self.threshold
        while self.times and self.times[0][0] < t - self.span:
            self.count -= self.times.popleft()[1]
        held = bool(self.times)
        self.times.append((t, len(rows)))
        self.count += len(rows)
        if self.count >= self.threshold:
            yield self.made(*key, t, self.count, not (was and held))

    def end(self, now):
        newest = self.times[-1][0] if self.times else None
        if newest is None or newest < now - self.span:
            self.recent.clear()
            return None
        self.recent.update(([a for a, _ in self.times], [n for _, n in self.times]))
        return newest


class Expiry(StatefulProcessor):
    """A key lives until its newest expiry time; tells when it is set and when it goes. Keys are grouped by hash: the living ones of a
    group are one value, so that state is read and written by the batch and not by the key."""

    def __init__(self, names: list[str], key: T.DataType):
        self.made, self.key = Row(*names), key

    def init(self, handle):
        self.handle = handle
        self.living = handle.getValueState("living", T.StructType(
            [T.StructField("key", T.ArrayType(self.key)), T.StructField("until", T.ArrayType(T.LongType()))]))

    def _read(self) -> dict:
        had = self.living.get()
        return dict(zip(*had, strict=True)) if had else {}

    def _write(self, living: dict) -> None:
        if living:
            self.living.update((list(living), list(living.values())))
            self.handle.registerTimer(-(-min(living.values()) // 1000))
        else:
            self.living.clear()

    def handleInputRows(self, key, rows, timerValues):
        living = self._read()
        for r in sorted(rows, key=lambda r: r[_TIME]):
            k, end = r["_key"], r["expires"]
            yield self.made(k, "set", r[_TIME], end)
            living[k] = max(end, living.get(k, end))
        self._write(living)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        living = self._read()
        over = {k: t for k, t in living.items() if t <= now}
        if over:
            for k, t in over.items():
                yield self.made(k, "expired", t, t)
            self._write({k: t for k, t in living.items() if t > now})

    def close(self):
        pass


def _run(df: DataFrame, key: list[str], ts: str, watermark: str, processor, out: T.StructType) -> DataFrame:
    timed = df.withWatermark(ts, watermark)
    return timed.groupBy(*key).transformWithState(processor, out, "Append", "EventTime")


def _carried(df: DataFrame, ts: str) -> tuple[DataFrame, list[str]]:
    """``df`` with copies ``_c<i>`` of its columns to be kept as state, and the time ``ts`` as a timestamp and in microseconds.
    Plain values are kept as text and times as microseconds: Python rows would turn a null into a not-a-number."""
    copies = {}
    for i, f in enumerate(df.schema.fields):
        c = F.unix_micros(F.col(f.name).cast("timestamp")) if isinstance(f.dataType, _TIMES) else F.col(f.name)
        copies[f"_c{i}"] = c if isinstance(f.dataType, _NESTED) else c.cast("string")
    return df.withColumns(copies).withColumn(_TIME, F.unix_micros(as_timestamp(df, ts))).withColumn("_ts", as_timestamp(df, ts)), df.columns


def _restored(df: DataFrame) -> list[Column]:
    """The columns of ``df`` from the copies that :func:`_carried` made."""
    out = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"_c{i}")
        c = F.timestamp_micros(c.cast("long")) if isinstance(f.dataType, _TIMES) else c
        out.append((c if isinstance(f.dataType, _NESTED) else c.cast(f.dataType)).alias(f.name))
    return out


def stream_user_windows(df: DataFrame, key: str = "user_id", ts: str = "transaction_time", amount: str = "amount", id_col: str = "transaction_id",
                        watermark: str = "10 minutes", lookback: str = "7 days", lookback_suffix: str = "7d", velocity: str = "1 hour",
                        velocity_suffix: str = "1h", bucket: str = "1 hour", max_count: int = S.HIGH_VELOCITY_COUNT,
                        default_hours: float = S.FIRST_TX_HOURS) -> DataFrame:
    """W3-W6, W9, W10, F15 on a stream: the columns of ``df`` with user_tx_count_<7d>, user_avg_amount_<7d>, prev_transaction_time,
    hours_since_last_tx, tx_count_<1h>, total_amount_<1h> and is_high_velocity, as ``features.user_window_features`` gives them for
    the same rows.

    A row comes out once the watermark has passed its time. Rows without a time are not taken (a stream cannot order them);
    rows without a user form one user. The state of a user holds the distinct times of the look-back in buckets of ``bucket`` and
    one more time, for the previous transaction.
    """
    frame, columns = _carried(df, ts)
    frame = frame.filter(F.col("_ts").isNotNull()).withColumn("_amount", exact(df, amount)).withColumn("_id", F.col(id_col)).withColumn("_key", F.col(key))
    frame = frame.select("_key", "_ts", _TIME, "_amount", "_id", *[f"_c{i}" for i in range(len(columns))])
    money = frame.schema["_amount"].dataType
    row = T.StructType([frame.schema[c] for c in frame.columns[3:]])
    features = [(f"user_tx_count_{lookback_suffix}", "bigint"), (f"user_avg_amount_{lookback_suffix}", "double"), ("_prev", "string"),
                ("hours_since_last_tx", "double"), (f"tx_count_{velocity_suffix}", "bigint"), (f"total_amount_{velocity_suffix}", "double"), ("is_high_velocity", "int")]
    out = T.StructType([*row.fields[2:], *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in features)).fields])
    made = _run(frame, ["_key"], "_ts", watermark, UserWindows(
        row, out.names, micros(lookback), micros(velocity), micros(bucket), max_count, float(default_hours), money.scale), out)
    stored = df.schema[ts].dataType
    prev = F.timestamp_micros(F.col("_prev").cast("long"))
    return made.select(*_restored(df), *[(prev if isinstance(stored, T.StringType) else prev.cast(stored)).alias("prev_transaction_time") if n == "_prev" else F.col(n) for n, _ in features])


def stream_bursts(alerts: DataFrame, key: str = "user_id", ts: str = "detection_time", span: str = "30 minutes", threshold: int = S.ALERT_RAPID_FRAUDS,
                  watermark: str = "10 minutes") -> DataFrame:
    """T9 / R3 at every event: ``key, window_start, window_end, fraud_count, starts`` for each distinct time of a key at which
    the fraud alerts detected in [time - span, time] are at least ``threshold``. ``starts`` marks a time whose predecessor
    was not one, or lies outside the span. No grid: any span that holds enough alerts has such a time. Rows come out once
    the watermark has passed them; the state of a key is the times within the span."""
    frame = alerts.filter(F.col("is_fraud") & F.col(ts).isNotNull()).select(
        F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias(_TIME))
    row = T.StructType([frame.schema[_TIME]])
    out = T.StructType([frame.schema["_key"], *T.StructType.fromDDL("t bigint, fraud_count bigint, starts boolean").fields])
    made = _run(frame, ["_key"], "_ts", watermark, Bursts(row, out.names, micros(span), threshold), out)
    end = F.timestamp_micros("t")
    return made.select(F.col("_key").alias(key), (end - interval(span)).alias("window_start"), end.alias("window_end"), "fraud_count", "starts")


def stream_alert_expiry(alerts: DataFrame, ttl: str = S.ALERT_PAYLOAD_TTL, key: str = "transaction_id", ts: str = "detection_time",
                        watermark: str = "10 minutes", groups: int = 4096) -> DataFrame:
    """T6 on a stream: ``key, event, at, expires_at``: a ``set`` row as soon as an alert comes, an ``expired`` row when the watermark
    reaches its last expiry time (an alert that is set again lives on). At watermark w the keys alive are those
    that were set at or before w and whose expiry has not come out: the alerts of ``sinks.alert_payload`` with ``expires_at`` > w.
    The state is kept in ``groups`` groups of keys, by hash; a checkpoint goes with that number."""
    frame = alerts.filter(F.col(ts).isNotNull()).select(F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_ts"))
    frame = frame.withColumns({_TIME: F.unix_micros("_ts"), "expires": F.unix_micros(F.col("_ts") + interval(ttl)), "_group": F.pmod(F.xxhash64("_key"), F.lit(groups))})
    out = T.StructType([frame.schema["_key"], *T.StructType.fromDDL("event string, at bigint, expires bigint").fields])
    made = _run(frame, ["_group"], "_ts", watermark, Expiry(out.names, frame.schema["_key"].dataType), out)
    return made.select(F.col("_key").alias(key), "event", F.timestamp_micros("at").alias("at"), F.timestamp_micros("expires").alias("expires_at"))

"""Feature bundles (F24, F25) and per-user / per-merchant history features.

Per-user history is a running sum over the moments at which rows enter and leave a look-back, in one shuffle by user: no
frame is ever gathered, and work grows in proportion to the rows. Users of very many rows are cut into row-balanced ranges of
time (:mod:`ranking`), with the sums before each range added, so no user, however hot, is one task.

Frames use the event time in microseconds, which is exactly ``RANGE BETWEEN INTERVAL ... PRECEDING AND
CURRENT ROW`` (peers with the same time included).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.columns import (amount_features, as_timestamp, exact, flag, location_features, merchant_features,
                                 time_features)

_MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000,
           "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000}


def micros(text: str) -> int:
    """'7 days' -> microseconds."""
    amount, unit = text.strip().split(None, 1)
    unit = unit.strip().lower().rstrip("s")
    return int(float(amount) * _MICROS[unit])


# ---------------------------------------------------------------- F24
def serving_features(df: DataFrame, user_stats: DataFrame | None = None, ts: str = "transaction_time",
                     default_frequency: int = S.DEFAULT_USER_FREQUENCY) -> DataFrame:
    """the serving feature bundle.

    ``transaction_timestamp`` (F1, NULL on a malformed string), hour,
    day_of_week, amount_log, is_night, is_weekend, user_frequency (J10),
    is_high_amount, is_unknown_merchant, is_foreign_country.
    Works on batch and streaming frames.
    """
    out = df.withColumn("transaction_timestamp", as_timestamp(df, ts))
    out = time_features(out, "transaction_timestamp", extended=False)
    out = amount_features(out, micro=None)
    out = enrich_user_frequency(out, user_stats, default_frequency)
    out = merchant_features(out)
    out = location_features(out, high_risk=None, home=None)
    return out


def enrich_user_frequency(df: DataFrame, user_stats: DataFrame | None = None,
                          default: int = S.DEFAULT_USER_FREQUENCY) -> DataFrame:
    """``user_frequency`` from a per-user history table (user_id, user_frequency),
    default 15 for unknown users. A stream-static left join when ``df`` streams."""
    if user_stats is None:
        return df.withColumn("user_frequency", F.lit(default))
    # the join strategy is left to AQE, which knows the measured size of the per-user table
    stats = user_stats.select("user_id", F.col("user_frequency").alias("_uf"))
    return (df.join(stats, "user_id", "left")
            .withColumn("user_frequency", F.coalesce(F.col("_uf").cast("int"), F.lit(default)))
            .drop("_uf"))


def user_frequency_table(history: DataFrame) -> DataFrame:
    """Per-user transaction counts of a history table (input of J10)."""
    return history.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("user_frequency"))


# ---------------------------------------------------------------- J11 / W1 / W2 / W8
def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                     source: DataFrame | None = None) -> DataFrame:
    """Per-group aggregates joined back to every row.

    Aggregation is partial + final (hot keys fold map-side) over ``source`` (default ``df``; pass the narrow
    origin of a derived ``df``). The size of the stats is measured first: small ones are broadcast, so the
    wide rows are not shuffled; larger ones are joined by shuffle, where AQE splits skewed partitions.
    """
    from .joins import broadcast_measured

    stats = (source if source is not None else df).groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    # null-safe keys: rows with a NULL key form one group, as in a window's partitionBy
    renamed = stats.select(*[F.col(k).alias(f"_gk{i}") for i, k in enumerate(keys)], *aggs.keys())
    cond = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_gk{i}"))
        cond = c if cond is None else cond & c
    return df.join(broadcast_measured(renamed), cond, "left").drop(*[f"_gk{i}" for i in range(len(keys))])


def merchant_stats(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """merchant_tx_count, merchant_avg_amount (of the amounts as they are, not rounded)."""
    amounts = source if source is not None else df
    return with_group_stats(df, ["merchant"], {
        "merchant_tx_count": F.count(F.lit(1)),
        "merchant_avg_amount": F.try_divide(F.sum(exact(amounts, "amount")).cast("double"), F.count("amount")),
    }, source)


# ---------------------------------------------------------------- W1 - W6, W9, W10
#: A user of more rows than this is worked on in ranges of time, the HOT_KEYS largest at most (any other has less than a HOT_KEYS-th of all rows).
HOT_ROWS = 1_000_000
HOT_KEYS = 1000
_FIRST, _LAST = -(1 << 63) + 16, (1 << 63) - 1     # before and after all times


def _not_null(df: DataFrame, col: str) -> tuple[Column, Column]:
    """(value without NULLs, whether it was NULL): keys that join and partition by plain equality."""
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, T.StringType):
        return F.coalesce(c, F.lit("")), c.isNull()
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return F.coalesce(c, F.lit(0).cast(dtype)), c.isNull()
    return F.coalesce(c.cast("string"), F.lit("")), c.isNull()


def user_window_features(df: DataFrame, key: str = "user_id", ts: str = "transaction_time",
                         amount: str = "amount", id_col: str = "transaction_id",
                         lookback: str = "7 days", lookback_suffix: str = "7d",
                         velocity: str = "1 hour", velocity_suffix: str = "1h",
                         max_count: int = S.HIGH_VELOCITY_COUNT,
                         default_hours: float = S.FIRST_TX_HOURS, source: DataFrame | None = None,
                         n_buckets: int | None = None) -> DataFrame:
    """W1-W6, W9, W10, F14, F15.

    Adds: user_tx_count, user_avg_amount, user_tx_count_<7d>, user_avg_amount_<7d>,
    amount_deviation_from_avg, prev_transaction_time, hours_since_last_tx,
    tx_count_<1h>, total_amount_<1h>, is_high_velocity.

    The result is that of plain windows. Each row enters its user's frames at its time t and leaves that of a look-back
    L after t + L, so count and sum over [t - L, t] are running sums over entries and exits in the order of time. The rows
    go along as the entries: one shuffle by user gives every feature. Users of more than ``HOT_ROWS`` rows (all, where
    ``n_buckets`` is given) are cut into ranges of time, and what came before a range is added to its running sums. The
    previous transaction is the latest time of the user's rows before, by time and id: for the first row of a (user, time)
    the previous distinct time, for its other rows the time itself, repeated ids included. Rows without a user form one
    user; rows without a time are peers of each other and come first. ``source`` is the narrow origin
    of a derived ``df`` (same rows). Amounts are summed exactly: as whole cents where all are such, else as decimals.
    """
    from .ranking import bucket_of, key_boundaries

    lbs = {lookback_suffix: micros(lookback), velocity_suffix: micros(velocity)}
    shifts = sorted(set(lbs.values()))
    cols = df.columns
    narrow = source if source is not None else df
    largest, cents = _measured(narrow, key, amount)
    hot = F.lit(True) if n_buckets is not None else _hot(narrow, key) if largest > HOT_ROWS else None
    user, no_user = _not_null(df, key)
    at = lambda frame: F.unix_micros(F.col(ts).cast("timestamp"))

    # an entry at the time (tag 0) and an exit right after the last time that still sees the row; rows without a time leave before all times
    us = F.col("_us")
    exits = [F.when(us.isNull(), F.lit(_FIRST)).otherwise(F.coalesce(F.try_add(us, F.lit(L + 1)), F.lit(_LAST))) for L in shifts]
    steps = [F.struct(us.alias("k"), F.lit(0).alias("tag")), *[F.struct(x.alias("k"), F.lit(i + 1).alias("tag")) for i, x in enumerate(exits)]]
    events = (df.withColumns({"_u": user, "_un": no_user, "_us": at(df), "_v": _cents(amount).cast("long") if cents else exact(df, amount)})
              .select(*cols, "_u", "_un", "_us", "_v", F.explode(F.array(*steps)).alias("_e")))
    bucket = F.lit(0)
    if hot is not None:
        bucket = F.when(hot, bucket_of(F.col("_e.k"), key_boundaries(narrow.select(at(narrow).alias("_us")), "_us", n_buckets))).otherwise(0)
    # exits carry no columns of the row
    events = events.select(*[F.when(F.col("_e.tag") == 0, F.col(c)).alias(c) for c in cols], "_u", "_un", bucket.alias("_b"), F.col("_e.k").alias("_k"),
                           F.col("_e.tag").alias("_tag"), "_v", *([hot.alias("_hot")] if hot is not None else []))
    entry = F.col("_tag") == 0
    zero = F.lit(0).cast(events.schema["_v"].dataType)
    value, known = F.coalesce("_v", zero), F.col("_v").isNotNull().cast("int")
    sums = {"_c_total": F.when(entry, 1).otherwise(0), "_s_total": F.when(entry, value).otherwise(zero), "_na_total": F.when(entry, known).otherwise(0)}
    for i, L in enumerate(shifts):
        leaves = F.col("_tag") == i + 1
        sums |= {f"_c_{L}": F.when(entry, 1).when(leaves, -1).otherwise(0), f"_s_{L}": F.when(entry, value).when(leaves, -value).otherwise(zero),
                 f"_na_{L}": F.when(entry, known).when(leaves, -known).otherwise(0)}
    time = F.when(entry, F.col("_k"))

    # without constants: a shuffle by them would not be seen to serve the windows
    owner = ["_u", "_un"] if df.schema[key].nullable else ["_u"]
    part = owner if hot is None else [*owner, "_b"]
    order = Window.partitionBy(*part).orderBy("_k")
    upto, whole = (order.rangeBetween(Window.unboundedPreceding, x) for x in (Window.currentRow, Window.unboundedFollowing))
    totals, running = [n for n in sums if n.endswith("_total")], [n for n in sums if not n.endswith("_total")]
    # one shuffle and one sort serve all frames; that of rows takes them by time and id, as sorted
    by_id = events.repartition(*part).sortWithinPartitions(*part, "_k", "_tag", F.col(id_col).asc_nulls_first())
    out = by_id.select(*cols, *part, "_tag", F.max(time).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                       *[F.sum(sums[n]).over(whole).alias(f"_w{n}") for n in totals],
                       *[F.sum(sums[n]).over(upto).alias(f"_w{n}") for n in running]).filter("_tag = 0")
    got = {n: F.col(f"_w{n}") for n in sums}
    previous = F.col("_before")
    if hot is not None:
        per = events.filter("_hot").groupBy(*part).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.max(time).alias("_us"))
        of_user = Window.partitionBy(*owner)
        earlier = of_user.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per.select(*part, *[F.sum(n).over(of_user).alias(f"_o{n}") for n in totals],
                             *[F.sum(n).over(earlier).alias(f"_o{n}") for n in running], F.max("_us").over(earlier).alias("_o_before"))
        out = out.join(offsets, part, "left")
        got = {n: F.coalesce(F.col(f"_o{n}"), c) if n in totals else c + F.coalesce(F.col(f"_o{n}"), F.lit(0)) for n, c in got.items()}
        previous = F.greatest("_before", "_o_before")
    got |= {n: c.cast("double") / F.lit(100.0) if cents else c.cast("double") for n, c in got.items() if n.startswith("_s_")}
    out = out.select(*cols, previous.alias("_prev"), *[c.alias(n) for n, c in got.items()])
    got = {n: F.col(n) for n in got}
    prev_t = F.timestamp_micros("_prev")
    hours = (F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(prev_t)) / F.lit(3600.0)
    ls, vs = lookback_suffix, velocity_suffix
    avg = F.try_divide(got["_s_total"], got["_na_total"])
    count, total, amounts = ({x: got[f"{p}_{L}"] for x, L in lbs.items()} for p in ("_c", "_s", "_na"))
    stored = df.schema[ts].dataType
    return out.select(
        *cols,
        got["_c_total"].alias("user_tx_count"),
        avg.alias("user_avg_amount"),
        count[ls].alias(f"user_tx_count_{ls}"),
        F.try_divide(total[ls], amounts[ls]).alias(f"user_avg_amount_{ls}"),
        F.try_divide(F.col(amount) - avg, avg + F.lit(1)).alias("amount_deviation_from_avg"),
        (prev_t if isinstance(stored, T.StringType) else prev_t.cast(stored)).alias("prev_transaction_time"),
        F.coalesce(hours, F.lit(float(default_hours))).alias("hours_since_last_tx"),
        count[vs].alias(f"tx_count_{vs}"),
        # as a window's sum: NULL where no row of the frame has an amount
        F.when(amounts[vs] > 0, total[vs]).alias(f"total_amount_{vs}"),
        flag(count[vs] > F.lit(max_count)).alias("is_high_velocity"),
    )


def _cents(amount: str) -> Column:
    return F.rint(F.col(amount) * F.lit(100.0))


def _measured(df: DataFrame, key: str, amount: str) -> tuple[int, bool]:
    """(rows of the largest user, whether amounts are summed as whole cents), in one pass.

    Cents are for doubles that all are whole cents, with less than 2^52 cents a user in all: sums of whole numbers are then as exact as
    those of the decimals of :func:`exact`, and give the same doubles, at a fraction of their cost."""
    double = isinstance(df.schema[amount].dataType, T.DoubleType)
    units = F.abs(_cents(amount)) if double else F.lit(0.0)
    # up to 15 digits a decimal and its double stand for each other; NaN and infinity are no cents
    whole = F.col(amount).isNull() | (units < F.lit(1e15)) & (_cents(amount) / F.lit(100.0) == F.col(amount)) if double else F.lit(False)
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(whole, 1).otherwise(0)).alias("whole"), F.sum(units).alias("cents"))
    r = per.agg(F.max("n").alias("n"), F.min("whole").alias("whole"), F.max("cents").alias("cents")).first()
    return r["n"] or 0, r["whole"] == 1 and (r["cents"] or 0.0) < 2.0 ** 52


def _hot(df: DataFrame, key: str) -> Column | None:
    """Whether a row's key has more than ``HOT_ROWS`` rows and is among the ``HOT_KEYS`` largest; None where no key has. Told by
    the key's hash: another key of the same hash is only cut as well."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS)
    found = [r[0] for r in counts.orderBy(F.desc("_n")).limit(HOT_KEYS).select(F.xxhash64(key)).collect()]
    return F.xxhash64(key).isin(found) if found else None


def user_lookback(df: DataFrame, interval: str = "7 days", suffix: str = "7d", **kw) -> DataFrame:
    """user_tx_count_<suffix>, user_avg_amount_<suffix> over a RANGE look-back."""
    out = user_window_features(df, lookback=interval, lookback_suffix=suffix, **kw)
    keep = df.columns + [f"user_tx_count_{suffix}", f"user_avg_amount_{suffix}"]
    return out.select(*keep)


def velocity(df: DataFrame, interval: str = "1 hour", max_count: int = S.HIGH_VELOCITY_COUNT,
             suffix: str = "1h", **kw) -> DataFrame:
    """tx_count_<suffix>, total_amount_<suffix>, is_high_velocity."""
    out = user_window_features(df, lookback=interval, velocity=interval, velocity_suffix=suffix,
                               max_count=max_count, **kw)
    keep = df.columns + [f"tx_count_{suffix}", f"total_amount_{suffix}", "is_high_velocity"]
    return out.select(*keep)


def time_since_previous(df: DataFrame, key: str = "user_id", ts: str = "transaction_time",
                        default_hours: float = S.FIRST_TX_HOURS, **kw) -> DataFrame:
    """prev_transaction_time, hours_since_last_tx (whole seconds / 3600; first -> 24)."""
    out = user_window_features(df, key=key, ts=ts, default_hours=default_hours, **kw)
    return out.select(*df.columns, "prev_transaction_time", "hours_since_last_tx")


# ---------------------------------------------------------------- F25
def batch_features(df: DataFrame, ts: str = "transaction_time", with_rule_score: bool = True,
                   n_buckets: int | None = None) -> DataFrame:
    """the batch feature bundle (time, amount, user, merchant, location, velocity).

    Every statistic is computed from the narrow columns of ``df`` and joined to the wide rows last: per-user
    features by one join on (user, time), ``amount_percentile`` by one on the amount, merchant stats by a
    broadcast where they are small. With ``with_rule_score`` also the ``fraud_score_rule`` column (R0) that the
    batch job's sample output asks for.
    """
    from .ranking import distributed_percent_rank
    from .scoring import rule_score_col

    out = user_window_features(df, ts=ts, source=df, n_buckets=n_buckets)
    out = distributed_percent_rank(out, "amount", "amount_percentile", n_buckets=n_buckets, source=df)
    out = merchant_stats(out, source=df)
    out = time_features(out, ts)
    out = amount_features(out)
    out = merchant_features(out)
    out = location_features(out, foreign=S.FOREIGN_COUNTRIES)
    if with_rule_score:
        out = out.withColumn("fraud_score_rule", rule_score_col())
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of integer / long / double columns."""
    from pyspark.sql import types as T

    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType))]

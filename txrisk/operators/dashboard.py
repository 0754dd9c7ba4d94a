"""Dashboard and monitoring queries.

Every "now" is the ``as_of`` argument (default ``current_timestamp()``).
Bundles aggregate each table in one pass with conditional aggregates and are
combined through scalar subqueries (one row each), never by joining the big
tables to each other more than the semantics need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_of_col, exact_avg, interval, on_date_col, prune, within, within_col
from .. import schemas as S
from ..sources.tables import dealt, partitions_for

TX_COLUMNS = ["transaction_id", "user_id", "amount", "currency", "merchant",
              "transaction_time", "country", "transaction_type"]


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def one_row(frames: Sequence[DataFrame]) -> DataFrame:
    """Put several one-row aggregates side by side through scalar subqueries."""
    first, rest = frames[0], frames[1:]
    cols = [F.col(c) for c in first.columns]
    names = []
    for i, fr in enumerate(rest):
        name = f"_s{i}"
        cols.append(fr.select(F.struct(*fr.columns)).scalar().alias(name))
        names.append(name)
    out = first.select(*cols)
    return out.select(*first.columns, *[f"{n}.*" for n in names])


# ---------------------------------------------------------------- joins
def tx_with_alerts(tx: DataFrame, alerts: DataFrame, fraud_only: bool = False) -> DataFrame:
    """J1 (J2 with ``fraud_only``) + P10/F17: transactions left-joined to their alerts; ``coalesce`` defaults
    fraud_score 0, is_fraud FALSE, alert_status 'n/a'. One row per matching alert."""
    a = alerts.filter(F.col("is_fraud")) if fraud_only else alerts
    a = a.select("transaction_id", F.col("fraud_score").alias("_fs"),
                 F.col("is_fraud").alias("_if"), F.col("alert_status").alias("_st"))
    j = tx.select(*TX_COLUMNS).join(a, "transaction_id", "left")
    return j.select(
        *TX_COLUMNS,
        F.coalesce(F.col("_fs").cast("double"), F.lit(0.0)).alias("fraud_score"),
        F.coalesce(F.col("_if"), F.lit(False)).alias("is_fraud"),
        F.coalesce(F.col("_st"), F.lit(S.NO_ALERT_STATUS)).alias("alert_status"),
    )


def _top_tx(tx: DataFrame, n: int, ascending: bool) -> DataFrame:
    order = ([F.col("transaction_time").asc(), F.col("transaction_id").asc()] if ascending
             else [F.col("transaction_time").desc(), F.col("transaction_id").desc()])
    return tx.select(*TX_COLUMNS).orderBy(*order).limit(n)


def _page(top: DataFrame, alerts: DataFrame, n: int, ascending: bool) -> DataFrame:
    # ``top`` and the matched page have at most n rows each (a proven bound), so both are broadcast: the alerts
    # table is scanned once and never shuffled. Rows of J1 beyond the first n cannot be on the page, so neither can
    # the place-holder of a transaction whose matches were cut off with them.
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("transaction_time", "transaction_id", "fraud_score")]
    a = alerts.select("transaction_id", F.col("fraud_score").alias("_fs"), F.col("is_fraud").alias("_if"), F.col("alert_status").alias("_st"))
    matched = a.join(F.broadcast(top), "transaction_id").select(
        *TX_COLUMNS,
        F.coalesce(F.col("_fs").cast("double"), F.lit(0.0)).alias("fraud_score"),
        F.coalesce(F.col("_if"), F.lit(False)).alias("is_fraud"),
        F.coalesce(F.col("_st"), F.lit(S.NO_ALERT_STATUS)).alias("alert_status"),
    ).orderBy(*order).limit(n)
    alone = top.join(F.broadcast(matched.select("transaction_id").distinct()), "transaction_id", "left_anti").select(
        *TX_COLUMNS, F.lit(0.0).alias("fraud_score"), F.lit(False).alias("is_fraud"), F.lit(S.NO_ALERT_STATUS).alias("alert_status"))
    return matched.unionByName(alone).orderBy(*order).limit(n)


def recent_transactions(tx: DataFrame, alerts: DataFrame, limit: int = 20, ascending: bool = False) -> DataFrame:
    """O1 (+O11 with ``ascending``): newest ``limit`` rows of J1, newest first.

    Every output row belongs to one of the ``limit`` newest transactions, so the
    top-k runs on the transactions first (partial top-k per partition) and only
    those rows meet the alerts table.
    """
    out = _page(_top_tx(tx, limit, ascending=False), alerts, limit, ascending=False)
    if ascending:
        out = out.orderBy("transaction_time", "transaction_id")
    return out


def newest(tx: DataFrame) -> DataFrame:
    """O2: the newest transaction (time, then id, descending)."""
    return _top_tx(tx, 1, ascending=False).select("transaction_id", "transaction_time")


def page_after(tx: DataFrame, alerts: DataFrame, anchor_id: str, limit: int = 20) -> DataFrame:
    """The next ``limit`` rows of J1 after the anchor transaction, oldest first (the live feed).

    Keyset on (transaction_time, transaction_id), so rows tied in time with the
    anchor are not skipped. The anchor is an uncorrelated scalar subquery.
    """
    anchor = tx.filter(F.col("transaction_id") == F.lit(anchor_id))
    # one reference to the scalar subquery: (time, id) > (anchor time, anchor id) as a struct comparison
    key = anchor.select(F.struct(F.max("transaction_time").alias("t"), F.lit(anchor_id).alias("i"))).scalar()
    later = tx.filter(F.struct(F.col("transaction_time").alias("t"), F.col("transaction_id").alias("i")) > key)
    return _page(_top_tx(later, limit, ascending=True), alerts, limit, ascending=True)


def newer_than(tx: DataFrame, anchor_id: str) -> DataFrame:
    """J5 as written: transactions strictly newer (by time) than the anchor's time."""
    at = tx.filter(F.col("transaction_id") == F.lit(anchor_id)).select(F.max("transaction_time")).scalar()
    return tx.filter(F.col("transaction_time") > at)


def alerts_feed(alerts: DataFrame, status: str | None = None, limit: int = 20) -> DataFrame:
    """Fraud alerts (optionally of one status), newest detection first."""
    a = alerts.filter(F.col("is_fraud"))
    if status is not None:
        a = a.filter(F.col("alert_status") == F.lit(status))
    return (a.select("transaction_id", "user_id", "amount", "merchant", "fraud_score", "is_fraud",
                     "model_version", "detection_time", "transaction_time", "alert_status")
            .orderBy(F.col("detection_time").desc(), F.col("transaction_id").desc())
            .limit(limit))


def unseen_alerts(current: DataFrame, seen: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Current alerts whose key was not seen yet (anti join)."""
    return current.join(seen.select(key), key, "left_anti")


def retain_seen(seen: DataFrame, current: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Seen keys that still exist (semi join)."""
    return seen.join(current.select(key), key, "left_semi")


def orphans(alerts: DataFrame, tx: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Alerts whose transaction is missing."""
    return alerts.join(tx.select(key), key, "left_anti")


def cascade_delete(alerts: DataFrame, remaining_tx: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Keep only alerts whose transaction survives."""
    return alerts.join(remaining_tx.select(key), key, "left_semi")


def union_samples(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    out = frames[0]
    for fr in frames[1:]:
        out = out.unionByName(fr)
    return out


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """U4: the rows to append: those whose key is not in the table yet (distinct keys among them)."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys)


# ---------------------------------------------------------------- aggregates
def tx_counts(tx: DataFrame, as_of=None, time_col: str = "transaction_time",
              today: str = "24 hours", avg_window: str = "24 hours") -> DataFrame:
    """A1 + A2 + A17: transactions in the last minute / today / window average amount, one pass.

    ``today='calendar'`` counts DATE(time) = DATE(as_of) (the monitoring form).
    """
    t = as_of_col(as_of)
    today_cond = on_date_col(time_col, t) if today == "calendar" else within_col(time_col, t, today)
    avg_cond = within_col(time_col, t, avg_window)
    # Only rows inside the union of the windows can count: filter on the bare
    # time column first (bounds fold to constants, so Parquet skips the rest).
    if today == "calendar":
        day = F.date_trunc("day", t)
        lower = F.least(day, t - interval("1 minute"), t - interval(avg_window))
        upper = F.greatest(t, day + interval("1 day"))
    else:
        lower = F.least(t - interval("1 minute"), t - interval(today), t - interval(avg_window))
        upper = t
    tx = prune(tx, time_col, lower, upper).filter((F.col(time_col) >= lower) & (F.col(time_col) <= upper))
    return tx.agg(
        _count_if(within_col(time_col, t, "1 minute")).alias("transactions_per_minute"),
        _count_if(today_cond).alias("transactions_today"),
        F.round(F.coalesce(exact_avg("amount", where=avg_cond), F.lit(0.0)), 2).alias("avg_amount"),
    )


transaction_stats = tx_counts


def alert_counts(alerts: DataFrame, as_of=None, lookback: str = "24 hours",
                 fraud_only: bool = True) -> DataFrame:
    """A3/A4 + A5 + A6: frauds (or alerts) in window, pending alerts (no time bound),
    average score in window (0 when none)."""
    t = as_of_col(as_of)
    w = within_col("detection_time", t, lookback)
    hit = (w & F.col("is_fraud")) if fraud_only else w
    return alerts.agg(
        _count_if(hit).alias("frauds_detected"),
        _count_if(F.col("alert_status") == F.lit(S.PENDING_STATUS)).alias("pending_alerts"),
        F.round(F.coalesce(exact_avg("fraud_score", S.SCORE_DECIMAL, where=w), F.lit(0.0)), 4)
        .alias("avg_fraud_score"),
    )


def _alerts_in_window(alerts: DataFrame, time_col: str, as_of, lookback: str, bound: bool) -> DataFrame:
    """Alerts that can match a transaction of the window: all of them, unless the caller states with ``bound`` that
    every alert row holds an exact copy of its transaction's ``transaction_time``; then a window on that column
    also bounds the alert side, and only the matching days / row groups are read."""
    if bound and time_col == "transaction_time" and "transaction_time" in alerts.columns:
        return within(alerts, "transaction_time", as_of, lookback)
    return alerts


def fraud_rate(tx: DataFrame, alerts: DataFrame, as_of=None, lookback: str = "24 hours",
               time_col: str = "transaction_time", fraud_only: bool = True,
               bound_alerts: bool = False) -> DataFrame:
    """A7 + J2 + J3: COUNT(DISTINCT fraud tx) / COUNT(DISTINCT tx) over the window, 0 when empty.

    Both sides are de-duplicated by transaction id first (partial aggregation
    folds copies map-side), so the left join that follows is one-to-one and
    reuses the shared hash partitioning on transaction_id. ``bound_alerts``:
    see :func:`_alerts_in_window`.
    """
    t = within(tx, time_col, as_of, lookback).select("transaction_id").distinct()
    a = alerts.filter(F.col("is_fraud")) if fraud_only else alerts
    a = _alerts_in_window(a, time_col, as_of, lookback, bound_alerts)
    a = a.select("transaction_id").distinct().withColumn("_hit", F.lit(1))
    j = t.join(a, "transaction_id", "left")
    agg = j.agg(F.count(F.lit(1)).alias("total_tx"), F.count("_hit").alias("fraud_tx"))
    return agg.select(
        "total_tx", "fraud_tx",
        F.when(F.col("total_tx") > 0, F.col("fraud_tx") / F.col("total_tx")).otherwise(F.lit(0.0))
        .alias("fraud_rate"),
    )


def fraud_by_country(alerts: DataFrame, tx: DataFrame, as_of=None, lookback: str = "24 hours",
                     n: int = 10) -> DataFrame:
    """Fraud alerts per transaction country (inner join), top ``n`` by count."""
    # the join is on the id alone: an alert's own day may be missing or differ. AQE broadcasts the recent
    # alerts if they turn out small.
    a = within(alerts.filter(F.col("is_fraud")), "detection_time", as_of, lookback).select("transaction_id")
    j = tx.select("transaction_id", "country").join(a, "transaction_id", "inner")
    return (j.groupBy("country").agg(F.count(F.lit(1)).alias("fraud_count"))
            .orderBy(F.col("fraud_count").desc(), F.col("country").asc_nulls_last())
            .limit(n))


def volume_history(tx: DataFrame, alerts: DataFrame, as_of=None, minutes: int = 1440,
                   time_col: str = "transaction_time", bound_alerts: bool = False) -> DataFrame:
    """A9 + F16 + O7: per minute, distinct transactions and distinct fraud transactions (ascending).

    (minute, id) pairs are de-duplicated before the join, alerts by id, so the
    join is one-to-one and the counts are plain counts. ``bound_alerts``: see
    :func:`_alerts_in_window`.
    """
    lookback = f"{minutes} minutes"
    t = (within(tx, time_col, as_of, lookback)
         .select(F.date_trunc("minute", F.col(time_col)).alias("minute"), "transaction_id").distinct())
    a = _alerts_in_window(alerts.filter(F.col("is_fraud")), time_col, as_of, lookback, bound_alerts)
    a = a.select("transaction_id").distinct().withColumn("_hit", F.lit(1))
    j = t.join(a, "transaction_id", "left")
    return (j.groupBy("minute").agg(F.count(F.lit(1)).alias("tx_count"), F.count("_hit").alias("fraud_count"))
            .orderBy("minute"))


def fraud_summary(alerts: DataFrame) -> DataFrame:
    """A10 + O7: per detection day (newest first): alerts, confirmed frauds, avg score, flagged amount, distinct users."""
    return (alerts.groupBy(F.to_date("detection_time").alias("date"))
            .agg(F.count(F.lit(1)).alias("total_alerts"),
                 F.sum(F.when(F.col("is_fraud"), 1).otherwise(0)).alias("confirmed_frauds"),
                 exact_avg("fraud_score", S.SCORE_DECIMAL).alias("avg_fraud_score"),
                 F.sum(F.col("amount").cast("decimal(15,2)")).alias("total_amount_flagged"),
                 F.countDistinct("user_id").alias("unique_users_flagged"))
            .orderBy(F.col("date").desc()))


def daily_transaction_stats(tx: DataFrame, rows: int | None = None) -> DataFrame:
    """A11 + O7: per transaction day (newest first): count, avg / max / min amount, distinct users, merchants.

    Rows are folded by (day, user) and (day, merchant) first, over as many partitions as ``rows`` (counted where not given)
    call for, so that the memory of a task does not grow with the input."""
    rows = tx.count() if rows is None else rows
    named = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
    long = tx.select(F.to_date("transaction_time").alias("date"), F.col("amount").alias("_amount"),
                     F.explode(F.array(named("user", "user_id"), named("merchant", "merchant"))).alias("e")).select("date", "_amount", "e.kind", "e.value")
    keys = ["date", "kind", "value"]
    money = F.col("_amount").cast(T.DecimalType(*S.AMOUNT_DECIMAL))
    folded = dealt(long, partitions_for(tx.sparkSession, 2 * rows), *keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money).alias("s"), F.count("_amount").alias("na"), F.max("_amount").alias("high"), F.min("_amount").alias("low"))
    user, distinct = F.col("kind") == "user", F.col("value").isNotNull()
    of = lambda c: F.when(user, F.col(c))
    return (folded.groupBy("date")
            .agg(F.sum(of("n")).alias("total_transactions"),
                 F.try_divide(F.sum(of("s")).cast("double"), F.sum(of("na"))).alias("avg_amount"),
                 F.max("high").alias("max_amount"),
                 F.min("low").alias("min_amount"),
                 F.count(F.when(user & distinct, 1)).alias("unique_users"),
                 F.count(F.when(~user & distinct, 1)).alias("unique_merchants"))
            .orderBy(F.col("date").desc()))


def rapid_sequences(alerts: DataFrame, as_of=None, lookback: str = "30 minutes",
                    threshold: int = 10) -> DataFrame:
    """Users with at least ``threshold`` fraud alerts in the window, with the count."""
    a = within(alerts.filter(F.col("is_fraud")), "detection_time", as_of, lookback)
    return (a.groupBy("user_id").agg(F.count(F.lit(1)).alias("fraud_count"))
            .filter(F.col("fraud_count") >= F.lit(threshold)))


def rapid_sequence_members(alerts: DataFrame, as_of=None, lookback: str = "30 minutes",
                           threshold: int = 10) -> DataFrame:
    """A12's transaction list in long form: one row per (user, transaction).

    The list is kept as rows rather than one array per user, so a user with a
    huge number of alerts never becomes a single in-memory value.
    """
    a = within(alerts.filter(F.col("is_fraud")), "detection_time", as_of, lookback)
    users = rapid_sequences(alerts, as_of, lookback, threshold)
    return a.select("user_id", "transaction_id").join(users, "user_id", "inner")


def label_distribution(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Rows per label value, most frequent first."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), F.col(label))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, row_count) for each named frame."""
    frames = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
              for name, df in tables.items()]
    return union_samples(*frames)


def fraud_stats(tx: DataFrame, alerts: DataFrame, as_of=None, lookback: str = "24 hours",
                n: int = 10) -> DataFrame:
    """Frauds, fraud rate, avg score, pending, top countries; one row."""
    counts = alert_counts(alerts, as_of, lookback)
    rate = fraud_rate(tx, alerts, as_of, lookback).select(F.round("fraud_rate", 4).alias("fraud_rate"))
    countries = by_country_array(fraud_by_country(alerts, tx, as_of, lookback, n))
    return one_row([counts, rate, countries])


def by_country_array(top: DataFrame) -> DataFrame:
    """The top-country rows (at most n) as one ordered array of (country, fraud_count)."""
    arr = F.sort_array(F.collect_list(F.struct((-F.col("fraud_count")).alias("_k"), "country", "fraud_count")))
    return top.agg(F.transform(arr, lambda s: F.struct(s["country"].alias("country"),
                                                        s["fraud_count"].alias("fraud_count")))
                   .alias("by_country"))


def dashboard_stats(tx: DataFrame, alerts: DataFrame, as_of=None, lookback: str = "24 hours",
                    n: int = 10) -> DataFrame:
    """The eight live statistics in one row."""
    txs = tx_counts(tx, as_of, "transaction_time", today=lookback, avg_window=lookback)
    return one_row([txs, fraud_stats(tx, alerts, as_of, lookback, n)]).select(
        "transactions_per_minute", "transactions_today", "avg_amount", "frauds_detected",
        "pending_alerts", "fraud_rate", "avg_fraud_score", "by_country")


def to_record(df: DataFrame) -> DataFrame:
    """A record for JSON output: times as strings, decimals as doubles, flags as booleans."""
    from pyspark.sql import types as T

    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def live_alerts(alerts: DataFrame, as_of=None, ttl: str = "1 hour", time_col: str = "detection_time") -> DataFrame:
    """Alerts younger than the TTL (what a key-value cache with expiry would hold)."""
    return within(alerts, time_col, as_of, ttl)

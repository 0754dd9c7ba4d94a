"""Scalar feature columns and predicates (native Spark expressions only).

Everything here returns a ``Column`` or adds columns with one ``withColumns``
projection, so Catalyst collapses it into the scan's whole-stage codegen span.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_of_col(as_of=None) -> Column:
    """``as_of`` as a timestamp column; ``None`` means ``current_timestamp()``."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (_dt.datetime, _dt.date)):
        return F.lit(as_of).cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def interval(text: str) -> Column:
    """A day-time interval literal such as ``interval("24 hours")``."""
    return F.expr(f"INTERVAL {_interval_sql(text)}")


def _interval_sql(text: str) -> str:
    amount, unit = text.strip().split(None, 1)
    unit = unit.strip().rstrip("s").upper()
    return f"'{amount}' {unit}"


# ---------------------------------------------------------------- predicates
def partition_column(df: DataFrame, col: str) -> str | None:
    """The day-partition column of a ``<x>_time`` column, if ``df`` has it: ``<x>_date``
    (the tables written by :mod:`txrisk.sources.sinks` are partitioned that way)."""
    if not col.endswith("_time"):
        return None
    pcol = col[: -len("_time")] + "_date"
    if pcol in df.columns and isinstance(df.schema[pcol].dataType, T.DateType):
        return pcol
    return None


def prune(df: DataFrame, col: str, lower: Column, upper: Column) -> DataFrame:
    """Add the day-partition predicate implied by ``lower <= col <= upper`` (partition pruning)."""
    pcol = partition_column(df, col)
    if pcol is None:
        return df
    return df.filter((F.col(pcol) >= F.to_date(lower)) & (F.col(pcol) <= F.to_date(upper)))


def within(df: DataFrame, col: str, as_of=None, lookback: str = "24 hours") -> DataFrame:
    """P5: rows with ``as_of - lookback <= col <= as_of`` (bare column: pushdown-friendly;
    on a day-partitioned table also a partition predicate, so whole days are skipped)."""
    t = as_of_col(as_of)
    lower = t - interval(lookback)
    return prune(df, col, lower, t).filter((F.col(col) >= lower) & (F.col(col) <= t))


def within_col(col: str, as_of=None, lookback: str = "24 hours") -> Column:
    t = as_of_col(as_of)
    return (F.col(col) >= t - interval(lookback)) & (F.col(col) <= t)


def on_date_col(col: str, as_of=None) -> Column:
    """``DATE(col) = DATE(as_of)`` written as a range on the bare column."""
    day = F.date_trunc("day", as_of_col(as_of))
    return (F.col(col) >= day) & (F.col(col) < day + interval("1 day"))


# ---------------------------------------------------------------- F1 - F13
def parse_time(col: str | Column) -> Column:
    """ISO-8601 string to timestamp; malformed strings give NULL, not an error."""
    return F.try_to_timestamp(_c(col))


def as_timestamp(df: DataFrame, col: str) -> Column:
    """A timestamp view of ``col`` whatever its stored type (string / ntz / ltz)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.StringType):
        return parse_time(col)
    if isinstance(dtype, T.TimestampType):
        return F.col(col)
    return F.col(col).cast("timestamp")


def flag(cond: Column) -> Column:
    """boolean condition as a 0/1 ``CASE WHEN`` column; NULL counts as 0."""
    return F.when(cond, 1).otherwise(0)


def time_features(df: DataFrame, ts: str = "transaction_time", extended: bool = True) -> DataFrame:
    """Hour, day_of_week (1 = Sunday), day_of_month, month, is_night, is_weekend, is_business_hours."""
    t = F.col(ts)
    hour = F.hour(t)
    dow = F.dayofweek(t)
    cols = {
        "hour": hour,
        "day_of_week": dow,
    }
    if extended:
        cols["day_of_month"] = F.dayofmonth(t)
        cols["month"] = F.month(t)
    cols["is_night"] = flag((hour >= S.NIGHT_FROM_HOUR) | (hour <= S.NIGHT_TO_HOUR))
    cols["is_weekend"] = flag(dow.isin(S.WEEKEND_DAYS))
    if extended:
        cols["is_business_hours"] = flag((hour >= S.BUSINESS_FROM_HOUR) & (hour <= S.BUSINESS_TO_HOUR))
    return df.withColumns(cols)


def amount_features(df: DataFrame, high: float = S.HIGH_AMOUNT, micro: float | None = S.MICRO_AMOUNT,
                    amount: str = "amount") -> DataFrame:
    """amount_log = log1p(amount), is_high_amount (> high), is_micro_transaction (< micro)."""
    a = F.col(amount)
    cols = {"amount_log": F.log1p(a), "is_high_amount": flag(a > F.lit(high))}
    if micro is not None:
        cols["is_micro_transaction"] = flag(a < F.lit(micro))
    return df.withColumns(cols)


def merchant_features(df: DataFrame, risky: Iterable[str] = S.RISKY_MERCHANTS) -> DataFrame:
    """is_unknown_merchant; NULL merchant is 0."""
    return df.withColumn("is_unknown_merchant", flag(F.col("merchant").isin(list(risky))))


def location_features(df: DataFrame, foreign: Iterable[str] = S.FOREIGN_COUNTRIES,
                      high_risk: Iterable[str] | None = S.HIGH_RISK_COUNTRIES,
                      home: str | None = S.HOME_COUNTRY) -> DataFrame:
    """is_foreign_country, is_high_risk_country, is_domestic."""
    c = F.col("country")
    cols = {"is_foreign_country": flag(c.isin(list(foreign)))}
    if high_risk is not None:
        cols["is_high_risk_country"] = flag(c.isin(list(high_risk)))
    if home is not None:
        cols["is_domestic"] = flag(c == F.lit(home))
    return df.withColumns(cols)


def deviation_from(amount: str, avg: str) -> Column:
    """(amount - avg) / (avg + 1); NULL instead of an error on a zero denominator."""
    return F.try_divide(F.col(amount) - F.col(avg), F.col(avg) + F.lit(1))


# ---------------------------------------------------------------- F16 - F26
def minute(col: str) -> Column:
    """F16: ``date_trunc('minute', col)`` (``DATE(col)`` is ``to_date``)."""
    return F.date_trunc("minute", F.col(col))


def round_to(col: Column, places: int) -> Column:
    """HALF_UP rounding of a double."""
    return F.round(col, places)


def clamp_one(col: Column) -> Column:
    """min(score, 1.0) as a column expression."""
    return F.least(col, F.lit(1.0))


def money(col: str | Column) -> Column:
    """Amount as stored in the tables: decimal(15,2)."""
    p, s = S.AMOUNT_DECIMAL
    return _c(col).cast(T.DecimalType(p, s))


def exact_avg(col: str | Column, decimal: tuple[int, int] = S.AMOUNT_DECIMAL, where: Column | None = None) -> Column:
    """Average of a money / score column as stored (decimal): exact decimal sum, then
    one double division. Unlike a double sum, the result does not depend on the
    order rows reach the aggregate, so it is the same on any partitioning.
    NULL when no row qualifies."""
    p, s = decimal
    c = _c(col)
    if where is not None:
        c = F.when(where, c)
    return F.try_divide(F.sum(c.cast(T.DecimalType(p, s))).cast("double"), F.count(c))


def exact(df: DataFrame, col: str) -> Column:
    """An amount for exact sums: a stored decimal as it is, whole numbers as decimal(38,0), other numbers with ten
    decimals (values of 1e28 and more, which do not fit, count as NULL). Sums of it do not depend on the order
    of the rows, and differences of prefix sums are exact."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.DecimalType):
        return F.col(col)
    if isinstance(dtype, T.IntegralType):
        return F.col(col).cast("decimal(38,0)")
    return F.col(col).cast("double").try_cast("decimal(38,10)")


def score_decimal(col: str | Column) -> Column:
    p, s = S.SCORE_DECIMAL
    return _c(col).cast(T.DecimalType(p, s))


def ts_string(col: str | Column, micros: bool = True) -> Column:
    """Timestamp rendered as 'yyyy-MM-dd HH:mm:ss[.SSSSSS]' (record / JSON output)."""
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS" if micros else "yyyy-MM-dd HH:mm:ss"
    return F.date_format(_c(col), fmt)


def model_version_name(ts: str | Column, prefix: str = S.MODEL_VERSION_PREFIX) -> Column:
    """model version ``fraud_model_<yyyyMMdd_HHmmss>`` from a training time."""
    return F.concat(F.lit(prefix), F.date_format(_c(ts), "yyyyMMdd_HHmmss"))


def percent(col: Column, places: int = 2) -> Column:
    """F20 helper: ratio rendered as a percentage with fixed decimals."""
    return F.format_string(f"%.{places}f%%", col * F.lit(100.0))

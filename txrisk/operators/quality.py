"""Data-quality checks re-aimed from table constraints (Q1-Q5).

Constraints the stored tables enforced at insert time become checks over
DataFrames: a quarantine split for NOT NULL, duplicate reports and
de-duplication for UNIQUE, anti joins for foreign keys (see
``dashboard.orphans``), range checks for decimal / varchar limits, and
column defaults.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def _missing(required: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())


def split_valid(df: DataFrame, required: Sequence[str] = S.REQUIRED_TRANSACTION_COLUMNS
                ) -> tuple[DataFrame, DataFrame]:
    """Q1: (valid rows, quarantined rows with ``missing`` = names of the NULL required columns)."""
    cond = F.lit(False)
    for c in required:
        cond = cond | F.col(c).isNull()
    valid = df.filter(~cond)
    quarantine = df.filter(cond).withColumn("missing", _missing(required))
    return valid, quarantine


def duplicates(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Q2 report: keys that occur more than once, with their count."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def dedupe(df: DataFrame, key: str | Sequence[str], order_by: str | None = None,
           watermark: str | None = None, time_col: str = "transaction_time") -> DataFrame:
    """One row per key.

    Batch: keeps the row with the smallest ``order_by`` (NULL last, then all columns), so
    the result does not depend on partitioning; ``order_by=None`` keeps an
    arbitrary row (``dropDuplicates``). Each map task forwards at most one row per key
    (window group limit), so a key with a huge number of copies is cheap.
    Stream: ``withWatermark(time_col, watermark)`` + ``dropDuplicatesWithinWatermark``
    (``watermark`` is ignored for batch frames, which see all rows at once).
    """
    keys = [key] if isinstance(key, str) else list(key)
    if df.isStreaming:
        wm = watermark or "10 minutes"
        return df.withWatermark(time_col, wm).dropDuplicatesWithinWatermark(keys)
    if order_by is None:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys and c != order_by]
    first = Window.partitionBy(*keys).orderBy(F.col(order_by).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest])
    return df.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn")


def out_of_range(df: DataFrame, id_col: str = "transaction_id",
                 lengths: Mapping[str, int] = S.TRANSACTION_LIMITS,
                 decimals: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """Q4: one row per violation: (id, column, problem) for strings longer than their
    limit and values that do not fit their decimal(p, s)."""
    decimals = {"amount": S.AMOUNT_DECIMAL} if decimals is None else decimals
    checks = []
    for c, n in lengths.items():
        if c in df.columns:
            checks.append(F.when(F.length(F.col(c)) > F.lit(n),
                                 F.struct(F.lit(c).alias("column"), F.lit(f"length > {n}").alias("problem"))))
    for c, (p, s) in decimals.items():
        if c in df.columns:
            bad = F.col(c).isNotNull() & F.col(c).try_cast(f"decimal({p},{s})").isNull()
            checks.append(F.when(bad, F.struct(F.lit(c).alias("column"),
                                               F.lit(f"not decimal({p},{s})").alias("problem"))))
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return (df.select(F.col(id_col), F.explode(arr).alias("v"))
            .select(id_col, "v.column", "v.problem"))


def with_defaults(df: DataFrame, defaults: Mapping[str, Column | object]) -> DataFrame:
    """Q5: fill NULLs (or add missing columns) with defaults, e.g.
    ``{"alert_status": "pending", "created_at": F.current_timestamp()}``."""
    cols = {}
    for c, v in defaults.items():
        val = v if isinstance(v, Column) else F.lit(v)
        cols[c] = F.coalesce(F.col(c), val) if c in df.columns else val
    return df.withColumns(cols)


def ensure_columns(df: DataFrame, names: Sequence[str], default=0) -> DataFrame:
    """Add missing columns as a constant in one projection."""
    missing = {c: F.lit(default) for c in names if c not in df.columns}
    return df.withColumns(missing) if missing else df


def select_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns in a fixed order."""
    return df.select(*names)


def sample_rows(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows of the chosen columns (missing ones are skipped)."""
    return df.select(*[c for c in cols if c in df.columns]).limit(n)

"""Summaries and fitted statistics.

Exact quantiles use the distributed prefix sums of :mod:`ranking`: values are
collapsed to (feature, value, count), ranked by range buckets, and only the
rows at the interpolation positions are kept, so no group's values are ever
gathered in one task (unlike the ``percentile`` aggregate).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import numeric_columns
from .ranking import key_boundaries, prefix_sums

DEFAULT_PROBS = (0.25, 0.5, 0.75)


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value) rows for the given numeric columns, NULLs dropped."""
    casted = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return (casted.unpivot([], list(cols), "feature", "value")
            .filter(F.col("value").isNotNull()))


def _label(p: float) -> str:
    return f"p{int(round(p * 100))}"


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = DEFAULT_PROBS,
                    n_buckets: int | None = None) -> DataFrame:
    """Per column, linear-interpolation quantiles (position p * (n - 1)), as ``p25``, ``p50``, ...

    One row per feature: (feature, p25, p50, p75, ...).
    """
    long = _long(df, cols)
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_cnt"))
    pre = prefix_sums(counts, "value", ["_cnt"], ["feature"], bounds=key_boundaries(long, "value", n_buckets))
    n = F.col("_cnt_total")
    hits = []
    aggs = []
    for p in probs:
        h = F.lit(float(p)) * (n - 1)
        lo, hi = F.floor(h), F.ceil(h)
        at_lo = (F.col("_cnt_before") <= lo) & (lo < F.col("_cnt_upto"))
        at_hi = (F.col("_cnt_before") <= hi) & (hi < F.col("_cnt_upto"))
        tag = _label(p)
        hits.append(at_lo | at_hi)
        pre = pre.withColumns({f"_lo_{tag}": F.when(at_lo, F.col("value")),
                               f"_hi_{tag}": F.when(at_hi, F.col("value")),
                               f"_fr_{tag}": h - lo})
        aggs += [F.max(f"_lo_{tag}").alias(f"_lo_{tag}"), F.max(f"_hi_{tag}").alias(f"_hi_{tag}"),
                 F.max(f"_fr_{tag}").alias(f"_fr_{tag}")]
    keep = hits[0]
    for cond in hits[1:]:
        keep = keep | cond
    picked = pre.filter(keep).groupBy("feature").agg(*aggs)
    return picked.select("feature", *[
        (F.col(f"_lo_{_label(p)}") + F.col(f"_fr_{_label(p)}") * (F.col(f"_hi_{_label(p)}") - F.col(f"_lo_{_label(p)}")))
        .alias(_label(p)) for p in probs])


def feature_summary(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True,
                    probs: Sequence[float] = DEFAULT_PROBS) -> DataFrame:
    """Count, mean, stddev (sample), min, quartiles, max per numeric column (long form).

    ``exact=False`` returns Spark's own ``summary()`` (approximate quartiles, wide form).
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not exact:
        return df.select(*cols).summary()
    long = _long(df, cols)
    moments = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = exact_quantiles(df, cols, probs)
    return moments.join(qs, "feature", "left").select(
        "feature", "count", "mean", "stddev", "min", *[_label(p) for p in probs], "max")


def quantile_value(df: DataFrame, col: str, q: float):
    """Exact linear-interpolation quantile of one column, as a scalar subquery column."""
    return exact_quantiles(df, [col], [q]).select(_label(q)).scalar()


def quantile_flag(df: DataFrame, col: str = "amount", q: float = 0.9, out: str = "is_high_amount") -> DataFrame:
    """1 when ``col`` is above its exact q-quantile (pandas ``quantile`` semantics)."""
    thr = quantile_value(df, col, q)
    return df.withColumn(out, F.when(F.col(col) > thr, 1).otherwise(0))


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of population mean and std per column (``<c>_mean``, ``<c>_std``)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_std")]
    return df.agg(*aggs)


def scale(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """M3: (x - mean) / std with std 0 treated as 1. ``stats`` is the one-row fit, read as a scalar subquery: no job
    while the query is built, no join. (``ml.scale_with`` takes the numbers themselves, for streams.)"""
    fit = F.col("_fit")
    out = {}
    for c in cols:
        std = F.coalesce(F.nullif(fit[f"{c}_std"], F.lit(0.0)), F.lit(1.0))
        out[f"{c}{suffix}"] = (F.col(c).cast("double") - F.coalesce(fit[f"{c}_mean"], F.lit(0.0))) / std
    return df.withColumn("_fit", stats.select(F.struct(*stats.columns)).scalar()).withColumns(out).drop("_fit")

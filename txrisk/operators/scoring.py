"""Scoring (R0, T3, P4, M9, M10): one function for batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import as_of_col, clamp_one


def rule_score_col(amount: str = "amount", is_night: str = "is_night",
                   is_unknown_merchant: str = "is_unknown_merchant",
                   is_foreign_country: str = "is_foreign_country") -> Column:
    """R0 score as a native expression.

    Weights are added in a fixed order (high amount, night, unknown merchant,
    foreign) so the double sums are exactly those of the row-by-row rule, then
    clamped at 1.0.
    """
    score = F.lit(0.0)
    score = score + F.when(F.col(amount) > F.lit(S.HIGH_AMOUNT), F.lit(S.RULE_WEIGHT_HIGH_AMOUNT)).otherwise(F.lit(0.0))
    score = score + F.when(F.col(is_night) == 1, F.lit(S.RULE_WEIGHT_NIGHT)).otherwise(F.lit(0.0))
    score = score + F.when(F.col(is_unknown_merchant) == 1, F.lit(S.RULE_WEIGHT_UNKNOWN_MERCHANT)).otherwise(F.lit(0.0))
    score = score + F.when(F.col(is_foreign_country) == 1, F.lit(S.RULE_WEIGHT_FOREIGN)).otherwise(F.lit(0.0))
    return clamp_one(score)


def rule_score(df: DataFrame, threshold: float = S.RULE_FRAUD_THRESHOLD,
               score_col: str = "fraud_score") -> DataFrame:
    """R0 on any transaction frame: adds the serving features it needs if missing,
    then ``fraud_score``, ``is_fraud`` (strictly above the threshold) and
    ``model_version = 'rule_based'``."""
    from .features import serving_features

    needed = {"is_night", "is_unknown_merchant", "is_foreign_country"}
    if not needed.issubset(df.columns):
        df = serving_features(df)
    return df.withColumns({
        score_col: rule_score_col(),
    }).withColumns({
        "is_fraud": F.col(score_col) > F.lit(threshold),
        "model_version": F.lit(S.RULE_MODEL_VERSION),
    })


def flagged(df: DataFrame) -> DataFrame:
    """Rows scored as fraud."""
    return df.filter(F.col("is_fraud"))


def stamp(df: DataFrame, version: str | Column | None = None, as_of=None) -> DataFrame:
    """``model_version`` and ``detection_time`` (``as_of``, default now)."""
    cols = {"detection_time": as_of_col(as_of)}
    if version is not None:
        cols["model_version"] = version if isinstance(version, Column) else F.lit(version)
    return df.withColumns(cols)


def score(df: DataFrame, model=None, as_of=None) -> DataFrame:
    """Score with a fitted model when given, else with the rules; then stamp.

    ``model`` is a :class:`txrisk.operators.ml.FraudModel` (pipeline + version).
    Works unchanged on a streaming DataFrame.
    """
    if model is None:
        scored = rule_score(df)
    else:
        from .ml import predict

        scored = predict(df, model)
    return stamp(scored, None, as_of)

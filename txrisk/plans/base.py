"""Shared registry for the query modules: ``(spark, sf_dir) -> DataFrame`` plus oracle SQL.

Each query reads the whole given tables (or tables Spark derives from them).
Outputs are typed for comparison: integers as BIGINT, floats rounded to 6
places, money summed as decimal then cast to DOUBLE, timestamps rendered as
'yyyy-MM-dd HH:mm:ss.SSSSSS' strings, dates as 'yyyy-MM-dd'.
Parameters that differ from the operators' defaults are wider windows or lower
thresholds: the given data are sparse (about 14 events per hour at sf0.01).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..operators.scoring import rule_score
from ..sources import tables
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = O.AS_OF
MONTH_END = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.configure(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return deco


# ---------------------------------------------------------------- shared inputs
def tx(spark, d) -> DataFrame:
    return tables.transactions(spark, d)


def scored(spark, d) -> DataFrame:
    return rule_score(tx(spark, d))


def alerts(spark, d, min_score=None) -> DataFrame:
    return tables.alerts_from_scored(scored(spark, d), min_score)


def r6(col) -> F.Column:
    return F.round(F.col(col).cast("double"), 6) if isinstance(col, str) else F.round(col.cast("double"), 6)


def big(col) -> F.Column:
    return (F.col(col) if isinstance(col, str) else col).cast("long")


def by_country_str(col: str = "by_country") -> F.Column:
    return F.array_join(F.transform(F.col(col), lambda s: F.concat_ws(
        ":", s["country"], s["fraud_count"].cast("string"))), ",")


BY_COUNTRY_SQL = "string_agg(country || ':' || CAST(fraud_count AS VARCHAR), ',' ORDER BY fraud_count DESC, country)"



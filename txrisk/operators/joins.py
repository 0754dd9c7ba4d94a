"""Broadcasts behind a measured size.

Where a plan can wait for run time, no hint is given and AQE chooses by the measured size of the
finished side. A hint is only worth a job while a query is built where it keeps a wide side from being shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_BYTES = 32 << 20


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows, by one aggregation (sums of each task, then of the tasks)."""
    size = F.lit(8 * len(df.columns) + 16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
    return df.agg(F.sum(size.cast("bigint")).alias("n")).first()["n"] or 0


def broadcast_measured(small: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``small`` with a broadcast hint if its rows take at most ``max_bytes``; without one beyond that."""
    return F.broadcast(small) if measured_bytes(small) <= max_bytes else small

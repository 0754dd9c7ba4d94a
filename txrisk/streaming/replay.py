"""Replay of stored rows through a streaming operator, with restarts.

The rows go to a source folder slice by slice in the order of time; after each slice the query is started again on the same
checkpoint and stopped when it has read what is there. A closing row far in the future moves the watermark
past all of them, so the last rows come out too. What is left is the operator's output as a table, which equals the
batch operator's where the stream is right.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import interval
from ..session import checkpoint_dir
from .keyed import with_rocksdb

FAR = "10000 days"
CLOSING = "closing row of a replay"


def _drain(rows: DataFrame, out: str, checkpoint: str) -> None:
    def start(_):
        return (rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())

    with_rocksdb(start)(rows.sparkSession).awaitTermination()


def _slices(df: DataFrame, ts: str, cuts: list[str]) -> list[DataFrame]:
    t = F.col(ts)
    edges = [None, *[F.lit(c).cast("timestamp") for c in cuts], None]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        cond = F.lit(True) if lo is None else t > lo
        cond = cond if hi is None else cond & (t <= hi)
        out.append(df.filter(F.coalesce(cond, F.lit(lo is None))))
    values = {T.StringType(): F.lit(CLOSING), T.BooleanType(): F.lit(True)}       # what filters and joins let pass
    closing = [((F.col("m") + interval(FAR)) if f.name == ts else values.get(f.dataType, F.lit(None))).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    out[-1] = out[-1].unionByName(df.agg(F.max(t).alias("m")).select(*closing))
    return out


def replayed(df: DataFrame | list[DataFrame], operator, ts: str | list[str], cuts: list[str], folder: str | None = None) -> DataFrame:
    """The rows that ``operator`` (stream -> stream) puts out for ``df``, fed in slices that end at the times ``cuts``; with
    lists of inputs and time columns the operator takes as many streams.

    The closing row of each input is ``FAR`` after its newest one, with ``CLOSING`` in its text columns; operators see it, and what they put
    out for it is left out (rows with that text). Rows without a time are fed with the first slice. ``folder`` is a new folder in shared storage."""
    inputs, times = (df, ts) if isinstance(df, list) else ([df], [ts])
    spark = inputs[0].sparkSession
    root = folder or f"{checkpoint_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    fed = [_slices(x, t, cuts) for x, t in zip(inputs, times, strict=True)]
    for i in range(len(cuts) + 1):
        for k, parts in enumerate(fed):
            parts[i].write.parquet(f"{root}/in{k}/slice={i}")
        streams = [spark.readStream.schema(x.schema).parquet(f"{root}/in{k}/slice=*") for k, x in enumerate(inputs)]
        _drain(operator(*streams), f"{root}/out", f"{root}/checkpoint")
    out = spark.read.parquet(f"{root}/out")
    ours = [~F.coalesce(F.col(f.name) == CLOSING, F.lit(False)) for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
    return out.filter(reduce(lambda a, b: a & b, ours)) if ours else out

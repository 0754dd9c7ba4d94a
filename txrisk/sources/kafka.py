"""Message sources (S1, S2, P1): Kafka topics and JSON message decoding.

The Kafka connector jar (``spark-sql-kafka-0-10``) must be on the classpath of
the cluster; the decoding below is connector-independent and is what the
tests exercise, with file sources carrying the same JSON messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


def read_kafka(spark: SparkSession, brokers: str, topic: str, starting: str = "latest",
               max_offsets_per_trigger: int | None = None) -> DataFrame:
    """A streaming frame over one Kafka topic (binary key / value + metadata)."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", brokers)
              .option("subscribe", topic)
              .option("startingOffsets", starting)
              .option("failOnDataLoss", "true"))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    return reader.load()


def parse_messages(df: DataFrame, schema: T.StructType = S.TRANSACTION_MESSAGE, keep_raw: bool = False) -> DataFrame:
    """S2 + P1 + F22: ``value`` bytes -> UTF-8 string -> typed struct (``from_json``) -> top-level columns.

    Malformed JSON yields a row of NULLs (``from_json`` does not enforce
    nullability); route those with ``quality.split_valid``.
    """
    parsed = df.select(F.from_json(F.col("value").cast("string"), schema).alias("data"),
                       *([F.col("value").cast("string").alias("raw")] if keep_raw else []))
    return parsed.select("data.*", *(["raw"] if keep_raw else []))


def to_messages(tx: DataFrame, key: str = "transaction_id") -> DataFrame:
    """The inverse of :func:`parse_messages`: (key, value) JSON messages as a producer
    writes them (time as an ISO-8601 string without zone)."""
    cols = [c.name for c in S.TRANSACTION_MESSAGE.fields if c.name in tx.columns]
    body = tx.select(*[
        F.date_format("transaction_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("transaction_time")
        if c == "transaction_time" else F.col(c) for c in cols])
    return body.select(F.col(key).cast("binary").alias("key"),
                       F.to_json(F.struct(*body.columns)).cast("binary").alias("value"))


def write_kafka(messages: DataFrame, brokers: str, topic: str) -> None:
    """Batch write of (key, value) messages to a topic."""
    (messages.write.format("kafka").option("kafka.bootstrap.servers", brokers)
     .option("topic", topic).save())

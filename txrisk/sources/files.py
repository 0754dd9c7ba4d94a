"""File sources and sinks (S3, S4) with explicit schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S


def read_history_csv(spark: SparkSession, path: str, schema=S.HISTORICAL_TRANSACTION) -> DataFrame:
    """S3: historical transactions from CSV with a header, explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_features(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Feature table as Parquet, overwrite; optionally partitioned (e.g. by date)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def read_messages_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """JSON message files as a stream: the file-based stand-in for a topic (one JSON per line).

    Returns a frame with a binary ``value`` column like the Kafka source, so
    the same ``parse_messages`` applies."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path).selectExpr("CAST(value AS BINARY) AS value")

"""Training-corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes it as Parquet to the
shared checkpoint folder and reads it back as the next stage's ``docs``. All but the last keep the columns
of ``documents`` (``n_chars`` follows the text). Stages work on all rows that their predecessor kept.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import bpe, decontam, lines, neardup, quality
from txrisk.llm.learn import remainder
from txrisk.llm.runtime import ready, saved, shuffle_partitions


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under 0.5 go. Null texts count as empty."""
    ready(spark)
    machine = quality.fit(docs, _table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1))
    return quality.keep_good(docs, machine)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a site (``source``) go; every document stays, null texts stay null."""
    ready(spark)
    return _measured(lines.drop_boilerplate(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest id; documents without words or id stay."""
    ready(spark)
    gone = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    # dealt by id at every size, rather than only where the ids are too many to broadcast
    by_id = docs.repartition(shuffle_partitions(spark), "doc_id")
    return by_id.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of which they are more than half the words goes."""
    ready(spark)
    return _measured(decontam.clean(docs, _table(spark, sf_dir, "benchmark")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ready(spark)
    return bpe.round_trip(bpe.encode(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

# The quality classifier is a trained model, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    ready(spark)
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name}")
    return docs

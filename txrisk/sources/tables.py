"""Relational tables (S10) and the mapping of the given parquet tables onto them.

``transactions`` and ``fraud_alerts`` are derived from the ``events`` table with
pure projections (no shuffle), so they scale with the input and keep Parquet
column pruning / filter pushdown on the underlying scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import score_decimal

# FIXED VALUES: how event types map onto transaction types ("refund" is a
# category the scoring model never saw).
EVENT_TO_TRANSACTION_TYPE = {
    "purchase": "purchase",
    "view": "payment",
    "click": "transfer",
    "signup": "withdrawal",
    "error": "refund",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table (Parquet). JDBC sources use ``spark.read.format('jdbc')`` the same way."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Rows that one task of a join or an aggregation over many groups is to hold.
ROWS_PER_TASK = 1_000_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """As many partitions as the session says, and more where one would hold over ROWS_PER_TASK rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // ROWS_PER_TASK))


def dealt(df: DataFrame, partitions: int, *keys) -> DataFrame:
    """``df`` dealt by ``keys``, where that takes more partitions than the session says."""
    few = partitions <= partitions_for(df.sparkSession, 0)
    return df if few else df.repartition(partitions, *keys)


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) for small files and listings on any file system that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def read_table_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing was written yet. Any other fault is raised: an unreadable table is
    not an empty one."""
    folder, fs = hadoop_path(spark, path)
    if not fs.exists(folder):
        return None
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int = 64) -> DataFrame:
    """S10 for a relational database: a JDBC table read in ``num_partitions`` parallel
    range slices of ``partition_column`` (a numeric / date column), so no single task
    pulls the whole table. Filters and projections are pushed into the database query."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", str(lower))
                  .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None, mode: str = "append",
               num_partitions: int = 32, batch_size: int = 10_000) -> None:
    """S5/S6 into a relational database: batched inserts from at most ``num_partitions``
    parallel connections (bounded load on the database)."""
    # repartition, not coalesce: the stages before keep their own parallelism
    writer = (df.repartition(num_partitions).write.format("jdbc").mode(mode).option("url", url)
              .option("dbtable", table).option("batchsize", str(batch_size)))
    for k, v in (properties or {}).items():
        writer = writer.option(k, v)
    writer.save()


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + F.lit(1)).cast("int"))


def transactions_from_events(events: DataFrame) -> DataFrame:
    """Typed transaction rows from ``events`` (one row per event, narrow projection)."""
    k = F.from_json("props", "k int")["k"]
    value10 = F.col("value") * F.lit(10.0)
    etype = F.col("event_type")
    ttype = F.lit(None).cast("string")
    for src, dst in EVENT_TO_TRANSACTION_TYPE.items():
        ttype = F.when(etype == src, F.lit(dst)).otherwise(ttype)
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.concat(F.lit("TXN_"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.concat(F.lit("USER_"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("user_id"),
        F.round(value10, 2).alias("amount"),
        _pick(S.CURRENCIES, F.pmod(F.col("event_id"), F.lit(3))).alias("currency"),
        _pick(S.MERCHANTS, F.pmod(k, F.lit(17))).alias("merchant"),
        ts.alias("transaction_time"),
        _pick(S.COUNTRIES, F.pmod(k, F.lit(6))).alias("country"),
        ttype.alias("transaction_type"),
        (((value10 > 1000) & (F.pmod(k, F.lit(17)) >= 14)) | (F.pmod(F.col("event_id"), F.lit(97)) == 0))
        .alias("is_fraud_actual"),
        ts.alias("created_at"),
        F.col("event_id"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(read_table(spark, sf_dir, "events"))


def alerts_from_scored(scored: DataFrame, min_score: float | None = None) -> DataFrame:
    """The ``fraud_alerts`` table from rule-scored transactions.

    Default: flagged rows (score > 0.7). ``min_score`` gives the dense variant
    (score >= min_score) used to exercise thresholds and per-user counts.
    Review status cycles deterministically by event id; detection is one second
    after the transaction.
    """
    cond = F.col("is_fraud") if min_score is None else (F.col("fraud_score") >= F.lit(min_score))
    return scored.filter(cond).select(
        "transaction_id", "user_id", "amount", "merchant",
        "fraud_score",
        F.lit(True).alias("is_fraud"),
        F.col("model_version"),
        (F.col("transaction_time") + F.expr("INTERVAL '1' SECOND")).alias("detection_time"),
        "transaction_time",
        _pick(S.ALERT_STATUSES, F.pmod(F.col("event_id"), F.lit(3))).alias("alert_status"),
        "event_id",
    )


def fraud_alerts(spark: SparkSession, sf_dir: str, min_score: float | None = None) -> DataFrame:
    from ..operators.scoring import rule_score

    return alerts_from_scored(rule_score(transactions(spark, sf_dir)), min_score)


def stored_alerts(alerts: DataFrame) -> DataFrame:
    """Alert rows with the table's types: amount decimal(15,2), score decimal(5,4)."""
    return alerts.withColumns({
        "amount": F.col("amount").cast("decimal(15,2)"),
        "fraud_score": score_decimal("fraud_score"),
    })


def transactions_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger input: one transaction per line item.

    Join order is explicit (Catalyst does not reorder joins without CBO
    statistics): orders are first enriched with customer and nation (the
    smaller side), so the largest table, lineitem, is shuffled once, by
    order key, and where it is large once more, by supplier. Dimension sides are left to the planner / AQE, which broadcasts
    them when their measured size is small. (l_orderkey, l_linenumber) is not
    unique in the given data, so the transaction id is not unique either; see
    ``quality.duplicates`` / ``dedupe``.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    su = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    buyers = (od.join(cu, od.o_custkey == cu.c_custkey)
              .join(na, F.col("c_nationkey") == na.n_nationkey)
              .select("o_orderkey", "o_custkey", "n_name"))
    # the row count comes from the file footers; the memory of a task does not grow with the input
    parts = partitions_for(spark, li.count())
    j = dealt(li, parts, "l_orderkey").join(buyers, li.l_orderkey == buyers.o_orderkey)
    j = dealt(j, parts, "l_suppkey").join(su, F.col("l_suppkey") == su.s_suppkey)
    ts = F.col("l_shipdate").cast("timestamp")
    return j.select(
        F.concat_ws("_", F.lit("TXN"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.concat(F.lit("USER_"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("l_extendedprice").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("s_name").alias("merchant"),
        ts.alias("transaction_time"),
        F.col("n_name").alias("country"),
        F.lit("purchase").alias("transaction_type"),
        ts.alias("created_at"),
    )

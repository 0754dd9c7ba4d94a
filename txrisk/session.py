"""Session helpers: time zone, shared checkpoint folder, local sessions for tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every query relies on. They are session-level SQL confs, so they can
# be applied to a session someone else created (the driver passes its own).
QUERY_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session confs the operators assume (UTC wall clock, AQE)."""
    for key, value in QUERY_CONF.items():
        spark.conf.set(key, value)
    return spark


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20, max_partitions: int = 100_000) -> dict:
    """Partition sizing for a large input (e.g. ~100 TB on ~1000 executors).

    Scan splits and shuffle partitions are sized to ~``target_partition_bytes``
    so each task's data fits in executor memory (sorts and windows spill beyond
    that); AQE starts from that many shuffle partitions, coalesces small ones
    and splits skewed ones at runtime. Broadcasts stay small.
    """
    shuffle = max(200, min(max_partitions, input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(16 << 20),
    }


def configure_for_scale(spark: SparkSession, input_bytes: int, **kw) -> SparkSession:
    """Apply :func:`configure` plus :func:`scale_conf` (session-level SQL confs only)."""
    configure(spark)
    for key, value in scale_conf(input_bytes, **kw).items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster, as ``spark.checkpoint.dir`` names it.

    On a cluster the setting must be there and name shared storage; without it this raises. Only a local
    master (tests, one machine) gets a folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = os.path.join(os.environ.get("TMPDIR", "/tmp"), "txrisk-checkpoints")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "txrisk") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    checkpoint_dir(spark)
    return spark

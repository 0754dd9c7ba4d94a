"""Model registry as tables.

The registry is a ``model_performance`` table; every change produces a new snapshot DataFrame instead of updating rows in place.
Snapshots are committed optimistically: a writer names the snapshot it has read, and loses to one that was faster.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import as_of_col
from ..sources.tables import hadoop_path


def create_file(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file that is not there yet, whole: the content goes to a file of its own, which a link or rename that
    replaces nothing gives its name; False where another writer has made it.

    A file context's rename without overwriting is atomic on HDFS and local disks, and by conditional puts on object stores
    whose connector offers them."""
    jvm = spark._jvm
    target, fs = hadoop_path(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = getattr(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), "NONE")
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = plain
    try:
        context.rename(draft, target, options)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
            raise
        fs.delete(draft, False)
        return False


def commit_numbers(spark: SparkSession, path: str) -> list[int]:
    folder, fs = hadoop_path(spark, f"{path}/_commits")
    if not fs.exists(folder):
        return []
    return sorted(int(n) for n in (x.getPath().getName() for x in fs.listStatus(folder)) if re.fullmatch(r"\d+", n))


def read_registry(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The registry: its newest committed snapshot, or that of ``version``; no rows where none was committed yet. A snapshot that
    cannot be read is an error."""
    version = registry_version(spark, path) if version is None else version
    if not version:
        return spark.createDataFrame([], S.MODEL_PERFORMANCE)
    data = spark.read.text(f"{path}/_commits/{version:09d}").first()["value"]
    return spark.read.parquet(f"{path}/{data}")


class RegistryConflict(Exception):
    """Another writer has committed the snapshot number that this one was made for."""


def registry_version(spark: SparkSession, path: str) -> int:
    """Number of the newest committed snapshot, 0 where there is none."""
    numbers = commit_numbers(spark, path)
    return max(numbers) if numbers else 0


def write_registry(models: DataFrame, path: str, read_version: int) -> int:
    """Commit ``models`` as the snapshot after ``read_version``, the one it was made from; the new number.

    The rows are written first, to a folder of their own. The commit is one file named by the number, created only if it is not
    there: of two writers that read the same snapshot one gets it, the other raises :class:`RegistryConflict` and changes
    nothing. A writer lost before the commit leaves a folder that no commit names."""
    spark = models.sparkSession
    number, data = read_version + 1, f"data-{uuid.uuid4().hex}"
    if registry_version(spark, path) != read_version:
        raise RegistryConflict(f"snapshot {number} of {path} is taken")
    models.write.parquet(f"{path}/{data}")
    if not create_file(spark, f"{path}/_commits/{number:09d}", data):
        raise RegistryConflict(f"snapshot {number} of {path} is taken")
    return number


def change_registry(spark: SparkSession, path: str, change, attempts: int = 20) -> DataFrame:
    """``change`` (registry -> new registry) applied to the newest snapshot and committed; where another writer was faster, applied
    anew to what that one left. Changes of concurrent writers are all kept. The committed registry."""
    for _ in range(attempts):
        version = registry_version(spark, path)
        try:
            return read_registry(spark, path, write_registry(change(read_registry(spark, path, version)), path, version))
        except RegistryConflict:
            continue
    raise RegistryConflict(f"{path} was changed by others {attempts} times in a row")


def read_model_info(spark: SparkSession, pattern: str) -> DataFrame:
    """S11 + F22: model metadata JSON files (one per model directory) with their path."""
    return (spark.read.schema(S.MODEL_INFO).option("multiLine", True).json(pattern)
            .withColumn("path", F.input_file_name()))


def info_to_performance(infos: DataFrame, as_of=None, dataset_size: str | None = None) -> DataFrame:
    """G1: metadata rows -> ``model_performance`` rows, inactive, created at ``as_of``."""
    m = F.col("metrics")
    return infos.select(
        F.col("version").alias("model_version"),
        m["accuracy"].cast("decimal(5,4)").alias("accuracy"),
        m["precision"].cast("decimal(5,4)").alias("precision_score"),
        m["recall"].cast("decimal(5,4)").alias("recall"),
        m["f1_score"].cast("decimal(5,4)").alias("f1_score"),
        F.try_to_timestamp(F.col("training_date")).alias("training_date"),
        (F.col(dataset_size).cast("int") if dataset_size else F.lit(None).cast("int")).alias("dataset_size"),
        F.to_json(m["feature_importance"]).alias("feature_importance"),
        F.to_json(F.struct(F.col("model_type").alias("model_type"))).alias("hyperparameters"),
        F.lit(False).alias("is_active"),
        as_of_col(as_of).alias("created_at"),
    )


def register_model(models: DataFrame, infos: DataFrame, as_of=None, dataset_size: str | None = None) -> DataFrame:
    """G1: the registry with the new models appended (inactive)."""
    return models.unionByName(info_to_performance(infos, as_of, dataset_size))


def registration_audit(infos: DataFrame, as_of=None) -> DataFrame:
    """S13 rows for G1: MODEL_REGISTERED with the metadata as JSON."""
    return infos.select(
        F.lit(S.AUDIT_MODEL_REGISTERED[0]).alias("event_type"),
        F.format_string(S.AUDIT_MODEL_REGISTERED[1], F.col("version")).alias("event_description"),
        F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("transaction_id"),
        F.col("version").alias("model_version"),
        F.to_json(F.struct(*[c for c in infos.columns if c != "path"])).alias("metadata"),
        as_of_col(as_of).alias("created_at"))


def activate_model(models: DataFrame, version: str | Column) -> DataFrame:
    """A registry snapshot where exactly the rows of ``version`` (a value, or a scalar column) are active."""
    return models.withColumn("is_active", F.col("model_version") == (version if isinstance(version, Column) else F.lit(version)))


def activation_audit(spark_df: DataFrame, version: str, as_of=None) -> DataFrame:
    """S13 row for G2 (MODEL_ACTIVATED), derived from the registry it applies to."""
    return spark_df.filter(F.col("model_version") == F.lit(version)).limit(1).select(
        F.lit(S.AUDIT_MODEL_ACTIVATED[0]).alias("event_type"),
        F.lit(S.AUDIT_MODEL_ACTIVATED[1] % version).alias("event_description"),
        F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("transaction_id"),
        F.lit(version).alias("model_version"), F.lit(None).cast("string").alias("metadata"),
        as_of_col(as_of).alias("created_at"))


def list_models(models: DataFrame) -> DataFrame:
    """Models newest first."""
    return (models.select("model_version", "accuracy", "precision_score", "recall", "f1_score",
                          "training_date", "is_active", "created_at")
            .orderBy(F.col("created_at").desc(), F.col("model_version").desc()))


def active_model(models: DataFrame, full: bool = False) -> DataFrame:
    """The newest active model (at most one row). ``full`` adds training_date,
    dataset_size, is_active and created_at (the dashboard's model-performance record)."""
    cols = ["model_version", "accuracy", "precision_score", "recall", "f1_score"]
    if full:
        cols += ["training_date", "dataset_size", "is_active", "created_at"]
    return (models.filter(F.col("is_active"))
            .orderBy(F.col("created_at").desc(), F.col("model_version").desc()).limit(1)
            .select(*cols))


def newest_model(infos: DataFrame, order_col: str = "training_date") -> DataFrame:
    """The newest model directory by training time (not by name)."""
    return infos.agg(F.max_by(F.struct(*infos.columns), F.col(order_col)).alias("m")).select("m.*")


def latest_per_key(df: DataFrame, keys: list[str], order_col: str, tiebreak: list[str] | None = None) -> DataFrame:
    """Newest row per key (row_number = 1, ties broken by ``tiebreak`` descending).

    Spark plans this as a WindowGroupLimit before and after the shuffle, so
    each map task forwards at most one row per key: a hot key costs nothing extra."""
    order = [F.col(order_col).desc()] + [F.col(c).desc() for c in (tiebreak or [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def performance_row(spark: SparkSession, model, dataset_size: int | None = None, as_of=None) -> DataFrame:
    """G1 for a freshly trained model: one ``model_performance`` row (inactive)."""
    m = model.metrics
    row = (model.version, m.get("accuracy"), m.get("precision"), m.get("recall"), m.get("f1_score"),
           model.training_date, dataset_size, json.dumps(m.get("feature_importance", {})),
           json.dumps({"model_type": model.model_type}))
    df = spark.createDataFrame([row], "model_version string, accuracy double, precision_score double, "
                                      "recall double, f1_score double, training_date string, dataset_size int, "
                                      "feature_importance string, hyperparameters string")
    return df.select(
        "model_version", *[F.col(c).cast("decimal(5,4)").alias(c) for c in
                           ("accuracy", "precision_score", "recall", "f1_score")],
        F.try_to_timestamp("training_date").alias("training_date"), "dataset_size",
        "feature_importance", "hyperparameters", F.lit(False).alias("is_active"),
        as_of_col(as_of).alias("created_at"))


def evaluation_registry(scored: DataFrame, label: str, prediction: str, period: str = "day",
                        time_col: str = "transaction_time", prefix: str = "rule_based_") -> DataFrame:
    """Registry rows from periodic evaluations of a deployed scorer: one version per period
    (``rule_based_<yyyyMMdd>``), metrics M11 over that period's labelled rows."""
    from .ml import binary_metrics

    fmt = {"day": "yyyyMMdd", "hour": "yyyyMMdd_HH", "month": "yyyyMM"}[period]
    p = F.date_trunc(period, F.col(time_col))
    m = binary_metrics(scored.withColumn("_period", p), label, prediction, ["_period"])
    return m.select(
        F.concat(F.lit(prefix), F.date_format("_period", fmt)).alias("model_version"),
        F.col("accuracy").cast("decimal(5,4)").alias("accuracy"),
        F.col("precision").cast("decimal(5,4)").alias("precision_score"),
        F.col("recall").cast("decimal(5,4)").alias("recall"),
        F.col("f1_score").cast("decimal(5,4)").alias("f1_score"),
        F.col("_period").alias("training_date"),
        F.col("n").cast("int").alias("dataset_size"),
        F.lit("{}").alias("feature_importance"),
        F.to_json(F.struct(F.lit("rule_based").alias("model_type"))).alias("hyperparameters"),
        F.lit(False).alias("is_active"),
        (F.col("_period") + F.expr("INTERVAL '1' DAY")).alias("created_at"),
    )

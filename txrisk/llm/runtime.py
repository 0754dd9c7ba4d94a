"""Session helpers of the subpackage: code on the workers, tables in the shared folder, batch output."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, configure

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows of an Arrow batch: of whole texts, so that a worker holds some megabytes at a time.
BATCH_ROWS = 2000


def ready(spark: SparkSession) -> SparkSession:
    """Session confs plus this repository on the Python path of the workers (one-machine runs;
    on a cluster the package is installed or shipped with ``--py-files``)."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *[p for p in paths if p]])
    return spark


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back: lineage is cut,
    later plans see the real size, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


class Out:
    """Rows gathered column by column, handed on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, max_rows: int = 4096, max_bytes: int = 16 << 20):
        self.schema, self.max_rows, self.max_bytes = schema, max_rows, max_bytes
        self._clear()

    def _clear(self):
        self.cols = [[] for _ in self.schema]
        self.rows = self.bytes = 0

    def add(self, *values, size: int = 0):
        for col, v in zip(self.cols, values, strict=True):
            col.append(v)
        self.rows += 1
        self.bytes += size

    @property
    def full(self) -> bool:
        return self.rows >= self.max_rows or self.bytes >= self.max_bytes

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(self.cols, self.schema, strict=True)],
                                           schema=self.schema)
        self._clear()
        return batch

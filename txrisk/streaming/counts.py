"""Per-user history counts kept up to date by a stream.

Each micro-batch leaves its counts under (run, batch id) with dynamic overwrite, so a replayed batch replaces its own. A reader
adds the newest base, which holds one row a user, and the batches behind it. ``compact`` makes the next base from what
a reader sees and commits it as one small file that names the base and the last batch of each run that it covers; the file is created only if no
other compaction took its number. Batches that the base covers are not read any more and are removed one
compaction later, when no reader that started before can need them. So a read is bounded by the users and the batches
since the last compaction, not by all batches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import commit_numbers, create_file
from ..sources.tables import hadoop_path

_SCHEMA = "user_id string, n bigint"


def add_batch(rows: DataFrame, path: str, own: tuple[str, int], key: str = "user_id") -> None:
    """The counts of one micro-batch; written again, it replaces its earlier attempt."""
    counts = rows.groupBy(F.col(key).cast("string").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/batches/{own[0]}/{own[1]}")


def _state(spark: SparkSession, path: str) -> dict:
    numbers = commit_numbers(spark, path)
    if not numbers:
        return {"number": 0, "base": None, "covered": {}}
    text = spark.read.text(f"{path}/_commits/{numbers[-1]:09d}").first()["value"]
    return {"number": numbers[-1], **json.loads(text)}


def _batches(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the complete batches of each run."""
    folder, fs = hadoop_path(spark, f"{path}/batches")
    out: dict[str, list[int]] = {}
    for run in fs.listStatus(folder) if fs.exists(folder) else []:
        for batch in fs.listStatus(run.getPath()):
            if fs.exists(hadoop_path(spark, f"{batch.getPath().toString()}/_SUCCESS")[0]):
                out.setdefault(run.getPath().getName(), []).append(int(batch.getPath().getName()))
    return {r: sorted(n) for r, n in out.items()}


def _sum(spark: SparkSession, path: str, base: str | None, batches: list[str]) -> DataFrame:
    parts = ([f"{path}/{base}"] if base else []) + [f"{path}/batches/{b}" for b in batches]
    rows = spark.read.schema(_SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], _SCHEMA)
    return rows.groupBy("user_id").agg(F.sum("n").alias("n"))


def user_frequency(spark: SparkSession, path: str, before: tuple[str, int] | None = None) -> DataFrame:
    """``user_id, user_frequency`` over all batches so far, as ``features.user_frequency_table`` of their rows; ``before`` (run, batch id) leaves
    out that batch and later ones of its run, for a batch that is worked on again."""
    state = _state(spark, path)
    wanted = [f"{run}/{n}" for run, numbers in _batches(spark, path).items() for n in numbers
              if n > state["covered"].get(run, -1) and not (before and run == before[0] and n >= before[1])]
    return _sum(spark, path, state["base"], wanted).select("user_id", F.col("n").cast("int").alias("user_frequency"))


def compact(spark: SparkSession, path: str, before: tuple[str, int]) -> bool:
    """Fold the batches of ``before[0]`` under number ``before[1]`` (those that can no longer be replayed, as a later one runs) into a new base.
    False where another compaction was faster; nothing changes then."""
    state = _state(spark, path)
    mine = [n for n in _batches(spark, path).get(before[0], []) if state["covered"].get(before[0], -1) < n < before[1]]
    if not mine:
        return True
    base = f"base-{uuid.uuid4().hex}"
    _sum(spark, path, state["base"], [f"{before[0]}/{n}" for n in mine]).write.parquet(f"{path}/{base}")
    covered = {**state["covered"], before[0]: mine[-1]}
    if not create_file(spark, f"{path}/_commits/{state['number'] + 1:09d}", json.dumps({"base": base, "covered": covered, "last": state["base"]})):
        return False
    # what the compaction before this one had already made needless
    if state["number"]:
        for run, numbers in _batches(spark, path).items():
            for n in numbers:
                if n <= state["covered"].get(run, -1):
                    old, fs = hadoop_path(spark, f"{path}/batches/{run}/{n}")
                    fs.delete(old, True)
        if state.get("last"):
            old, fs = hadoop_path(spark, f"{path}/{state['last']}")
            fs.delete(old, True)
    return True

"""What the three classifiers share: the rule for held-out rows, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: null)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds))


def share(id_col: str, salt: int = 0) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def counts(df: DataFrame, label: str) -> dict:
    """Rows of each label; labels are few (a language, a class)."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def sample(df: DataFrame, id_col: str, label: str, per_label: int, n: dict, salt: int = 1) -> DataFrame:
    """About ``per_label`` rows of each label (all, where there are fewer), chosen by id alone; column ``weight``
    is the number of rows that a chosen row stands for."""
    if not n:
        return df.withColumn("weight", F.lit(1.0)).limit(0)
    part = F.lit(0.0)
    for value, rows in n.items():
        part = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / rows))).otherwise(part)
    return df.withColumn("_part", part).filter(share(id_col, salt) < F.col("_part")).withColumn(
        "weight", 1.0 / F.col("_part")).drop("_part")


def labelled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a :func:`sample` of labels (``id``, ``label``, ``weight``) chose. A sample of two
    labels has at most about 2 * per_label small rows, so it is broadcast and no text is shuffled."""
    return docs.join(F.broadcast(chosen), "id")

"""Connected components by alternating large-star and small-star steps.

Edges are rewired towards smaller neighbours until every vertex hangs on the smallest of its
component. Each step is a grouped minimum (folded before the shuffle) and a join that AQE may
split, so one vertex with a third of all edges is no obstacle. Steps are written to the shared
folder, the driver only learns whether all are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import saved


def _toward_min(edges: DataFrame) -> DataFrame:
    """(u, v) neighbours -> every neighbour v of u linked with the smallest among u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u").select("u", "v", "m")


def _downward(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _stars(edges: DataFrame) -> bool:
    """Whether distinct downward edges are stars: every vertex has one edge down, or is the foot of others."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("foot")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("foot")))
    odd = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("foot").alias("foot")).filter("down + foot > 1")
    return odd.isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` (the smallest reachable id) of every vertex that has an edge to another one.

    Edges with a null end and loops are ignored; repeated edges count once.
    """
    now = saved(_downward(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_min(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = _toward_min(_downward(large))         # here v < u throughout: m is the smallest neighbour
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        now = saved(_downward(small).distinct(), "edges")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)

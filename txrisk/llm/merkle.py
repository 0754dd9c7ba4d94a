"""Merkle manifest of a table, by sibling-shift self-joins.

Every row is a leaf: the hash of its fields. The leaves of a group (one tree a group) are numbered by key,
and each level is an equijoin of the nodes with themselves on computed sibling indices: ``pos XOR 1`` in a binary tree,
``base + (slot + shift) % arity`` for the shifts 1 .. arity - 1 otherwise. After it each node holds its siblings
to the left and to the right, which is its part of a proof, and the nodes of slot zero emit the parents. The roots of the groups
are the leaves of one more tree, built alike.

Only digests travel: texts are hashed where they are read. Positions come from a range partitioning by
(group, key) with an offset for each partition, so a group with a third of all rows is spread like the rest. Each level is
written to the shared folder; the driver learns one number a tree stage, the node count of the largest group, which sets the number of
levels (its logarithm). Proofs are put together from the top down: a node's path is its own siblings and its parent's path, so
the work is a geometric series and only the last join has all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import saved, shuffle_partitions

ARITY = 8


def digest(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*texts), 256)


def field(value: Column) -> Column:
    """A field as hashed in a leaf: `-` for null, else its UTF-8 byte count, `:` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def group_key(group: Column) -> Column:
    """The group as text that sorts bytewise with null first and joins null with null."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (column ``tree``) with ``pos`` (from 0 by ``order`` within the tree) and ``n`` (rows of the tree), written once.

    Rows equal in ``order`` take any of their positions; they are told apart by a drawn number in the range
    partitioning, so that many of them do not fall to one task.
    """
    parts = shuffle_partitions(rows.sparkSession)
    ranged = saved(rows.withColumn("tie", F.rand(7)).repartitionByRange(parts, "tree", *order, "tie").withColumn("part", F.spark_partition_id()), "ranged")
    # at most a row for each partition and each tree
    sizes = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("tree", "part", (F.sum("rows").over(Window.partitionBy("tree").orderBy("part")) - F.col("rows")).alias("skip"),
                          F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*[F.asc_nulls_first(c) for c in order], "tie"))
    return saved(ranged.withColumn("place", place).join(before, ["tree", "part"])
                 .withColumn("pos", F.col("skip") + F.col("place") - 1).drop("tie", "part", "place", "skip"), "leaves")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes of one level with the joined digests of their siblings, ``left`` and ``right`` of them."""
    slot = F.pmod("pos", F.lit(arity))
    if arity == 2:
        reached = F.array(F.col("pos").bitwiseXOR(F.lit(1)))
    else:
        shifts = F.sequence(F.lit(1), F.lit(arity - 1))
        reached = F.transform(shifts, lambda s: F.col("pos") - slot + F.pmod(slot + s, F.lit(arity)))
    sent = nodes.select("tree", F.explode(reached).alias("pos"), F.struct(slot.alias("slot"), "digest").alias("sib")).groupBy("tree", "pos").agg(
        F.array_sort(F.collect_list("sib")).alias("sibs"))                       # at most arity - 1
    side = lambda keep: F.coalesce(F.array_join(F.transform(F.filter("sibs", keep), lambda s: s["digest"]), ""), F.lit(""))
    return nodes.join(sent, ["tree", "pos"], "left").select(
        "*", side(lambda s: s["slot"] < slot).alias("left"), side(lambda s: s["slot"] > slot).alias("right")).drop("sibs")


def levels(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The levels of all trees from the leaves up: ``tree, pos, n, digest, left, right`` (the leaves keep their other columns).

    A node of ``n = 1`` is the root of its tree, without siblings; the last level holds nothing but roots.
    """
    out, nodes = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = saved(_with_siblings(nodes.filter("n > 1"), arity).unionByName(
            nodes.filter("n = 1").withColumns({"left": F.lit(""), "right": F.lit("")})), "level")
        out.append(level)
        nodes = level.filter((F.pmod("pos", F.lit(arity)) == 0) & (F.col("n") > 1)).select(
            "tree", F.floor(F.col("pos") / arity).alias("pos"), F.ceil(F.col("n") / arity).alias("n"), digest("digest", "right").alias("digest"))
        most = -(-most // arity)
    return [*out, nodes.withColumns({"left": F.lit(""), "right": F.lit("")})]


def roots(stack: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of every tree's root."""
    return reduce(DataFrame.unionByName, [x.filter("n = 1").select("tree", "digest") for x in stack])


def paths(stack: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with ``path``: the siblings (left, right) of the leaf and of each node over it, and then ``path`` of its tree
    in ``above`` (columns ``tree, path`` and others that are handed down)."""
    carried = [c for c in above.columns if c not in ("tree", "path")]
    upper = None
    for level in reversed(stack):
        top = level.filter("n = 1").join(above, "tree")
        here = F.array(F.struct("left", "right"))
        if upper is not None:
            over = upper.select("tree", F.col("pos").alias("over"), "path", *carried)
            lower = level.filter("n > 1").withColumn("over", F.floor(F.col("pos") / arity))
            top = lower.join(over, ["tree", "over"]).withColumn("path", F.concat(here, "path")).drop("over").unionByName(top)
        upper = top
    return upper.drop("left", "right")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(df: DataFrame, fields: list[str], key: str, group: str, arity: int = ARITY, probe: Column | None = None) -> DataFrame:
    """``key, leaf, probe, subroot, root, path`` for every row of ``df``.

    ``leaf`` hashes ``fields`` (see :func:`field`; nulls are `-`). The leaves of a group ascend by ``key`` (null first),
    then by leaf; while a tree has several nodes, every ``arity`` consecutive ones (the last run may be shorter, even one node)
    become the hash of their digests. What remains is ``subroot``; a group of one row has its leaf. The subroots,
    ordered by group (null first, then bytewise), give ``root`` in the same way. ``path`` holds the siblings
    (left, right) of each level from the leaf to the root; ``probe`` is an expression over ``df`` evaluated beside the leaf, to be
    held against the path later. Repeated rows are leaves of their own; very long texts are hashed where they are read; an empty table gives
    an empty table. Other columns are left out, whatever their names.
    """
    made = leaf(*[F.col(c) for c in fields])
    rows = df.select(group_key(F.col(group)).alias("tree"), F.col(key).alias("key"), made.alias("digest"), (made if probe is None else probe).alias("probe"))
    stack = levels(numbered(rows, "key", "digest"), arity)
    subroots = roots(stack)
    top = levels(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "group"), arity)
    root = roots(top).select("tree", F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"), F.col("digest").alias("root"))
    above = saved(paths(top, root, arity).select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "above")
    return paths(stack, above, arity).select(F.col("key").alias(key), F.col("digest").alias("leaf"), "probe", "subroot", "root", "path")


def verified(rows: DataFrame) -> DataFrame:
    """Rows of :func:`manifest` with ``proof_sha256``, ``folded_root`` (from the probe and the path) and ``verified``."""
    return rows.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": fold(F.col("probe"), F.col("path"))}).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def tampered(df: DataFrame, fields: list[str], id_col: str, text_col: str, every: int = 3) -> Column:
    """The leaf of each row after tampering: where ``every`` divides crc32 of the id, A-Z of the text are lower-cased."""
    hit = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(every)) == 0, F.lit(False))
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = leaf(*[lowered if c == text_col else F.col(c) for c in fields])
    return F.when(hit, changed).otherwise(leaf(*[F.col(c) for c in fields]))

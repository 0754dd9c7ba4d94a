"""Near-duplicate classes by a chosen-path set similarity join.

A document is the set of its 5-word shingles. Each of ``trees`` random trees branches the
documents recursively: a node picks some of the minwise positions at random (``BRANCH`` / threshold of them on average, at least one),
and a document follows the branch of its own minwise token at each of them, so similar documents go on
together and others part. A node is decided as soon as it is small: the signatures of its documents are compared
with each other, and pairs of an estimate of at least 0.55 on their full sets. Only the documents of larger nodes branch
further. Where nodes are small at once a pair at the threshold is lost by branching with probability 0.25 ** (positions
picked by all roots, more than 10), under one in a million, and by the estimate with 5 in ten million; in groups
of thousands of texts that are all about as alike as the threshold, paths are longer and a single pair at the threshold
may be lost in a few of a thousand cases, though most texts of such groups have many links.

Nothing depends on a group being small:

* equal sets are one vertex from the start (a grouped minimum, folded before the shuffle);
* members of large nodes are first held against the smallest id of each and linked with the most similar one: a
  group of any size falls into few parts by a linear number of comparisons. A leader with many followers is salted;
* a node whose members are one part then ends. In one with few members outside its main part these meet the others in
  blocks; only nodes with many of them branch on. Nodes that hold several parts are looked at, only across parts, and
  nodes of the same members once;
* a node that stays large at ``max_depth`` is cut into blocks, and blocks are compared by twos.

Signatures only propose: every link is confirmed on the full shingle sets of both texts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .components import components
from .runtime import Out, saved, shuffle_partitions

POSITIONS = 128
TREES = 9
BRANCH = 1.25
MAX_DEPTH = 7
NODE_SIZE = 2048
TINY_NODE = 64             # decided at once, however long its texts are
SHINGLES_PER_MEMBER = 1000 # a node of more than this a member, at full size, counts as large
THRESHOLD = 75            # percent
_SLACK = 0.20             # a pair is confirmed from this far below the threshold: P(Bin(128, 0.75) < 0.55 * 128) = 5e-7
_HASH = vec.MinHash(POSITIONS, seed=4)
_FOLLOWERS = 128


def _signatures(k):
    fields = [pa.field("n", pa.int64()), pa.field("k1", pa.int64()), pa.field("k2", pa.int64()), pa.field("sig", pa.binary())]

    def run(batches):
        for batch in batches:
            out = Out(pa.schema([batch.schema.field(0), *fields]))
            ids = batch.column(0).to_pylist()
            for b in vec.blocks(batch.column(1), vec.NON_SPACE, True):
                for d in range(b.rows):
                    s = np.unique(vec.shingles(b.hash[b.first[d]: b.first[d + 1]], k))
                    keys = [int(vec.mix(s ^ vec.U64(c)).sum().astype(np.int64)) if len(s) else 0 for c in (0x5851F42D, 0x14057B7E)]
                    out.add(ids[b.row + d], len(s), *keys, _HASH.signature(s).tobytes() if len(s) else None, size=600)
                    if out.full:
                        yield out.take()
            yield out.take()

    return run


def _branch(threshold, roots):
    """(node, id, part, n, sig) -> (node, id, part, n) of the chosen children; with ``roots`` the nodes are given, for (id, part, n, sig)."""
    salt = vec.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64))
    limit = np.uint64(int(2 ** 64 * BRANCH / (threshold * POSITIONS)))

    def children(node: np.ndarray, sig: np.ndarray):
        drawn = vec.mix(node[:, None] ^ salt[None, :])
        picked = drawn < limit
        none = np.flatnonzero(~picked.any(axis=1))
        picked[none, drawn[none].argmin(axis=1)] = True         # every node takes at least one position
        rows, at = np.nonzero(picked)
        return rows, vec.mix(vec.mix(node[rows] ^ salt[at]) ^ sig[rows, at].astype(np.uint64)).view(np.int64)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            sig = np.frombuffer(b"".join(batch.column(names.index("sig")).to_pylist()), np.uint32).reshape(n, POSITIONS)
            kept = [c for c in ("id", "part", "n") if c in names]
            if roots is None:
                starts = [batch.column(names.index("node")).to_numpy(zero_copy_only=False).view(np.uint64)]
            else:
                starts = [np.full(n, r, np.uint64) for r in roots]
            for node in starts:
                for i in range(0, n, 2048):
                    rows, child = children(node[i: i + 2048], sig[i: i + 2048])
                    rows = pa.array(rows + i)
                    yield pa.RecordBatch.from_arrays([pa.array(child), *[batch.column(names.index(c)).take(rows) for c in kept]], names=["node", *kept])

    return run


def _alike(batches):
    """(a, b, sa, sb) -> (a, b, est): the share of equal positions."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(n, POSITIONS) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(axis=1))], names=["a", "b", "est"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Confirm on sorted full sets: 100 * intersection >= percent * union."""
    small, big = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(big):
        return False
    at = np.searchsorted(big, small)
    at[at == len(big)] = 0
    both = int((big[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(column, k) -> list[np.ndarray]:
    return [np.unique(vec.shingles(b.hash[b.first[d]: b.first[d + 1]], k))
            for b in vec.blocks(column, vec.NON_SPACE, True) for d in range(b.rows)]


def _confirm_stars(k, percent):
    """Rows (hub, salt, is_hub, id, text), sorted so that the hub comes first -> links (a, b)."""

    def run(batches):
        hub, sets = None, []
        for batch in batches:
            a, b = [], []
            names = batch.schema.names
            cols = {c: batch.column(names.index(c)).to_pylist() for c in ("hub", "salt", "is_hub", "id")}
            for i, s in enumerate(_sets(batch.column(names.index("text")), k)):
                key = (cols["hub"][i], cols["salt"][i])
                if key != hub:
                    hub, sets = key, []
                if cols["is_hub"][i]:
                    sets.append(s)
                elif any(_linked(s, h, percent) for h in sets):
                    a.append(cols["id"][i])
                    b.append(cols["hub"][i])
            kind = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return run


def _propose(slack):
    """One node (or two blocks of one): (node, id, part, sig) -> (node, id, part) of those alike to one of another part."""

    def run(table):
        node = table.column("node")[0].as_py()
        ids, parts = table.column("id").to_pylist(), table.column("part").to_pylist()
        part = np.unique(table.column("part").to_numpy(), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(ids), POSITIONS)
        keep = np.zeros(len(ids), bool)
        for i in range(len(ids) - 1 if part.any() else 0):       # a node of one part has nothing left to link
            near = ((sig[i + 1:] == sig[i]).mean(axis=1) >= slack) & (part[i + 1:] != part[i])
            if near.any():
                keep[i] = True
                keep[i + 1:] |= near
        got = np.flatnonzero(keep).tolist()
        kind = table.schema.field("id").type
        return pa.table({"node": pa.array([node] * len(got), pa.int64()), "id": pa.array([ids[i] for i in got], kind),
                         "part": pa.array([parts[i] for i in got], kind)})

    return run


def _intersections(sets: list[np.ndarray]):
    """For i = 1, 2, ...: the sizes of the intersections of set i with each set before it, by bit masks over
    the elements that at least two sets have."""
    sizes = [len(x) for x in sets]
    every, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    keep = times[place] > 1
    column, shared = column[place[keep]], np.cumsum(np.concatenate(([0], keep)))
    ends = shared[np.cumsum([0, *sizes])]
    width = max(1, -(-int((times > 1).sum()) // 64)) * 64
    masks, row = np.empty((len(sets), width // 64), np.uint64), np.zeros(width, bool)
    for i in range(len(sets)):
        own = column[ends[i]: ends[i + 1]]
        row[own] = True
        masks[i] = np.packbits(row).view(np.uint64)
        row[own] = False
    for i in range(1, len(sets)):
        yield i, np.bitwise_count(masks[:i] & masks[i]).sum(axis=1, dtype=np.int64)


def _confirm_node(k, percent):
    """One node: (node, id, part, text) -> links across parts, enough to join all parts that are linked."""

    def run(table):
        sets = _sets(table.column("text").combine_chunks(), k)
        ids = table.column("id").to_pylist()
        part = np.unique(table.column("part").to_numpy(), return_inverse=True)[1]
        size = np.array([len(x) for x in sets])
        a, b = [], []
        for i, both in _intersections(sets):
            linked = (100 * both >= percent * (size[:i] + size[i] - both)) & (both > 0)
            for j in np.flatnonzero(linked).tolist():
                if part[i] != part[j]:
                    a.append(ids[i])
                    b.append(ids[j])
                    part[part == part[i]] = part[j]
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    return run


def _edges(labels: DataFrame) -> DataFrame:
    return labels.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _part(frame: DataFrame, links: DataFrame) -> DataFrame:
    """``frame`` with the part of each id; ``links`` are stars (a, its part b), or pairs of equal sets."""
    parts = links.groupBy("a").agg(F.min("b").alias("b"))
    return frame.join(parts, frame["id"] == parts["a"], "left").withColumn("part", F.coalesce("b", "id")).drop("a", "b")


def _distinct_nodes(members: DataFrame, known: bool = True) -> DataFrame:
    """(node, id, part) of nodes of several parts, those of equal members once; nodes are small here. Where parts are not
    ``known`` yet, (node, id) of nodes of several members."""
    cols = ["id", "part"] if known else ["id"]
    sets = members.groupBy("node").agg(F.array_sort(F.collect_set(F.struct(*cols))).alias("ids")).select("ids").filter(
        F.array_min(f"ids.{cols[-1]}") != F.array_max(f"ids.{cols[-1]}")).distinct()
    return sets.select(F.xxhash64("ids").alias("node"), F.explode("ids").alias("m")).select("node", *[f"m.{c}" for c in cols])


def _confirmed_leaders(docs: DataFrame, rep_sig: DataFrame, pairs: DataFrame, k: int, percent: int, est_least: float) -> DataFrame:
    """Links (a, b) of documents with the most similar of their leaders, as far as the full sets confirm them."""
    id_type = docs.schema["id"].dataType.simpleString()
    alike = (pairs.join(rep_sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
             .join(rep_sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
             .mapInArrow(_alike, f"a {id_type}, b {id_type}, est double").filter(F.col("est") >= est_least))
    best = saved(alike.groupBy("a").agg(F.max(F.struct("est", (-F.col("b")).alias("nb"))).alias("m")).select(
        F.col("a").alias("id"), (-F.col("m.nb")).alias("hub")), "best")
    salts = best.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(_FOLLOWERS)).cast("int").alias("salts"))
    spread = best.join(salts, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("is_hub"))
    hubs = salts.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_hub"))
    wanted = saved(spread.unionByName(hubs), "stars")      # written, so that the plan of the join knows its size
    return (docs.join(wanted, "id").select("hub", "salt", "is_hub", "id", "text").repartition("hub", "salt")
            .sortWithinPartitions("hub", "salt", F.desc("is_hub")).mapInArrow(_confirm_stars(k, percent), f"a {id_type}, b {id_type}"))


def _sized(level: DataFrame) -> DataFrame:
    """Rows (node, id, part, n) of nodes of two parts or more, with the node's size, weight, smallest id and number of
    members outside its largest part, written once. Nodes of one part end here."""
    level = saved(level, "level")
    counts = level.groupBy("node", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.min("id").alias("i"))
    size = counts.groupBy("node").agg(F.sum("c").alias("size"), F.sum("w").alias("weight"), F.min("i").alias("leader"), F.max("c").alias("most"),
                                      F.count(F.lit(1)).alias("parts")).filter("parts > 1").withColumn("light", F.col("size") - F.col("most"))
    return saved(level.join(size.drop("most", "parts"), "node"), "nodes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = THRESHOLD,
                    trees: int = TREES, max_depth: int = MAX_DEPTH, node_size: int = NODE_SIZE) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every input row.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. With fewer than ``k`` words the whole sequence is
    the only shingle; null and empty texts and those without words have none and are linked with nothing. Documents
    are linked where 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest id reachable, ``kept``
    marks that document. Rows that share an id are one document for linking (linked if any of their texts is) and
    each keep their row; rows without an id are linked with nothing, have a null component and are kept. Other columns
    are left out, whatever their names. Integer ids are expected. An empty table gives an empty table.
    """
    spark = df.sparkSession
    est_least = percent / 100 - _SLACK
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # for the join that fetches texts: dealt by id at every size, rather than only where the ids are too many to broadcast
    by_id = docs.repartition(shuffle_partitions(spark), "id")
    sets = saved(docs.mapInArrow(_signatures(k), f"id {id_type}, n bigint, k1 bigint, k2 bigint, sig binary"), "sets")
    full = sets.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    key = ["n", "k1", "k2"]
    classes = saved(full.groupBy(*key).agg(F.min("id").alias("rep")), "classes")
    rep_sig = saved(full.select("id", *key, "sig").join(classes.withColumnRenamed("rep", "id"), ["id", *key], "left_semi")
                    .select("id", *key, "sig").dropDuplicates(["id", *key]).select("id", "n", "sig"), "reps")

    again = full.select("id", *key).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id")
    labels = full.select("id", *key).distinct().join(again, "id", "left_semi").join(classes, key).select(F.col("id").alias("a"), F.col("rep").alias("b"))

    # branch from all roots: nodes of two or more are looked at, larger ones go deeper
    roots = vec.mix(np.arange(1, trees + 1, dtype=np.uint64) * vec.U64(0x9E3779B97F4A7C15))
    node_type = f"node bigint, id {id_type}, part {id_type}, n bigint"
    is_small = (F.col("size") <= min(TINY_NODE, node_size)) | ((F.col("size") <= node_size) & (F.col("weight") <= node_size * SHINGLES_PER_MEMBER))
    level = _sized(rep_sig.withColumn("part", F.col("id")).mapInArrow(_branch(percent / 100, roots), node_type))
    large = level.filter(~is_small)
    # members go without their parts, which come with the signatures, by one join
    places, parted = [level.filter(is_small).select("node", "id")], rep_sig.withColumn("part", F.col("id"))
    if not large.isEmpty():
        # a linear number of comparisons with leaders; what they link is one part from here on
        stars = large.filter(F.col("id") != F.col("leader")).select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
        led = _confirmed_leaders(docs, rep_sig, stars, k, percent, est_least)
        labels = saved(_edges(components(labels.unionByName(led))), "parts")
        parted = _part(rep_sig, labels)
        parts = saved(_part(rep_sig.select("id").distinct(), labels), "parted")
        level = large.select("node", "id", "n").join(parts, "id")
        for depth in range(1, max_depth + 1):
            level = _sized(level)
            large = level.filter(~is_small)
            places.append(level.filter(is_small).select("node", "id"))
            # few outside the main part: they meet the others in blocks, which takes about a row a member; many: the node branches on
            few = F.col("light") <= F.lit(node_size // 4)
            last = depth == max_depth
            places.append(_blocks((large if last else large.filter(few)).select("node", "id", "n", "part"), node_size).select("node", "id"))
            large = large.filter(~few)
            if last or large.isEmpty():
                break
            level = large.select("node", "id", "part").join(rep_sig, "id").select("node", "id", "part", "n", "sig").mapInArrow(
                _branch(percent / 100, None), node_type)

    # what is left between the parts
    places = _distinct_nodes(reduce(DataFrame.unionByName, places), known=False)
    near = places.join(parted, "id").select("node", "id", "part", "sig").groupBy("node").applyInArrow(
        _propose(est_least), f"node bigint, id {id_type}, part {id_type}")
    near = saved(_distinct_nodes(near), "near")
    across = by_id.join(near, "id").select("node", "id", "part", "text").groupBy("node").applyInArrow(
        _confirm_node(k, percent), f"a {id_type}, b {id_type}")
    labels = components(labels.unionByName(across))

    placed = (sets.select("id", *key).join(classes, key, "left")
              .join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left"))
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep", "id")).otherwise(F.col("id"))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                         F.when(F.col("id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.col("component_id").isNull() | (F.col("component_id") == F.col(id_col)))


def _blocks(members: DataFrame, node_size: int) -> DataFrame:
    """Nodes too large to be compared at once: (node, id, part) of pairs of blocks, so that every two members of different
    parts meet in one. The members outside a node's largest part are dealt into blocks of their own, few as they are, and only
    these are repeated over the blocks of the largest part; a member of that goes to as many nodes as there are blocks of others."""
    count = members.groupBy("node", "part").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    main = count.groupBy("node").agg(F.max(F.struct("size", "part", "weight")).alias("m"), F.sum("size").alias("all"), F.sum("weight").alias("weight"))
    blocks = lambda size, weight: F.ceil(F.greatest(size, weight / SHINGLES_PER_MEMBER) * 2 / F.lit(node_size)).cast("int")
    main = main.select("node", F.col("m.part").alias("main"), blocks(F.col("m.size"), F.col("m.weight")).alias("mains"),
                       blocks(F.col("all") - F.col("m.size"), F.col("weight") - F.col("m.weight")).alias("lights")).filter("lights > 0")
    is_main = F.col("part") == F.col("main")
    own = F.pmod(F.xxhash64("id", "node"), F.when(is_main, F.col("mains")).otherwise(F.col("lights"))).cast("int")
    dealt = members.join(main, "node").withColumn("own", own)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    keyed = lambda kind, x, y: F.xxhash64("node", F.lit(kind), x, y).alias("node")
    base = ["node", "id", "part", "own"]
    hosts = dealt.filter(is_main).select(*base, upto("lights")).select(keyed("main", "other", "own"), "id", "part")
    light = dealt.filter(~is_main)
    guests = light.select(*base, upto("mains")).select(keyed("main", "own", "other"), "id", "part")
    among = light.select(*base, upto("lights")).select(keyed("light", F.least("own", "other"), F.greatest("own", "other")), "id", "part")
    return hosts.unionByName(guests).unionByName(among).distinct()

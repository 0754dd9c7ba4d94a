"""Exact Jaccard join of n-gram sets with prefix trees, and the classes it links.

A document is the set of its word n-grams (64-bit hashes). Two sets of sizes n and m are linked where their overlap o meets
``100 o >= percent (n + m - o)``; then o is at least ``need(n) = ceil(percent n / 100)``, and at least ``need(m)``. From this follow

1. Equal sets are one vertex (a grouped minimum, folded before the shuffle).
2. Sieve. Under any order of the tokens the r smallest common tokens lie among the first ``n - need(n) + r`` of either
   set. Every set sends the first ``n - need(n) + n // 10`` by hash; one that shares fewer than ``need(n) // 10``
   of them (at least one) with any other set is linked with nothing. Most documents end here, without their full sets having moved.
3. Order. The sets left are ordered by document frequency among them, rare tokens first (ties by hash). Tokens of frequency
   one are in no overlap: only their number counts. Linked sets share one of the first ``n - need(n) + 1`` tokens.
4. Sets connected by such tokens are a unit. The sets of a unit are stored in a prefix tree (a path is a sequence of tokens
   in that order, an edge at most ``EDGE`` tokens), and every set walks the tree once, level by level: sets with a common
   beginning share its overlap, and a subtree is left as soon as the overlap so far plus the tokens that remain, in the walker or
   in the longest set of the subtree, falls short for the smallest one. Subtrees of sets already in the walker's class are left too.
5. Units too large for a task: each set is first held against the smallest id of the token group that it shares most often
   (salted stars; a group of near copies falls into few classes by a linear number of comparisons), then each token group that still
   holds several classes is a unit of its own, and groups too large for a task are cut into blocks that meet by twos.

Overlaps are counted on full sets, so links are exact up to equal 64-bit hashes of different n-grams; no document or partner is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .components import components
from .neardup import SHINGLES_PER_MEMBER, _blocks, _edges, _part
from .runtime import Out, saved, shuffle_partitions

K = 4
PERCENT = 85
EDGE = 16                    # tokens of an edge, so that subtrees are left early
UNIT_TOKENS = 1 << 20        # of the sets of one prefix tree
_FOLLOWERS = 256             # rows of a star that meet in one task
_BLOCK = 1 << 18             # bytes of text hashed at a time


def _need(n, percent):
    return -(-percent * n // 100)


def _sieved(n):
    return max(1, n // 10)


def _key(s: np.ndarray, salt: int) -> int:
    return int(vec.mix(s ^ vec.U64(salt)).sum().astype(np.int64)) if len(s) else 0


_SALTS = (0x5851F42D, 0x14057B7E)


def _each_set(column, k):
    for b in vec.blocks(column, vec.NON_SPACE, True, _BLOCK):
        for d in range(b.rows):
            yield b.row + d, np.unique(vec.shingles(b.hash[b.first[d]: b.first[d + 1]], k))


def _keys(k):
    """(id, text) -> (id, n, k1, k2): the size and two hashes of the set."""

    def run(batches):
        for batch in batches:
            out = Out(pa.schema([batch.schema.field(0), *[pa.field(c, pa.int64()) for c in ("n", "k1", "k2")]]), max_rows=1 << 30)
            ids = batch.column(0).to_pylist()
            for i, s in _each_set(batch.column(1), k):
                out.add(ids[i], len(s), *[_key(s, c) for c in _SALTS])
            yield out.take()

    return run


def _first_tokens(k, percent):
    """(id, text) -> (k1, token): the tokens that the sieve looks at."""

    def run(batches):
        for batch in batches:
            keys, tokens, sizes = [], [], []
            known = batch.column(0).is_valid().to_pylist()
            for i, s in _each_set(batch.column(1), k):
                if len(s) and known[i]:
                    keys.append(_key(s, _SALTS[0]))
                    sizes.append(len(s) - _need(len(s), percent) + _sieved(len(s)))
                    tokens.append(s[: sizes[-1]].view(np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int64), sizes)), pa.array(np.concatenate(tokens))], names=["k1", "token"])

    return run


def _full_sets(k):
    """(id, text, k1) -> (id, k1, n, tokens) of the rows whose set has that key."""

    def run(batches):
        for batch in batches:
            out = Out(pa.schema([batch.schema.field(0), pa.field("k1", pa.int64()), pa.field("n", pa.int64()), pa.field("tokens", pa.list_(pa.int64()))]))
            ids, want = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, s in _each_set(batch.column(1), k):
                if _key(s, _SALTS[0]) == want[i]:
                    out.add(ids[i], want[i], len(s), s.view(np.int64), size=8 * len(s))
                    if out.full:
                        yield out.take()
            yield out.take()

    return run


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0] .. lo[0] + n[0] - 1, lo[1] .. and so on."""
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


class PrefixTree:
    """Sets of ascending ranks as paths from a root; sets with a common beginning share it."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """``sets`` without tokens that only one set has; ``sizes`` with them."""
        big_endian = [s.astype(">u4").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=lambda i: big_endian[i]), np.int64)      # set of each leaf
        self.sets, self.size = [sets[i] for i in self.order], sizes[self.order]
        self.length = np.array([len(s) for s in self.sets], np.int64)
        first = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([*self.sets, np.zeros(1, np.int64)])
        top = max((int(s[-1]) for s in self.sets if len(s)), default=0)
        self.ranks = top + 1
        rows, todo, at = [], [(0, len(sets), 0)], 0        # (first leaf, end, depth): leaves that share the tokens before depth
        children = []
        while at < len(todo):
            a, b, depth = todo[at]
            at += 1
            same = min(EDGE, int(self.length[a]) - depth) if depth or at > 1 else 0
            if b - a > 1 and same:
                x, y = self.sets[a][depth: depth + same], self.sets[b - 1][depth: depth + same]
                differ = np.flatnonzero(x[: len(y)] != y[: len(x)])
                same = int(differ[0]) if len(differ) else min(len(x), len(y))
            end = depth + same
            ends = int(np.searchsorted(self.length[a:b] > end, True)) if b - a > 1 else int(self.length[a] <= end)
            rows.append((int(first[a]) + depth, same, end, a, b, ends))
            children.append(len(todo))
            lo = a + ends
            if lo < b:
                token = self.flat[first[lo:b] + end]
                cuts = [lo, *(np.flatnonzero(token[1:] != token[:-1]) + 1 + lo).tolist(), b]
                todo += [(i, j, end) for i, j in zip(cuts, cuts[1:], strict=False)]
        self.at, self.n, self.depth, self.lo, self.hi, self.ends = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        self.child = np.array(children, np.int64)
        self.children = np.append(self.child[1:], len(todo)) - self.child
        self.longest = self._over(np.maximum, self.length)
        self.smallest = self._over(np.minimum, self.size)

    def _over(self, least_or_most, values):
        """The extreme of the leaves' values under each node."""
        cuts = np.stack([self.lo, self.hi], axis=1).ravel()
        return least_or_most.reduceat(np.append(values, values[-1]), cuts)[0::2]

    def walk(self, leaf: int, part: np.ndarray, percent: int):
        """Later leaves of other parts that are linked with ``leaf``; ``part`` is by leaf."""
        own = self.sets[leaf]
        held = np.zeros(self.ranks, bool)
        held[own] = True
        mine = np.concatenate(([0], np.cumsum(part == part[leaf])))
        size, found = int(self.size[leaf]), []
        node, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(node):
            length = self.n[node]
            some = np.flatnonzero(length)
            if len(some):
                sums = np.add.reduceat(held[self.flat[_spread(self.at[node[some]], length[some])]], np.cumsum(length[some]) - length[some], dtype=np.int64)
                overlap = overlap.copy()
                overlap[some] += sums
            last = np.where(length > 0, self.flat[self.at[node] + length - 1], -1)
            remaining = np.minimum(self.longest[node] - self.depth[node], len(own) - np.searchsorted(own, last, "right"))
            near = (100 + percent) * (overlap + remaining) >= percent * (size + self.smallest[node])
            node, overlap = node[near], overlap[near]
            done = np.flatnonzero(self.ends[node])
            if len(done):
                leaves = _spread(self.lo[node[done]], self.ends[node[done]])
                o = np.repeat(overlap[done], self.ends[node[done]])
                linked = ((100 + percent) * o >= percent * (size + self.size[leaves])) & (leaves > leaf) & (part[leaves] != part[leaf]) & (o > 0)
                found.append(leaves[linked])
            count = self.children[node]
            node, overlap = _spread(self.child[node], count), np.repeat(overlap, count)
            lo, hi = self.lo[node], self.hi[node]
            open_ = (hi > leaf + 1) & (mine[hi] - mine[lo] < hi - lo)
            node, overlap = node[open_], overlap[open_]
        return np.concatenate(found).tolist() if found else []


def join_sets(sets: list[np.ndarray], sizes: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of linked sets, enough to connect all parts that are linked. ``sets`` hold ascending ranks."""
    if len(sets) < 2:
        return []
    tree = PrefixTree(sets, np.asarray(sizes))
    part = np.unique(part, return_inverse=True)[1][tree.order]
    links = []
    for leaf in range(len(sets)):
        for other in tree.walk(leaf, part, percent):
            if part[other] != part[leaf]:
                part[part == part[other]] = part[leaf]
                links.append((int(tree.order[leaf]), int(tree.order[other])))
    return links


def _join_unit(percent):
    """One unit: (id, part, n, tokens, dfs) -> links (a, b)."""

    def run(table):
        ids = table.column("id").to_pylist()
        tokens, dfs = (table.column(c).combine_chunks() for c in ("tokens", "dfs"))
        sizes = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
        # ranks in the corpus-wide order: by frequency, then by hash
        token, df = tokens.flatten().to_numpy(), dfs.flatten().to_numpy()
        order = np.lexsort((token, df))
        rank = np.empty(len(token), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (token[order][1:] != token[order][:-1]).astype(np.int64))))
        sets = [np.sort(x) for x in np.split(rank, np.cumsum(sizes)[:-1])]
        links = join_sets(sets, table.column("n").to_numpy(), table.column("part").to_numpy(), percent)
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array([ids[i] for i, _ in links], kind), "b": pa.array([ids[j] for _, j in links], kind)})

    return run


def _candidates(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """``id, k1`` of the classes (by their smallest id) that pass the sieve."""
    first = docs.mapInArrow(_first_tokens(k, percent), "k1 bigint, token bigint")
    # frequent tokens are folded before the shuffle; a token of one set only is of no use
    shared = first.groupBy("token").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo <> hi").select("token")
    hits = first.join(shared, "token", "left_semi").groupBy("k1").agg(F.count(F.lit(1)).alias("hits"))
    need = F.ceil(F.col("n") * percent / 100)
    least = F.greatest(F.lit(1), F.floor(need / 10)) * F.col("copies")          # every copy sent its tokens
    return classes.join(hits, "k1").filter(F.col("hits") >= least).select("id", "k1")


def _ordered(full: DataFrame, percent: int) -> DataFrame:
    """``id, k1, n, tokens, dfs, first``: sets with their shared tokens, rare ones first, and how many of them a linked set must
    meet. Sets that do not share enough are left out."""
    posting = full.select("k1", F.explode("tokens").alias("token"))
    df = posting.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    sets = posting.join(df, "token").groupBy("k1").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("s")).join(full.select("id", "k1", "n"), "k1")
    first = F.size("s") - F.ceil(F.col("n") * percent / 100) + 1
    return sets.select("id", "k1", "n", F.col("s.token").alias("tokens"), F.col("s.df").alias("dfs"), first.cast("int").alias("first")).filter("first > 0")


def _leader_links(places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each set with the smallest id of the token group that it shares most often."""
    led = places.join(places.groupBy("node").agg(F.min("id").alias("hub")), "node").filter("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("times"))
    best = led.groupBy("id").agg(F.max(F.struct("times", (-F.col("hub")).alias("nb"))).alias("m")).select("id", (-F.col("m.nb")).alias("hub"))
    best = saved(best, "best")
    salts = best.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(_FOLLOWERS)).cast("int").alias("salts"))
    own = best.join(salts, "hub").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).join(sets.select("id", "n", "tokens"), "id")
    hub = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(
        sets.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens")), "hub")
    both = F.size(F.array_intersect("tokens", "hub_tokens"))
    return own.join(hub, ["hub", "salt"]).filter(100 * both >= percent * (F.col("n") + F.col("hub_n") - both)).select(F.col("id").alias("a"), F.col("hub").alias("b"))


def _large_units(places: DataFrame, sets: DataFrame, labels: DataFrame, unit_tokens: int) -> DataFrame:
    """(node, id) of the token groups that hold several classes, equal groups once, large ones in blocks by twos."""
    sums = places.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *[F.sum(F.xxhash64("id", F.lit(i)) % (1 << 40)).alias(f"h{i}") for i in (1, 2)])
    once = sums.groupBy("size", "h1", "h2").agg(F.min("node").alias("node")).select("node")
    weighed = _part(places.join(once, "node", "left_semi").join(sets.groupBy("id").agg(F.sum(F.size("tokens")).alias("n")), "id"), labels)
    mixed = weighed.groupBy("node").agg(F.sum("n").alias("weight"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("node", "weight")
    left = saved(weighed.join(mixed, "node"), "mixed")
    blocks = _blocks(left.filter(F.col("weight") > unit_tokens).select("node", "id", "n", "part"), max(2, unit_tokens // SHINGLES_PER_MEMBER)).select("node", "id")
    return left.filter(F.col("weight") <= unit_tokens).select("node", "id").unionByName(blocks)


def ngram_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT,
                  unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every input row.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. With fewer than ``k`` words the whole sequence is the only
    n-gram; null and empty texts and those without words have none and are linked with nothing. ``component_id`` is the smallest id
    that is reachable by links, the row's own included. Rows that share an id are one document for linking (linked if any of
    their texts is) and each keep their row; a row without words is alone; rows without an id are linked with nothing and
    have a null component. Very long texts are sets like others; other columns are left out, whatever their names. Integer ids
    are expected. An empty table gives an empty table.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = saved(docs.mapInArrow(_keys(k), f"id {id_type}, n bigint, k1 bigint, k2 bigint"), "sets")
    key = ["n", "k1", "k2"]
    whole = sets.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = saved(whole.groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    chosen = saved(_candidates(docs, classes, k, percent), "chosen")
    # dealt by id at every size, rather than only where the ids are too many to broadcast
    by_id = docs.repartition(shuffle_partitions(spark), "id")
    full = saved(by_id.join(chosen, "id").select("id", "text", "k1").mapInArrow(_full_sets(k), f"id {id_type}, k1 bigint, n bigint, tokens array<bigint>")
                 .dropDuplicates(["id", "k1"]), "full")
    ordered = saved(_ordered(full, percent), "ordered")

    # sets connected by a token that linked sets must share
    places = ordered.select(F.explode(F.slice("tokens", 1, F.col("first"))).alias("node"), "id").distinct()
    heads = places.groupBy("node").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("node", "lo")
    places = saved(places.join(heads, "node"), "places")
    unit = saved(components(places.select(F.col("id").alias("a"), F.col("lo").alias("b")).distinct()), "units")
    weight = unit.join(ordered.groupBy("id").agg(F.sum(F.size("tokens")).alias("n")), "id").groupBy("component").agg(F.sum("n").alias("weight"))
    unit = saved(unit.join(weight, "component"), "weighed")
    large = unit.filter(F.col("weight") > unit_tokens).select("id")
    nodes = unit.filter(F.col("weight") <= unit_tokens).select(F.col("component").cast("long").alias("node"), "id")

    again = whole.select("id", *key).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id")
    links = whole.select("id", *key).distinct().join(again, "id", "left_semi").join(classes.select(F.col("id").alias("rep"), *key), key).select(
        F.col("id").alias("a"), F.col("rep").alias("b"))
    if not large.isEmpty():
        hot = saved(places.select("node", "id").join(large, "id", "left_semi"), "hot")
        links = _edges(components(links.unionByName(_leader_links(hot, ordered, percent))))
        links = saved(links, "led")
        apart = _large_units(hot, ordered, links, unit_tokens).withColumn("node", F.xxhash64("node", F.lit("token")))
        nodes = nodes.withColumn("node", F.xxhash64("node", F.lit("unit"))).unionByName(apart)
    nodes = saved(nodes, "nodes")
    met = _part(nodes.join(ordered.select("id", "n", "tokens", "dfs"), "id"), links).select("node", "id", "part", "n", "tokens", "dfs").groupBy("node").applyInArrow(
        _join_unit(percent), f"a {id_type}, b {id_type}")
    label = components(links.unionByName(met))

    placed = sets.select("id", *key).join(classes.select(F.col("id").alias("rep"), *key), key, "left").join(
        label.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep", "id")).otherwise(F.col("id"))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))

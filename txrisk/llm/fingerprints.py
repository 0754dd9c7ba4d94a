"""MinHash document fingerprints: universal hash permutations over 5-word shingles, in numpy.

A fingerprint is the 32-bit minima of ``PERMUTATIONS`` hash permutations over the set of a text's
lower-cased 5-word shingles (a shorter text: all its words as one shingle), as hex digits. The share of equal
minima estimates the Jaccard likeness of two texts (standard error at most 0.045). :func:`band_classes` joins
signature bands in Spark and verifies the Jaccard likeness on the full shingle sets; :func:`band_links` does so for the smallest id of each band only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import neardup, vec
from .components import components
from .runtime import Out, saved, shuffle_partitions

PERMUTATIONS = 128
SHINGLE = 5
BANDS, ROWS = 32, 4
BUCKETS_PER_PARTITION = 4
_FOLLOWERS = 128
_HASH = vec.MinHash(PERMUTATIONS, seed=1)


def _signatures(column, k: int) -> list[np.ndarray]:
    return [_HASH.signature(np.unique(vec.shingles(b.hash[b.first[d]: b.first[d + 1]], k)))
            for b in vec.blocks(column, vec.NON_SPACE, True) for d in range(b.rows)]


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def _fingerprint_rows(k):
    def run(batches):
        for batch in batches:
            sigs = _signatures(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_hex(s) for s in sigs], pa.string())], names=["id", "fingerprint"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``id_col, fingerprint``: one row for each input row, no shuffle.

    Null, empty and word-free texts share one fingerprint (all ones). Equal texts have equal fingerprints. Repeated
    rows and null ids are kept as they come; other columns are left out.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _fingerprint_rows(k), f"id {id_type}, fingerprint string").withColumnRenamed("id", id_col)


def likeness(a: str, b: str) -> float:
    """Share of equal minima of two fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(v), ">u4") for v in (a, b))
    return float((x == y).mean())


def _edit_rows(k):
    """Sorted rows (bucket, context, id, text) -> each with its edited text, which takes from the next row."""

    def run(batches):
        held = None                                    # (bucket, context, id, text, signature) of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            col = lambda c: batch.column(names.index(c))  # noqa: B023, E731
            rows = list(zip(col("bucket").to_pylist(), col("context").to_pylist(), col("id").to_pylist(),
                            [t or "" for t in col("text").to_pylist()], _signatures(col("text"), k), strict=True))
            if held:
                rows.insert(0, held)
            held = rows[-1]
            done = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and not x[1]]
            edited = [x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2] for x, y in done]
            out = Out(pa.schema([batch.schema.field("id"), pa.field("n_chars", pa.int64()), pa.field("edited_sha256", pa.string()),
                                 pa.field("fingerprint", pa.string()), pa.field("edited_fingerprint", pa.string()),
                                 pa.field("near_edited", pa.float64()), pa.field("near_next", pa.float64())]))
            for (x, y), text, sig in zip(done, edited, _signatures(pa.array(edited, pa.string()), k), strict=True):
                out.add(x[2], len(x[3]), hashlib.sha256(text.encode()).hexdigest(), _hex(x[4]), _hex(sig),
                        float((x[4] == sig).mean()), float((x[4] == y[4]).mean()), size=2200)
                if out.full:
                    yield out.take()
            yield out.take()

    return run


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next row's text, by ascending id; after the last row comes the first. ``near_edited`` and ``near_next`` are
    the likeness of the row's fingerprint to those of the edited and of the next text. Null texts count as empty. Rows
    that share an id follow each other by text; null ids come first. Integer ids are expected. An empty table
    gives an empty table.

    Ids are cut into buckets at approximate quantiles (a number of buckets set by the number of partitions, so
    that the bounds are few); each bucket also gets the first row of the next one, and is streamed in order. The texts are
    shuffled once.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    parts = shuffle_partitions(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = parts * BUCKETS_PER_PARTITION
    cuts = docs.select(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n).alias("cuts")).first()["cuts"] or [0]
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    ids = docs.withColumn("at", F.coalesce(F.col("id").cast("double"), F.lit(float("-inf"))))
    placed = Bucketizer(splits=splits, inputCol="at", outputCol="b").transform(ids).select(
        F.col("b").cast("int").alias("bucket"), F.lit(False).alias("context"), "id", "text")
    # the first id of every bucket, handed to the bucket before (at most n rows); the very first goes to the last
    lead = F.struct(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id")).alias("m"))
    firsts = placed.groupBy("bucket").agg(lead.alias("f")).select("bucket", F.col("f.m.id").alias("id"))
    order = Window.orderBy("bucket")
    before = firsts.select("id", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("to"))
    context = placed.alias("d").join(F.broadcast(before.alias("f")), F.col("d.id").eqNullSafe(F.col("f.id"))).select(
        F.col("f.to").alias("bucket"), F.lit(True).alias("context"), F.col("d.id"), F.col("d.text"))
    rows = placed.unionByName(context).repartition(parts, "bucket").sortWithinPartitions("bucket", "context", F.asc_nulls_first("id"), "text")
    out = rows.mapInArrow(_edit_rows(k), f"id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                         "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def _band_rows(k, bands, rows):
    salt = vec.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            keys, at = [], []
            for i, sig in enumerate(_signatures(batch.column(1), k)):
                if (sig == 0xFFFFFFFF).all():
                    continue                           # no words: alike to nothing
                part = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
                h = salt.copy()
                for r in range(rows):
                    h = vec.mix(h ^ part[:, r])
                keys.append(h.view(np.int64))
                at.append(np.full(bands, i))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(np.concatenate(at)))], names=["band", "id"])

    return run


def _verify(k, least):
    def run(batches):
        key, hub = None, None
        for batch in batches:
            names = batch.schema.names
            a, b, j = [], [], []
            hubs, salts, is_hub, ids = (batch.column(names.index(c)).to_pylist() for c in ("hub", "salt", "is_hub", "id"))
            blocks = vec.blocks(batch.column(names.index("text")), vec.NON_SPACE, True)
            sets = (np.unique(vec.shingles(x.hash[x.first[d]: x.first[d + 1]], k)) for x in blocks for d in range(x.rows))
            for i, s in enumerate(sets):
                if (hubs[i], salts[i]) != key:
                    key, hub = (hubs[i], salts[i]), None
                if is_hub[i]:
                    hub = s
                elif hub is not None:
                    both = len(np.intersect1d(s, hub, assume_unique=True))
                    if (like := both / max(1, len(s) + len(hub) - both)) >= least:
                        a.append(ids[i])
                        b.append(hubs[i])
                        j.append(like)
            kind = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(j, pa.float64())], names=["a", "b", "jaccard"])

    return run


def band_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, least: float = 0.75,
               bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``a, b, jaccard``: each document with the smallest id of every signature band that it shares, where the Jaccard
    likeness of the full shingle sets is at least ``least`` (b < a). Bands with any number of members give one
    candidate a member, not all pairs; so in large groups of half-alike texts links between later members are not
    returned (:func:`band_classes` has them). Texts without words and rows without an id are alike to nothing; ids are unique."""
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    band = saved(docs.mapInArrow(_band_rows(k, bands, rows), f"band bigint, id {id_type}"), "bands")
    heads = band.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub <> top").select("band", "hub")
    pairs = saved(band.join(heads, "band").filter("id <> hub").select("id", "hub").distinct(), "pairs")
    salts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(_FOLLOWERS)).cast("int").alias("salts"))
    spread = pairs.join(salts, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("is_hub"))
    hubs = salts.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_hub"))
    return (docs.join(spread.unionByName(hubs), "id").select("hub", "salt", "is_hub", "id", "text").repartition("hub", "salt")
            .sortWithinPartitions("hub", "salt", F.desc("is_hub"))
            .mapInArrow(_verify(k, least), f"a {id_type}, b {id_type}, jaccard double"))


def _in_bands(bands, rows):
    """(id, part, n, sig) -> (node, id, part, n): a node for each band of the signature."""
    salt = vec.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            sig = np.frombuffer(b"".join(batch.column(names.index("sig")).to_pylist()), np.uint32).reshape(n, -1)[:, : bands * rows]
            part = sig.reshape(n, bands, rows).astype(np.uint64)
            h = np.broadcast_to(salt, (n, bands)).copy()
            for r in range(rows):
                h = vec.mix(h ^ part[:, :, r])
            at = pa.array(np.repeat(np.arange(n), bands))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), *[batch.column(names.index(c)).take(at) for c in ("id", "part", "n")]],
                                             names=["node", "id", "part", "n"])

    return run


def band_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = 75, bands: int = BANDS,
                 rows: int = ROWS, node_size: int = neardup.NODE_SIZE) -> DataFrame:
    """``id_col, n_shingles, component_id``: classes of documents that share a signature band and whose full shingle sets verify
    ``100 * intersection >= percent * union``; the smallest id names the class.

    Equal sets are one from the start. The members of a band are first held against its smallest id, which leaves few parts of a band of
    any size; bands that still hold several parts are compared whole, large ones in blocks by twos. So a partner is lost only
    where no band agrees: at a likeness of 0.75 with a probability of (1 - 0.75 ** rows) ** bands, 5e-6. Texts without words and
    rows without an id are alike to nothing; ids are unique. An empty table gives an empty table.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    least = percent / 100 - 0.2
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    by_id = docs.repartition(shuffle_partitions(spark), "id")
    key = ["n", "k1", "k2"]
    sets = saved(docs.mapInArrow(neardup._signatures(k), f"id {id_type}, n bigint, k1 bigint, k2 bigint, sig binary"), "sets")
    whole = sets.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = saved(whole.groupBy(*key).agg(F.min("id").alias("rep")), "classes")
    reps = saved(whole.join(classes.withColumnRenamed("rep", "id"), ["id", *key], "left_semi").dropDuplicates(["id", *key]).select("id", "n", "sig"), "reps")

    node_type = f"node bigint, id {id_type}, part {id_type}, n bigint"
    level = neardup._sized(reps.withColumn("part", F.col("id")).mapInArrow(_in_bands(bands, rows), node_type))
    stars = level.filter(F.col("id") != F.col("leader")).select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    led = neardup._confirmed_leaders(docs, reps, stars, k, percent, least)
    labels = saved(neardup._edges(components(led)), "led")
    level = neardup._sized(level.select("node", "id", "n").join(saved(neardup._part(reps.select("id"), labels), "parts"), "id"))
    large = level.filter(F.col("size") > node_size).select("node", "id", "n", "part")
    places = neardup._distinct_nodes(level.filter(F.col("size") <= node_size).select("node", "id", "part").unionByName(neardup._blocks(large, node_size)))
    near = places.join(reps, "id").select("node", "id", "part", "sig").groupBy("node").applyInArrow(
        neardup._propose(least), f"node bigint, id {id_type}, part {id_type}")
    across = by_id.join(saved(neardup._distinct_nodes(near), "near"), "id").select("node", "id", "part", "text").groupBy("node").applyInArrow(
        neardup._confirm_node(k, percent), f"a {id_type}, b {id_type}")
    label = components(labels.unionByName(across))
    placed = sets.select("id", *key).join(classes, key, "left").join(label.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep", "id")).otherwise(F.col("id"))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))


def brute_force(docs):
    """(id, n_chars, edited_sha256) by plain Python, and the exact Jaccard likeness to the edited and the next text."""
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))

    def sets(t):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i: i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()

    def like(x, y):
        return len(x & y) / len(x | y) if x | y else 1.0

    for i, (doc, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        yield doc, len(t), hashlib.sha256(e.encode()).hexdigest(), like(sets(t), sets(e)), like(sets(t), sets(nxt))

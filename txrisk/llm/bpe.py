"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk_chars`` is cut into overlapping chunks which are dealt out over the
cluster and pre-tokenised independently. A chunk that starts in the middle of a pre-token
soon falls into step with its left neighbour: from the first position in the overlap at which
both see a pre-token boundary, both go on alike, because the pattern never looks back. It looks ahead
after white space (`\\s+(?!\\S)`), and a piece that ended in it would see the end of the text there; so only
boundaries behind another character count. The pieces between those positions are encoded in parallel, each exactly as within the whole text.
Where an overlap holds no common boundary (one very long pre-token) the chunks are joined and
encoded as one piece, so results are always those of the whole text. Only the texts over
``chunk_chars`` are shuffled. Decoding concatenates the bytes of the ids.

The rank file and the pattern are parameters; nothing is trained and no file is copied.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Out, shuffle_partitions

CHUNK_CHARS = 32_768
OVERLAP = 512
_SEEN = 3          # characters that must follow a boundary for it to hold whatever comes later


def _source(vocab: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers as P

    return vocab or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN


@lru_cache(maxsize=4)
def encoding(vocab: str, pattern: str):
    """The tokenizer of a rank file; built once per Python worker."""
    import tiktoken

    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str, last: bool) -> np.ndarray:
    """Positions at which pre-tokens start, as far as the text after them settles it; unless ``last``, without those
    right after white space, where a piece may not end. The first position has no character before it and is left out."""
    import regex

    at = np.fromiter((m.start() for m in regex.finditer(pattern, text)), np.int64)
    if last:
        return at
    at = at[at <= len(text) - _SEEN]
    return at[[i > 0 and not text[i - 1].isspace() for i in at.tolist()]]


def _encode_rows(vocab, pattern):
    def run(batches):
        enc = encoding(vocab, pattern)
        for batch in batches:
            out = Out(pa.schema([*list(batch.schema)[:-1], pa.field("ids", pa.list_(pa.int32()))]))
            keys = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                ids = np.array(enc.encode_ordinary(text.as_py() or ""), np.int32)
                out.add(*[k[i] for k in keys], ids, size=ids.nbytes)
                if out.full:
                    yield out.take()
            yield out.take()

    return run


def _cut(chunk_chars, overlap):
    def run(batches):
        for batch in batches:
            fields = list(batch.schema)
            out = Out(pa.schema([*fields[:-1], pa.field("no", pa.int32()), pa.field("last", pa.bool_()), pa.field("chunk", pa.string())]))
            keys = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                text = value.as_py()
                for no, s in enumerate(range(0, len(text), chunk_chars)):
                    chunk = text[s: s + chunk_chars + overlap]
                    out.add(*[k[i] for k in keys], no, s + chunk_chars >= len(text), chunk, size=4 * len(chunk))
                    if out.full:
                        yield out.take()
            yield out.take()

    return run


def _zones(pattern, chunk_chars, overlap):
    def run(batches):
        for batch in batches:
            fields = list(batch.schema)
            ints = pa.list_(pa.int32())
            out = Out(pa.schema([*fields[:-2], pa.field("head", ints), pa.field("tail", ints)]))
            keys = [batch.column(i).to_pylist() for i in range(batch.num_columns - 2)]
            last = batch.column(batch.num_columns - 2).to_pylist()
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                at = boundaries(value.as_py(), pattern, False)
                out.add(*[k[i] for k in keys], at[at < overlap].astype(np.int32),
                        (at[at >= chunk_chars] - chunk_chars).astype(np.int32) if not last[i] else None)
            yield out.take()

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None,
           pattern: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``id_col, ids array<int>``: the token ids of every whole text, one row for each input row.

    Null and empty texts have no ids. Repeated rows and ids are kept as they come; other columns
    are left out, whatever their names. An empty table gives an empty table.
    """
    if overlap <= _SEEN or overlap >= chunk_chars:
        raise ValueError("overlap must lie between 4 and chunk_chars")
    vocab, pattern = _source(vocab, pattern)
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long_text = F.coalesce(F.char_length("text") > chunk_chars, F.lit(False))
    short = docs.filter(~long_text).mapInArrow(_encode_rows(vocab, pattern), f"id {id_type}, ids array<int>")

    # a text is known by a digest of id and text, so that rows that share an id stay apart; equal rows are one text, counted
    key = f"id {id_type}, key string"
    n = shuffle_partitions(df.sparkSession)
    chunks = (docs.filter(long_text)
              .select("id", F.md5(F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("-")), "text")).alias("key"), "text")
              .mapInArrow(_cut(chunk_chars, overlap), f"{key}, no int, last boolean, chunk string")
              .repartition(n, "key", "no"))
    zones = chunks.mapInArrow(_zones(pattern, chunk_chars, overlap),
                              f"{key}, no int, head array<int>, tail array<int>").dropDuplicates(["key", "no"])
    text = Window.partitionBy("key").orderBy("no")
    # where each chunk starts to hold: the first boundary that it shares with its left neighbour
    met = zones.withColumn("sync", F.array_min(F.array_intersect("head", F.lag("tail").over(text))))
    met = met.withColumn("sync", F.when(F.col("no") == 0, F.lit(0)).otherwise(F.col("sync")))
    met = met.select("key", "no", "sync", F.count("sync").over(text).alias("piece"),
                     F.lead("no").over(text).isNotNull().alias("more"), F.lead("sync").over(text).alias("next_sync"))
    # from a chunk's own start (or the text's overlap-free part) to where the next one takes over
    begin = F.coalesce(F.col("sync"), F.lit(0)) + 1
    stop = F.when(~F.col("more"), F.char_length("chunk")).otherwise(F.lit(chunk_chars) + F.coalesce(F.col("next_sync"), F.lit(0)))
    parts = chunks.join(met, ["key", "no"]).select(
        "id", "key", "no", "piece", F.col("sync").isNull().alias("torn"), (F.col("more") & F.col("next_sync").isNull()).alias("open"),
        F.col("chunk").substr(begin, stop - begin + 1).alias("part"))
    whole = parts.filter(~F.col("torn") & ~F.col("open")).select("id", "key", "piece", "part")
    # rows of one piece that spans chunks: joined in order, one of each (equal rows repeat them)
    joined = (parts.filter(F.col("torn") | F.col("open")).groupBy("id", "key", "piece")
              .agg(F.array_sort(F.collect_set(F.struct("no", "part"))).alias("ps"), F.count_if(~F.col("torn")).alias("copies"))
              .select("id", "key", "piece", F.array_join(F.transform("ps", lambda p: p["part"]), "").alias("part"), "copies"))
    joined = joined.select("id", "key", "piece", F.explode(F.array_repeat("part", F.col("copies").cast("int"))).alias("part"))
    pieces = whole.unionByName(joined).mapInArrow(_encode_rows(vocab, pattern), f"{key}, piece bigint, ids array<int>")
    texts = pieces.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("ps"),
                                           F.count_if(F.col("piece") == 1).cast("int").alias("copies"))
    once = F.filter("ps", lambda p, i: (i == 0) | (p["piece"] != F.element_at("ps", F.greatest(i, F.lit(1)))["piece"]))
    texts = texts.select("id", F.flatten(F.transform(once, lambda p: p["ids"])).alias("ids"), "copies")
    long_docs = texts.select("id", F.explode(F.array_repeat("ids", F.col("copies"))).alias("ids"))
    return short.unionByName(long_docs).withColumnRenamed("id", id_col)


def _decode_rows(vocab, pattern):
    def run(batches):
        enc = encoding(vocab, pattern)
        for batch in batches:
            out = Out(pa.schema([batch.schema.field(0), pa.field("bytes", pa.binary())]))
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, batch.column(1), strict=True):
                raw = enc.decode_bytes(ids.as_py() or [])
                out.add(key, raw, size=len(raw))
                if out.full:
                    yield out.take()
            yield out.take()

    return run


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """``id_col, bytes binary``: the concatenated bytes of the ids (null: empty)."""
    vocab, pattern = _source(vocab, pattern)
    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(_decode_rows(vocab, pattern), f"{id_col} {id_type}, bytes binary")


def _digest_rows(vocab, pattern):
    import hashlib

    def run(batches):
        enc = encoding(vocab, pattern)
        for batch in batches:
            out = Out(pa.schema([batch.schema.field(0), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()),
                                 pa.field("decoded_sha256", pa.string())]))
            keys, values = batch.column(0).to_pylist(), batch.column(1)
            for i, key in enumerate(keys):
                ids = values[i].as_py() or []
                out.add(key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                        hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield out.take()

    return run


def round_trip(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: str | None = None,
               pattern: str | None = None) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of an :func:`encode` result, decoded in the same pass."""
    vocab, pattern = _source(vocab, pattern)
    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(
        _digest_rows(vocab, pattern), f"{id_col} {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

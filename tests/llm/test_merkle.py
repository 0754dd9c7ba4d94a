import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from txrisk.llm import merkle
from txrisk.llm.queries import QUERIES
from txrisk.llm.runtime import ready

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tampered(row):
    doc, source, lang, n, text = row
    if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 3 == 0:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return leaf((doc, source, lang, n, text))


def tree(nodes, arity):
    """(root, siblings of each node on every level as (left, right))."""
    proofs = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            base = p - p % arity
            proofs[i].append(("".join(nodes[base:p]), "".join(nodes[p + 1: base + arity])))
        nodes = [sha(*nodes[i: i + arity]) for i in range(0, len(nodes), arity)]
        at = [p // arity for p in at]
    return nodes[0], proofs


def brute_force(rows, arity=8):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append((members, *tree([leaf(r) for r in members], arity)))
    root, over = tree([m[1] for m in made], arity)
    for (members, sub, proofs), up in zip(made, over):
        for r, low in zip(members, proofs):
            path = low + up
            acc = tampered(r)
            for left, right in path:
                acc = sha(left, acc, right)
            yield (r[0], leaf(r), sub, root, sha(*[a + b for a, b in path]), acc, acc == root)


def got(df, arity=8):
    rows = merkle.manifest(df, FIELDS, "doc_id", "lang", arity, merkle.tampered(df, FIELDS, "doc_id", "text"))
    return [tuple(r) for r in merkle.verified(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def corpus(n, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if rnd.random() < 0.5 else rnd.choice(["de", None, "", "zz", "\u00e9", "fr"])
        text = rnd.choice([None, "", "Some Text", "lower only", "\u00c4 A " * 5]) if rnd.random() < 0.5 else f"Words {i} Up"
        rows.append((i, rnd.choice(["a", None, "12:x"]), lang, rnd.choice([None, i]), text))
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n,arity", [(150, 8), (37, 2), (40, 3), (9, 8), (1, 8)])
def test_equal_to_brute_force(spark, n, arity):
    ready(spark)
    rows = corpus(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(got(df, arity)) == sorted(brute_force(rows, arity))


def test_repeated_rows_null_keys_long_text_and_other_columns(spark):
    ready(spark)
    rows = corpus(20) + [(None, None, None, None, None)] * 3 + [(5, "s", "en", 1, "Twice")] * 4 + [(700, "s", "long", 3, "Word " * 400_000)]
    wide = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA + ", pos int, digest string, n int, tree string").repartition(4)
    assert sorted(got(wide), key=str) == sorted(brute_force(rows), key=str)


def test_empty_table(spark):
    ready(spark)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_one_group_holds_most_rows_without_filling_one_task(spark):
    ready(spark)
    df = spark.range(20_000).selectExpr("'1a' AS tree", "id AS key", "sha2(cast(id as string), 256) AS digest")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places = merkle.numbered(df, "key")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert places.selectExpr("count(*)", "count(distinct pos)", "min(pos)", "max(pos)", "max(n)", "sum(int(pos = key))").first()[:] == (20_000, 20_000, 0, 19_999, 20_000, 20_000)
    sizes = places.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]      # rows that one task wrote
    assert sizes < 10_000


def test_query_shape_and_sensitivity(spark, sf001):
    rows = QUERIES["op13_merkle"](spark, sf001).collect()
    held = {r.doc_id: r.verified for r in rows}
    assert len(rows) == len(held) and len({r.root for r in rows}) == 1
    assert all(held[i] for i in held if zlib.crc32(str(i).encode()) % 3)
    assert not all(held.values())

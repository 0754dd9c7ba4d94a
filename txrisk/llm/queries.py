"""The registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query("op8_byte_bpe")
def op8_byte_bpe(spark, sf_dir):
    """Token ids of every document and their decoding, as digests."""
    from .bpe import encode, round_trip

    return round_trip(encode(table(spark, sf_dir, "documents")))


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM bw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
found AS (SELECT doc_id, i, o.n, item FROM occ o JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""


@query("op9_decontamination", OP9_SQL)
def op9_decontamination(spark, sf_dir):
    """Words of benchmark passages in every document."""
    from .decontam import digest, hits

    return digest(hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op4_near_duplicates")
def op4_near_duplicates(spark, sf_dir):
    """Near-duplicate classes of all documents."""
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM dw, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
own AS (SELECT s, min(doc_id) AS owner FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (
  SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (s) WHERE owner < doc_id)),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM dw LEFT JOIN lists USING (doc_id)
"""


@query("op6_repeated_passages", OP6_SQL)
def op6_repeated_passages(spark, sf_dir):
    """Documents without the 50-word passages that an earlier document holds."""
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_fingerprints")
def op1_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3_quality(spark, sf_dir):
    """Quality score of every document."""
    from . import quality
    from .learn import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.fit(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 3) != 1))
    return quality.score(docs, machine).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_language")
def op10_language(spark, sf_dir):
    """Language of every document."""
    from . import langid
    from .learn import remainder

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(remainder("doc_id", 3) != 1))
    return langid.predict(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    from . import toxicity
    from .learn import remainder

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP5_SQL = r"""
WITH l AS (SELECT source, doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
total AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT l.source, line FROM l JOIN total t ON l.source IS NOT DISTINCT FROM t.source
  WHERE regexp_matches(line, '[^ \t\r\x0B\x0C]') GROUP BY l.source, line, total
  HAVING count(*) >= 5 AND count(*) / total > 0.1),
lists AS (SELECT source, list(line) AS ls FROM bad GROUP BY source),
cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls, CASE WHEN b.ls IS NULL THEN string_split(text, chr(10))
         ELSE list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(b.ls, x)) END AS kept
  FROM documents d LEFT JOIN lists b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM cut
"""


@query("op5_line_dedup", OP5_SQL)
def op5_line_dedup(spark, sf_dir):
    """Documents without the lines that are boilerplate on their site."""
    from .lines import drop_boilerplate

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, n_lines="n_lines", n_removed="n_removed").select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_pseudonyms")
def op7_pseudonyms(spark, sf_dir):
    """Documents with format-preserving pseudonyms for personal values (a fixed key, for repeatable results)."""
    from .pii import pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, "demonstration key", count_col="n_values")


#: crc32 of the decimal doc_id, bit by bit over its bytes
CRC32_SQL = """list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
         lambda crc, b: list_reduce([xor(crc, b)] || [0::BIGINT for k in range(8)],
                                    lambda v, k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))"""

OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT *, xor({CRC32_SQL}, 4294967295::BIGINT) AS crc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
f AS (
  SELECT doc_id, lang, crc,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS text, coalesce(strlen(low) || ':' || low, '-') AS low FROM d),
leaves AS (
  SELECT doc_id, lang, sha256(head || text) AS leaf, sha256(head || CASE WHEN crc % 3 = 0 THEN low ELSE text END) AS probe,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f),
nodes AS (
  SELECT lang, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n),
subs AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subs
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
root AS (SELECT digest AS root FROM tops WHERE n = 1),
sib AS (
  SELECT a.lang, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.pos // 8 = b.pos // 8
  WHERE a.n > 1 GROUP BY a.lang, a.level, a.pos),
topsib AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM tops a JOIN tops b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.level, a.pos),
walk AS (
  SELECT doc_id, lang, 0 AS level, pos, probe AS acc, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, w.lang, w.level + 1, w.pos // 8, sha256(l || acc || r), proof || l || r
  FROM walk w JOIN sib s ON w.lang IS NOT DISTINCT FROM s.lang AND w.level = s.level AND w.pos = s.pos),
reached AS (SELECT doc_id, lang, acc, proof FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) AS k FROM walk) WHERE k = 1),
climb AS (
  SELECT doc_id, 0 AS level, pos, acc, proof FROM reached r JOIN subs s ON r.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, c.level + 1, c.pos // 8, sha256(l || acc || r), proof || l || r FROM climb c JOIN topsib s ON c.level = s.level AND c.pos = s.pos),
done AS (SELECT doc_id, acc, proof FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) AS k FROM climb) WHERE k = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM leaves JOIN subs ON leaves.lang IS NOT DISTINCT FROM subs.lang JOIN done USING (doc_id), root
"""


@query("op13_merkle", OP13_SQL)
def op13_merkle(spark, sf_dir):
    """Merkle leaf, proof and verification of every document."""
    from . import merkle

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*fields)
    rows = merkle.manifest(docs, fields, "doc_id", "lang", probe=merkle.tampered(docs, fields, "doc_id", "text"))
    return merkle.verified(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, xor({CRC32_SQL}, 4294967295::BIGINT) AS h FROM documents),
e AS (SELECT *, len(o) AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) ELSE len(o) END AS a FROM d),
t AS (
  SELECT doc_id, n, CASE WHEN a = n THEN o ELSE o[:a] || list_transform(range(0, n - a), lambda i: o[a + i % (1 + (n - a) // (3 + (h // 10) % 8)) + 1]) END AS w
  FROM e),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM t),
same AS (SELECT l.doc_id, l.i, r.i - l.i AS p FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND (r.i - l.i) * 2 <= l.n),
isle AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM same),
stretch AS (SELECT doc_id, p, min(i) AS s, max(i) + p + 1 AS e FROM isle GROUP BY doc_id, p, k HAVING max(i) + p + 1 - min(i) >= greatest(12, 2 * p)),
run AS (SELECT doc_id, s, e - s AS l, min(p) AS p FROM stretch GROUP BY doc_id, s, e),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, p) AS k FROM run),
lists AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS txt FROM run GROUP BY doc_id),
gone AS (SELECT doc_id, list(i) AS ps FROM (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM run) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, p AS period, (1000 * l) // p AS exponent_milli,
       sha256(coalesce(txt, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(ps, i - 1)) END, ' ')) AS collapsed_sha256
FROM t LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (doc_id) LEFT JOIN lists USING (doc_id) LEFT JOIN gone USING (doc_id)
"""


@query("op11_periodic_runs", OP11_SQL)
def op11_periodic_runs(spark, sf_dir):
    """Periodic runs of words in every document, with repetitions planted in a tenth of them."""
    from .periodic import longest, periodic_runs, with_repeats

    docs = with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs).withColumn("best", longest(F.col("runs")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP12_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s, least(len(w), 4) AS k
      FROM dw, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.k = y.k AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM dw UNION SELECT r.a, w.b FROM reach r JOIN way w ON r.b = w.a)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, min(b) AS component_id FROM dw LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = dw.doc_id GROUP BY dw.doc_id, n.n
"""


@query("op12_ngram_join", OP12_SQL)
def op12_ngram_join(spark, sf_dir):
    """Classes of documents linked by their word 4-grams."""
    from .ngramjoin import ngram_classes

    return ngram_classes(table(spark, sf_dir, "documents"))

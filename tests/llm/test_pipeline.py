"""Each stage of the corpus pipeline against a brute-force version, over a small planted corpus."""
import random
import re

import pytest

import corpus_pipeline as P
from txrisk.llm import decontam, quality
from txrisk.llm.runtime import ready

from test_bpe import expected
from test_neardup import brute_force, near_group

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7)))
    bench = [("b1", " ".join(word() for _ in range(14))), ("b2", " ".join(word() for _ in range(30)))]
    docs, labels = [], []
    for i in range(160):
        bad = i % 5 == 0
        text = "\n".join(" ".join(word() + ("###" if bad else "") for _ in range(rnd.randint(5, 12))) for _ in range(rnd.randint(2, 6)))
        if i % 3 == 0:
            text = "All rights reserved here.\n" + text
        if i % 17 == 1:
            text += " " + bench[i % 2][1]
        docs.append((i, text))
        labels.append((i, 0 if bad else 1))
    docs += [(200 + j, t) for j, t in enumerate(near_group(rnd, 12, 80, 0.03))] + [(300, docs[1][1]), (301, docs[2][1]), (302, None), (303, ""), (304, bench[1][1])]
    return [(i, t, "en", f"s{i % 2}" if i % 31 else None, len(t) if t is not None else None) for i, t in docs], labels, bench


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    ready(spark)
    root = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, bench = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_stage_keeps_good_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = P.quality_classifier(spark, docs, tables)
    assert out.columns == docs.columns
    got = rows(out)
    _, labels, _ = corpus()
    kept = {r[0] for r in got}
    wrong = [i for i, q in labels if (i in kept) != bool(q)]
    assert len(wrong) <= 3 and set(got) <= set(rows(docs)) and {*range(200, 212)} <= kept
    machine = quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet").filter(P.remainder("doc_id", 3) != 1))
    assert kept == {r["doc_id"] for r in quality.score(docs, machine).collect() if r["score"] >= 0.5}


def test_line_stage_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    raw = [tuple(r) for r in docs.collect()]
    total, have = {}, {}
    for _, t, _, s, _ in raw:
        total[s] = total.get(s, 0) + 1
        for x in set(t.split("\n")) if t is not None else ():
            have[s, x] = have.get((s, x), 0) + 1
    want = []
    for i, t, lang, s, _ in raw:
        new = "\n".join(x for x in t.split("\n") if not (x.strip() and have[s, x] >= 5 and have[s, x] > 0.1 * total[s])) if t is not None else None
        want.append((i, new, lang, s, len(new) if new is not None else None))
    out = P.line_dedup(spark, docs, tables)
    assert out.columns == docs.columns and rows(out) == sorted(want, key=str)
    assert any(w[1] != r[1] for w, r in zip(want, raw, strict=True))


def test_near_duplicate_stage_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    raw = [tuple(r) for r in docs.collect()]
    kept = {i for i, _, _, k in brute_force([(r[0], r[1]) for r in raw]) if k}
    out = P.near_duplicates(spark, docs, tables)
    assert out.columns == docs.columns and rows(out) == sorted((r for r in raw if r[0] in kept), key=str)
    assert len(kept) < len(raw)


def test_decontamination_stage_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    raw = [tuple(r) for r in docs.collect()]
    items = corpus()[2]
    hit = {i: (n, h) for i, n, h, *_ in decontam.brute_force([(r[0], r[1]) for r in raw], items)}
    out = P.decontamination(spark, docs, tables)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns
    assert set(got) == {i for i, (n, h) in hit.items() if h == 0 or h <= 0.5 * n}
    for i, t, *_ in raw:
        if i in got and not hit[i][1]:
            assert got[i]["text"] == t
        elif i in got:
            words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())
            assert len(words(got[i]["text"])) == hit[i][0] - hit[i][1] and got[i]["n_chars"] == len(got[i]["text"])
    assert any(h for _, h in hit.values()) and 304 not in got
    again = decontam.digest(decontam.hits(out, spark.read.parquet(f"{tables}/benchmark.parquet"))).filter("contaminated")
    assert again.count() == 0


def test_run_applies_all_stages_in_order(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = P.saved(stage(spark, docs, tables))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(P.run(spark, tables)) == sorted(expected(texts), key=str)
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]


def test_empty_tables(spark, tmp_path):
    ready(spark)
    root = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    assert P.run(spark, root).count() == 0

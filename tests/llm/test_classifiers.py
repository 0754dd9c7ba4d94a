import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txrisk.llm import langid, quality, toxicity, vec
from txrisk.llm.learn import remainder
from txrisk.llm.queries import QUERIES
from txrisk.llm.runtime import ready

ALPHABETS = {"aa": "lorem ipsum dolor amet", "bb": "straße über grün wächst", "cc": "niño está mañana aquí"}


def language_rows(n, seed):
    rnd = random.Random(seed)
    return [(i, " ".join("".join(rnd.sample(rnd.choice(ALPHABETS[lang].split()), 3)) for _ in range(20)), lang)
            for i, lang in enumerate(rnd.choices(list(ALPHABETS), k=n))]


def test_language_of_unseen_texts(spark):
    ready(spark)
    df = spark.createDataFrame([*language_rows(150, 1), (900, None, "aa"), (901, "lorem", None), (902, "123", "bb"), (None, "lorem", "aa")],
                               "doc_id long, text string, lang string")
    model = langid.fit(df, per_lang=40)
    assert model.langs == ["aa", "bb", "cc"] and 0 < (model.weights != 0).mean() < 0.5
    test = [(i, t, "x", 1) for i, t, _ in language_rows(60, 2)] + [(70, None, "x", 1), (71, "", "x", 1), (72, "12 %", "x", 1), (None, "ipsum " * 50_000, "x", 1),
                                                                  (0, "ipsum", "x", 1)]
    got = langid.predict(spark.createDataFrame(test, "doc_id long, text string, score string, lang_pred int"), model).collect()
    assert len(got) == len(test) and all(0 <= r["score"] <= 1 for r in got)
    want = {i: lang for i, _, lang in language_rows(60, 2)}
    assert sum(want.get(r["doc_id"]) == r["lang_pred"] for r in got) >= 57
    assert {r["lang_pred"] for r in got if r["doc_id"] in (70, 71, 72)} == {"und"}


def test_language_without_training_rows_or_texts(spark):
    ready(spark)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [tuple(r) for r in langid.predict(df, model).collect()] == [(1, "und", 0.0)]
    assert langid.predict(none, model).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=30))
def test_ngram_counts_equal_brute_force(text):
    def bucket(gram):
        c = [ord(x) for x in gram]
        m = 1 << 64
        h = (c[0] + 1) * int(langid._M1) % m
        if len(c) > 1:
            h = (h ^ (c[1] + 7)) * int(langid._M2) % m
        if len(c) > 2:
            h = (h ^ (c[2] + 13)) * int(langid._M3) % m
        return h >> 49

    low = text.lower()
    want = {}
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            b = bucket(low[i: i + n])
            want[b] = want.get(b, 0) + 1
    assert dict(zip(*(x.tolist() for x in langid.ngram_counts(text)), strict=True)) == want


def test_long_texts_count_like_short_ones(monkeypatch):
    text = "abcdefgh äöü " * 50
    whole = [x.tolist() for x in langid.ngram_counts(text)]
    monkeypatch.setattr(langid, "_SEGMENT", 64)
    assert [x.tolist() for x in langid.ngram_counts(text)] == whole


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10 ** 6))
def test_factorisation_machine_equals_all_pairs(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    m = quality.Machine(0.3, rng.normal(size=12), rng.normal(size=(12, 3)))
    at, x = rng.choice(12, 5, replace=False), rng.normal(size=5)
    pairs = sum(m.v[i] @ m.v[j] * a * b for (i, a), (j, b) in itertools.combinations(zip(at, x, strict=True), 2))
    assert m.logit(at, x) == pytest.approx(0.3 + x @ m.w[at] + pairs)


def quality_rows(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7)))
    return [(i, " ".join(word() + ("###" if bad else "") for _ in range(rnd.randint(3, 60))), int(not bad)) for i, bad in enumerate(rnd.choices([0, 1], k=n))]


def test_quality_of_unseen_texts(spark):
    ready(spark)
    schema = "doc_id long, text string, quality int, n_chars long"
    train = spark.createDataFrame([(i, t, q, len(t)) for i, t, q in quality_rows(200, 1)] + [(900, None, 1, None), (901, "x", None, 1)], schema)
    m = quality.fit(train, train, per_label=60)
    rows = [(i, t, q, len(t)) for i, t, q in quality_rows(80, 2)] + [(90, None, 0, None), (91, "", 0, 0), (None, "a " * 100_000, 0, 1), (1, "a", 0, 1)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in quality.score(df, m).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    want = {i: q for i, _, q in quality_rows(80, 2)}
    assert sum((s >= 0.5) == want[i] for (i, s), r in zip(got, rows, strict=True) if i in want and r[1] != "a") >= 76
    kept = quality.keep_good(df, m)
    assert kept.schema == df.schema and kept.count() == sum(s >= 0.5 for _, s in got)
    assert quality.score(df.limit(0), m).count() == 0


def test_quality_with_one_class_or_none(spark):
    ready(spark)
    df = spark.createDataFrame([(1, "a b", 1, 3)], "doc_id long, text string, quality int, n_chars long")
    assert quality.score(df, quality.fit(df, df)).first()["score"] > 0.9
    assert quality.score(df, quality.fit(df, df.limit(0))).first()["score"] == 0.5


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeilmnorstu", k=rnd.randint(2, 9)))
    bad = ["moronic", "idiot", "stupid"]
    return [(i, " ".join([word() for _ in range(30)] + ([rnd.choice(bad)] if t else []) + [word() for _ in range(10)]), t) for i, t in enumerate(rnd.choices([0, 0, 1], k=n))]


@pytest.fixture(scope="module")
def toxic(spark):
    ready(spark)
    df = spark.createDataFrame([*toxic_rows(400, 1), (900, None, 1), (901, "x", None)], "doc_id long, text string, toxic int")
    return toxicity.fit(df, df)


def test_obfuscated_words_are_restored(toxic):
    for text, word in (("an 1d10t x", "idiot"), ("i d i o t!", "idiot"), ("stuuuupid one", "stupid"), ("$tup1d", "stupid"), ("i.d.i.o.t", "idiot")):
        assert word in toxicity.restore_text(text, toxic.characters), text
    for text in ("plain words, no change at 12:30", "année 2024", "", " \n"):
        assert toxicity.restore_text(text, toxic.characters) == text


def test_toxicity_of_unseen_and_disguised_texts(spark, toxic):
    rows = toxic_rows(120, 2)
    disguise = str.maketrans({"i": "1", "o": "0", "s": "$"})
    extra = [(500, None), (501, ""), (502, "what a stupid thing".translate(disguise)), (None, "dull " * 60_000), (0, "dull")]
    df = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(*e, 1) for e in extra], "doc_id long, text string, score int")
    got = [tuple(r) for r in toxicity.score(df, toxic).collect()]
    assert len(got) == 125 and all(0 <= s <= 1 for _, s in got)
    assert sum((s >= 0.5) == bool(t) for (_, s), (_, _, t) in zip(got, rows, strict=False)) >= 116
    scores = [s for _, s in got[120:]]
    assert scores[0] == scores[1] < 0.5 and scores[2] >= 0.5 and scores[3] < 0.5
    assert toxicity.score(df.limit(0), toxic).count() == 0


def test_toxicity_with_one_class(spark):
    ready(spark)
    df = spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, toxic int")
    assert toxicity.score(df, toxicity.fit(df, df)).first()["score"] < 0.1


def test_viterbi_equals_trying_all_paths(toxic):
    logp = toxic.characters.logp
    for token in ("1d10t", "st*pid", "aab", "i d", "x$$y", "00"):
        best = max(
            ((sum(c for _, c in path) + _lm("".join(x for x, _ in path), logp), "".join(x for x, _ in path))
             for path in itertools.product(*toxicity.lattice(token))), key=lambda p: p[0])
        got = toxicity.decode(token, toxic.characters)
        alternatives = [sum(c for _, c in path) + _lm(got, logp) for path in itertools.product(*toxicity.lattice(token)) if "".join(x for x, _ in path) == got]
        assert max(alternatives) == pytest.approx(best[0]), token


def _lm(text, logp):
    a = b = total = 0
    for ch in text:
        c = toxicity.letter_class(ch)
        total += logp[a, b, c]
        a, b = b, c
    return total + logp[a, b, 0]


@pytest.mark.parametrize("name,label,folds,held,least", [("op3_quality", "quality", 3, 1, 0.95), ("op10_language", "lang", 3, 1, 0.97)])
def test_held_out_accuracy(spark, sf01, name, label, folds, held, least):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    labels = docs.select("doc_id", "lang") if label == "lang" else spark.read.parquet(f"{sf01}/labels.parquet")
    out = QUERIES[name](spark, sf01).join(labels, "doc_id").withColumn("fold", remainder("doc_id", folds)).collect()
    assert all(r["held_out"] == (r["fold"] == held) for r in out)
    right = [r["lang_pred" if label == "lang" else "predicted"] == r[label] for r in out if r["held_out"]]
    assert sum(right) / len(right) >= least


def test_blocks_of_words():
    texts = ["Ab  c\n", None, "", "é-x" * 3, "w" * 5000]
    got = [(b.row + d, b.data[s:e].tobytes()) for b in vec.blocks(pa.array(texts), vec.ALNUM, False, 8) for d in range(b.rows)
           for s, e in zip(b.start[b.first[d]: b.first[d + 1]], b.end[b.first[d]: b.first[d + 1]], strict=True)]
    assert got == [(0, b"b"), (0, b"c"), (3, "é".encode()), (3, "xé".encode()), (3, "xé".encode()), (3, b"x"), (4, b"w" * 5000)]


def _characters(texts):
    import pyarrow as pa

    count = np.zeros(toxicity.CLASSES ** 3, np.int64)
    for b in toxicity._trigram_rows([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]):
        count[b.column(0).to_numpy()] += b.column(1).to_numpy()
    return toxicity.CharacterModel.of(count)


CLEAN = ("the committee has an address near the football ground and the vacuum of skiing needs success\n"
         "you are welcome to a great lesson about letters and little apples in the class room! see (page 2) for more, it isn't re-use.\n"
         "un étudiant de l'école voit les pommes et les élèves")


def test_all_three_channels_together(sf01):
    import duckdb

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf01}/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    model = _characters(texts + [CLEAN] * 5 + ["idiot stupid moron asshole dumbass shit the idiot is a stupid moron and an asshole"] * 30)
    restored = {t: toxicity.restore_text(t, model) for t in (
        "i d 1 0 t", "s h 1 t", "s h ! t", "m o r 0 n", "iiddiioott", "stuupiid", "dumba$$", "a££hole", "@$$hole", "id1ot", "st*pid", "1d10t")}
    assert restored == {"i d 1 0 t": "idiot", "s h 1 t": "shit", "s h ! t": "shit", "m o r 0 n": "moron", "iiddiioott": "idiot", "stuupiid": "stupid",
                        "dumba$$": "dumbass", "a££hole": "asshole", "@$$hole": "asshole", "id1ot": "idiot", "st*pid": "stupid", "1d10t": "idiot"}
    for plain in ("the committee has an address near the football ground", "a great lesson about letters!", "50€ or 20£ (page 2)", "vacuum skiing success", "a b 1 2 3 4 5"):
        assert toxicity.restore_text(plain, model) == plain


def test_long_tokens_are_decoded_whole():
    model = _characters([CLEAN] * 3 + ["idiot stupid " * 20])
    word = "idi0t" * 40
    assert toxicity.decode(word, model) == toxicity.restore_text(word, model) and len(word) > 64
    # the state is carried over: what comes later in the word decides as in a short one
    assert toxicity.decode("x" * 61 + "stup1d", model)[-6:] == toxicity.decode("xstup1d", model)[-6:] == "stupid"
    assert len(toxicity.decode("a0" * 100_000, model)) >= 100_000


def test_doubled_letters_are_told_in_linear_time():
    import itertools
    import re

    plain = re.compile(r"(?:([^\W\d_])\1+){3,}")
    for n in range(11):
        for word in map("".join, itertools.product("ab" if n > 7 else "ab1", repeat=n)):
            assert bool(plain.fullmatch(word)) == bool(toxicity._ALL_DOUBLED.fullmatch(word)), word
    assert toxicity._ALL_DOUBLED.fullmatch("x" * 100_001) and not toxicity._ALL_DOUBLED.fullmatch("x" * 100_000 + "1")

import random
import re
import zlib

import numpy as np
import pytest

from txrisk.llm import periodic
from txrisk.llm.runtime import ready


def brute_force(words, least=periodic.LEAST):
    """(start, length, period) of every run: all periods, word by word."""
    n, ends = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            s = i
            while i < n - p and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, 2 * p):
                ends.setdefault((s, i + p), p)
            i += 1
    return sorted(((s, e - s, p) for (s, e), p in ends.items()), key=lambda r: (r[0], r[2]))


def planted(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def words_of(rnd):
    kinds, n = rnd.choice([1, 2, 3, 5, 30]), rnd.randint(0, 90)
    w = [rnd.randrange(kinds) for _ in range(n)]
    if n and rnd.random() < 0.6:
        a, p = rnd.randrange(n), rnd.randint(1, 30)
        w[a:] = [w[a + (i - a) % min(p, n - a)] for i in range(a, n)]
    return w * 3 if rnd.random() < 0.3 else w


def hashes(words):
    return np.array([(x + 1) * 0x9E3779B97F4A7C15 % 2 ** 64 for x in words], np.uint64)


@pytest.mark.parametrize("piece", ["all", "words", "pieces"])
def test_catchers_equal_brute_force_however_words_are_appended(piece):
    rnd = random.Random(piece)
    for _ in range(15):
        docs = [words_of(rnd) for _ in range(rnd.randint(1, 3))]
        least = rnd.choice([1, 2, 12])
        h, starts = hashes([x for d in docs for x in d]), np.cumsum([0, *map(len, docs)])
        want = [(s + z, p, s + n + z) for d, z in zip(docs, starts.tolist()) for s, n, p in brute_force(d, least)]
        c, i = periodic.SquareCatchers(least), 0
        while i < len(h):
            k = {"all": len(h), "words": 1, "pieces": rnd.randint(1, 40)}[piece]
            c.append(h[i: i + k], [x - i for x in starts[:-1].tolist() if i <= x < i + k])
            i += k
        s, e, p = c.runs()
        assert list(zip(s.tolist(), p.tolist(), e.tolist())) == sorted(want)


def test_a_square_is_reported_with_the_word_that_completes_it():
    c = periodic.SquareCatchers()
    seen = [c.append(hashes([x])) for x in [1, 2, 3, 4, 5, 2, 3, 4, 5, 2, 9]]
    assert [x for x in seen if x] == [[(1, 4)]] and seen[8] == [(1, 4)]


def test_a_lying_sum_is_corrected():
    c = periodic.SquareCatchers()
    w = [1, 2, 3, 4, 5, 6, 7] * 3 + [50, 51, 52]
    c.append(hashes(w))
    c.done.append((0, 24, 7))                                   # as if the sums had run past the end
    s, e, p = c.runs()
    assert list(zip(s.tolist(), e.tolist(), p.tolist())) == [(0, 21, 7)]


def test_structured_words():
    fib, thue = [0, 1], [0]
    while len(fib) < 400:
        fib = fib + fib[:-1] if len(fib) % 2 else fib + [0, 1, 0][: 400 - len(fib)]
    while len(thue) < 512:
        thue += [1 - x for x in thue]
    for w in (fib[:400], thue, [7] * 300, [1, 2] * 150 + [1, 2] * 3 + [5] + [2, 1] * 40):
        c = periodic.SquareCatchers(4)
        c.append(hashes(w))
        s, e, p = c.runs()
        assert list(zip(s.tolist(), (e - s).tolist(), p.tolist())) == brute_force(w, 4)


def corpus():
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{x}" for x in words_of(rnd)) + rnd.choice(["", "\n", " \t\v"])) for i in range(150)]
    return rows + [(900, None), (901, ""), (902, " \n"), (None, "a b " * 20), (None, None), (903, "x"), (903, "é b é b " * 6), (903, "é b é b " * 6)]


def test_texts_equal_brute_force_with_planted_repetitions(spark):
    ready(spark)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, h int, w string, runs int").repartition(4)
    got = periodic.periodic_runs(periodic.with_repeats(df)).collect()
    want = []
    for doc, text in rows:
        w = planted(doc, text)
        runs = brute_force(w)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        want.append((doc, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(want, key=str)
    assert any(len(w[2]) > 1 for w in want)


def test_longest_run_and_ties(spark):
    ready(spark)
    rows = [(1, " ".join(["a b c"] * 5 + ["x"] + ["d e f"] * 5)), (2, "plain words only"), (3, "z " * 12 + "y " * 14)]
    found = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    best = {r.doc_id: r.best and tuple(r.best) for r in found.withColumn("best", periodic.longest(found.runs)).collect()}
    assert best == {1: (0, 15, 3), 2: None, 3: (12, 14, 1)}


def test_very_long_text_and_empty_table(spark):
    ready(spark)
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(30_000)]
    words = base + base + base[:1000] + ["end"] + ["ha"] * 60_000
    found = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in found.runs] == [(0, 61_000, 30_000), (61_001, 60_000, 1)]
    assert found.collapsed == " ".join([*base, "end", "ha"])
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txrisk.llm import decontam
from txrisk.llm.runtime import ready

ITEMS = [("a", "one two three four five six seven eight nine ten eleven twelve"), ("b", "Short, item"), ("b2", "short ITEM!"), (None, "lost words here"),
         ("c", None), ("d", "  "), ("e", "x x x x x x x x x x x"), ("f", "ünï çödé wörds in an item of more than ten different words")]
DOCS = [(1, "zero one TWO three four five six seven eight nine ten eleven x"), (2, "a short item and a short-item"), (3, "x " * 40), (4, None), (5, ""),
        (6, "one two three four five six seven eight nine"), (7, "an ünï çödé wörds in an item of more than ten different words"),
        (None, "short item"), (1, "short item"), (1, "short item"), (8, "lost words here")]


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "q", 1) for r in docs], "doc_id long, text string, items string, n_words int")
    b = spark.createDataFrame(items, "item_id string, text string")
    return [tuple(r) for r in decontam.digest(decontam.hits(d, b, **kw)).collect()]


def test_hits_equal_brute_force(spark):
    ready(spark)
    assert sorted(run(spark, DOCS, ITEMS), key=str) == sorted(decontam.brute_force(DOCS, ITEMS), key=str)
    assert sorted(run(spark, DOCS, []), key=str) == sorted(decontam.brute_force(DOCS, []), key=str)
    assert run(spark, [], ITEMS) == []


def test_blocks_of_items_give_the_same(spark):
    ready(spark)
    docs = list(dict.fromkeys(DOCS))
    assert sorted(run(spark, docs, ITEMS, block_bytes=40), key=str) == sorted(decontam.brute_force(docs, ITEMS), key=str)


def test_several_blocks_keep_repeated_rows_and_clean_alike(spark):
    ready(spark)
    assert sorted(run(spark, DOCS, ITEMS, block_bytes=100), key=str) == sorted(decontam.brute_force(DOCS, ITEMS), key=str)
    words = [f"w{i}" for i in range(40)]
    items = [(f"i{k}", " ".join(words[k: k + 12])) for k in (0, 6, 12, 28)]         # overlapping, one apart
    fill = lambda n: " ".join(f"f{i}" for i in range(n))
    texts = [f"{fill(50)} {' '.join(words[:24])} end", f"{' '.join(words[:12])} {fill(10)} {' '.join(words[28:])}",      # 24 of 34 words: gone
             f"{fill(40)} {' '.join(words[:5])} {' '.join(words[28:])} {' '.join(words[5:10])}", None, "", "same", "same"]  # cut: no new window
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, hit_bounds int")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = [sorted(map(tuple, decontam.clean(d, b, block_bytes=n).collect())) for n in (30, 1 << 30)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [0, 2, 3, 4, 5, 6]
    assert got[0][0][1] == f"{fill(50)}  end" and got[0][1][1] == f"{fill(40)} w0 w1 w2 w3 w4  w5 w6 w7 w8 w9"


WORDS = st.lists(st.sampled_from("ab"), max_size=14).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=4), WORDS, st.integers(1, 5), st.sampled_from([1, 3, 1000]))
def test_automaton_equals_brute_force(items, doc, window, piece_words):
    import numpy as np

    rows = [(str(i), t) for i, t in enumerate(items)]
    block = decontam.Items(rows, window, piece_words)          # items longer than a piece lie over several
    h = decontam.vec.words(np.frombuffer(doc.encode(), np.uint8), decontam.vec.ALNUM, True)[2]
    hit, found = np.zeros(len(h), bool), set()
    for s, e in zip(*block.stretches(block.numbers(h), np.array([0, len(h)])), strict=True):
        block.scan(block.numbers(h[s:e]), hit, int(s), found)
    want = next(decontam.brute_force([(0, doc)], rows, window))
    assert (int(hit.sum()), len(found)) == want[2:4]


def test_clean_cuts_passages_and_drops_covered_documents(spark):
    ready(spark)
    d = spark.createDataFrame([(1, "keep this. Short  ITEM, and all of this", 5), (2, "short item", 6), (3, None, 7), (4, "clean", 8)], "doc_id long, body string, text int")
    b = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = sorted(map(tuple, decontam.clean(d, b, text_col="body").collect()))
    assert got == [(1, "keep this. , and all of this", 5), (3, None, 7), (4, "clean", 8)]


@pytest.mark.parametrize("text", ["word " * 200_000])
def test_very_long_text(spark, text):
    ready(spark)
    assert run(spark, [(1, text)], [("i", "word " * 10)])[0][1:4] == (200_000, 200_000, 1)


def test_memory_of_a_block_follows_its_text():
    """What a worker holds of a megabyte of items: some megabytes, not the maps that the automata are built from."""
    import pickle
    import random
    import subprocess
    import sys
    import tempfile

    rnd = random.Random(1)
    rows = [(str(i), " ".join(f"w{int(rnd.paretovariate(0.3)) % 40_000}" for _ in range(200))) for i in range(1500)]
    rows += [("long", " ".join(f"u{i}" for i in range(200_000)))]
    text_bytes = sum(len(t) for _, t in rows)
    with tempfile.NamedTemporaryFile(suffix=".pickle") as f:
        pickle.dump(decontam.Items(rows, 10), f)
        f.flush()
        assert f.tell() < 15 * text_bytes
        code = ("import resource, pickle, sys; sys.path.insert(0, '.'); import txrisk.llm.decontam; m = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;"
                f"a = m(); x = pickle.load(open({f.name!r}, 'rb')); print((m() - a) * 1024, len(x.automata))")
        grown, automata = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-2:]
    assert int(grown) < 40 * text_bytes and int(automata) > 2

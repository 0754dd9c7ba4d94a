import random
import re

import numpy as np
import pytest

from tests.llm.test_neardup import brute_force, near_group
from txrisk.llm import ngramjoin
from txrisk.llm.runtime import ready


def corpus(seed):
    rnd = random.Random(seed)
    texts = [" ".join(f"v{rnd.randrange(3000)}" for _ in range(rnd.randint(1, 80))) for _ in range(50)]
    texts += [t for t in texts[:12] for _ in range(2)]
    texts += near_group(rnd, 60, 120, 0.05) + near_group(rnd, 25, 40, 0.03)
    shared = " ".join(f"p{i}" for i in range(40))
    texts += [f"{shared} {t}" for t in texts[:25]]
    # the same few sentences in many orders and lengths: long common beginnings in the trees
    parts = [" ".join(f"s{j}x{i}" for i in range(9)) for j in range(8)]
    texts += [" ".join(parts[j] for j in sorted(rnd.sample(range(8), rnd.randint(6, 8)))) for _ in range(30)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one two three"), (None, texts[0]), (None, None),
                   (906, texts[0]), (906, texts[5]), (907, texts[7]), (907, texts[7])]


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"unit_tokens": 1500}), (3, {"unit_tokens": 0})])
def test_classes_equal_brute_force(spark, seed, kw):
    ready(spark)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n int, node string, tokens int").repartition(3)
    got = [tuple(r) for r in ngramjoin.ngram_classes(df, **kw).collect()]
    want = [r[:3] for r in brute_force(rows, k=4, percent=85)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({c for _, _, c in want}) < len(want) - 60


@pytest.mark.parametrize("percent", [50, 85])
def test_tree_walks_find_every_link(percent):
    rnd = random.Random(percent)
    for _ in range(60):
        base = [sorted(rnd.sample(range(60), rnd.randint(1, 40))) for _ in range(3)]
        sets = []
        for _ in range(rnd.randint(1, 25)):
            s = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 6)):
                s.symmetric_difference_update({rnd.randrange(60)})
            if s and sorted(s) not in sets:
                sets.append(sorted(s))
        extra = [rnd.randint(0, 3) for _ in sets]
        sizes = np.array([len(s) + e for s, e in zip(sets, extra)])
        tree = ngramjoin.PrefixTree([np.array(s) for s in sets], sizes)
        apart, got = np.arange(len(sets)), set()
        for leaf in range(len(sets)):
            got |= {frozenset((int(tree.order[leaf]), int(tree.order[x]))) for x in tree.walk(leaf, apart, percent)}
        want = set()
        for i in range(len(sets)):
            for j in range(i):
                o = len(set(sets[i]) & set(sets[j]))
                if o and 100 * o >= percent * (sizes[i] + sizes[j] - o):
                    want.add(frozenset((i, j)))
        assert got == want


def test_walks_leave_subtrees_that_fall_short():
    rnd = random.Random(4)
    sets = [np.array(sorted(rnd.sample(range(5000), 200))) for _ in range(200)]
    tree = ngramjoin.PrefixTree(sets, np.full(200, 200))
    seen = 0
    spread = ngramjoin._spread

    def counted(lo, n):
        nonlocal seen
        seen += int(n.sum())
        return spread(lo, n)

    ngramjoin._spread = counted
    try:
        assert not any(tree.walk(i, np.arange(200), 85) for i in range(200))
    finally:
        ngramjoin._spread = spread
    assert seen < 0.5 * 200 * 200 * 200 / 2          # of the tokens that all pairs would have looked at


def test_one_large_group_of_near_copies(spark):
    ready(spark)
    rnd = random.Random(6)
    texts = near_group(rnd, 400, 100, 0.03)
    rows = list(enumerate(texts))
    got = [tuple(r) for r in ngramjoin.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string"), unit_tokens=4000).collect()]
    assert sorted(got) == sorted(r[:3] for r in brute_force(rows, k=4, percent=85))


def test_very_long_text_and_empty_table(spark):
    ready(spark)
    long = [f"w{i}" for i in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:110_000])), (3, " ".join(long[:100_000]))]
    got = [tuple(r) for r in ngramjoin.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 119_997, 1), (2, 109_997, 1), (3, 99_997, 1)]
    assert re.match("doc_id", ngramjoin.ngram_classes(spark.createDataFrame([], "doc_id long, text string")).columns[0])
    assert ngramjoin.ngram_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txrisk.llm import substring
from txrisk.llm.runtime import ready


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [" ".join(rnd.choices(vocabulary, k=rnd.randint(8, 90))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 60))))
        rows.append((i // 2 if i % 9 == 0 else i, rnd.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(100, "x " * 500), (101, "x " * 300), (102, None), (103, ""), (None, passages[0]), (1, "a b " * 80), (104, "b a " * 70), (104, "b a " * 70)]
    return rows


@pytest.mark.parametrize("window,phrase,seed", [(50, 8, 1), (10, 3, 2), (6, 6, 3)])
def test_removed_words_equal_brute_force(spark, window, phrase, seed):
    ready(spark)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, span int, kept string").repartition(5)
    got = [tuple(r) for r in substring.remove_repeats(df, window=window, phrase=phrase).collect()]
    assert sorted(got, key=str) == sorted(substring.brute_force(rows, window), key=str)


def test_empty_table(spark):
    ready(spark)
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=7, max_size=60), st.integers(2, 7))
def test_spans_partition_the_windows(words, phrase):
    import numpy as np

    h = substring.vec.mix(np.array(words, np.uint64))
    s = substring.Spans(h, 7, min(phrase, 7))
    covered = [w for a, b in zip(s.first, s.last, strict=True) for w in range(a, b + 1)]
    assert covered == list(range(len(words) - 6))
    # equal windows have equal hashes, whatever span they are in
    seen = {}
    for i in range(len(s.key)):
        for j, x in zip(range(s.first[i], s.last[i] + 1), s.windows(i).tolist(), strict=True):
            assert seen.setdefault(tuple(words[j: j + 7]), x) == x
    assert len(set(seen.values())) == len(seen)

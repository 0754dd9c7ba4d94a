import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txrisk.llm import components, neardup
from txrisk.llm.runtime import ready


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_force(rows, k=5, percent=75):
    """Rows of (id, n_shingles, component_id, kept): every two rows compared."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    for i, s in sets:
        # a row without words is alone, whatever other rows share its id
        c = None if i is None else find(i) if s else i
        yield i, len(s), c, c is None or c == i


def near_group(rnd, n, size, rate):
    base = [f"v{rnd.randrange(3000)}" for _ in range(size)]
    return [" ".join(f"e{rnd.randrange(10 ** 6)}" if rnd.random() < r else w for w in base) for r in (rnd.random() * rate for _ in range(n))]


def corpus(seed):
    rnd = random.Random(seed)
    texts = [" ".join(f"v{rnd.randrange(3000)}" for _ in range(rnd.randint(1, 80))) for _ in range(60)]
    texts += [t for t in texts[:12] for _ in range(2)]
    texts += near_group(rnd, 60, 120, 0.06) + near_group(rnd, 25, 40, 0.05)
    shared = " ".join(f"p{i}" for i in range(40))
    texts += [f"{shared} {t}" for t in texts[:25]]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one two three"), (None, texts[0]), (None, None),
                   (906, texts[0]), (906, texts[5]), (907, texts[7]), (907, texts[7])]


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"node_size": 8, "max_depth": 2}), (3, {"node_size": 8, "max_depth": 6})])
def test_classes_equal_brute_force(spark, seed, kw):
    ready(spark)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, sig string").repartition(3)
    got = [tuple(r) for r in neardup.near_duplicates(df, **kw).collect()]
    assert sorted(got, key=str) == sorted(brute_force(rows), key=str)


def test_members_of_nodes_take_parts_and_signatures_by_one_join(spark, monkeypatch):
    ready(spark)
    plans, write = {}, neardup.saved

    def saved(df, name="t"):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(neardup, "saved", saved)
    neardup.near_duplicates(spark.createDataFrame(corpus(1), "doc_id long, text string"), node_size=8, max_depth=2)
    assert len(plans["level"]) > 1                # there were large nodes
    assert len(re.findall(r"Join Inner, \(id#\d+L? = id#\d+L?\)", plans["near"][0])) == 1


def test_pairs_at_the_threshold_with_a_low_estimate_are_linked(spark):
    ready(spark)
    rows = []
    for seed in (2123, 3632, 4661, 5638, 5980, 6570, 10413, 11014):       # estimates of 0.59 to 0.63
        rnd = random.Random(seed)
        words = lambda n: " ".join(f"v{rnd.randrange(10 ** 6)}" for _ in range(n))  # noqa: B023, E731
        both = words(64)
        rows += [(2 * seed, f"{words(10)} {both}"), (2 * seed + 1, f"{words(10)} {both}")]
    got = [tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_force(rows)) and sum(r[3] for r in got) == 8


def test_every_node_branches():
    import numpy as np
    import pyarrow as pa

    n = 500
    sig = pa.array([np.arange(neardup.POSITIONS, dtype=np.uint32).tobytes()] * n)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([9] * n), sig], names=["node", "id", "n", "sig"])
    assert {i for out in neardup._branch(0.75, None)([batch]) for i in out.column(1).to_pylist()} == set(range(n))
    roots = neardup.vec.mix(np.arange(1, neardup.TREES + 1, dtype=np.uint64) * neardup.vec.U64(0x9E3779B97F4A7C15))
    assert all(sum(out.num_rows for out in neardup._branch(0.75, [x])([batch])) for x in roots)


def test_empty_table_and_nothing_alike(spark):
    ready(spark)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = neardup.near_duplicates(spark.createDataFrame([(5, None), (6, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(5, 0, 5, True), (6, 0, 6, True)]


def test_components_of_chains_stars_and_loops(spark):
    ready(spark)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(200, 260)] + [(7, 7), (None, 3), (300, 299), (299, 300)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, **{i: 100 for i in range(200, 260)}, 300: 299, 299: 299}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 30), min_size=1), st.sets(st.integers(0, 30), min_size=1))
def test_confirming_is_exact(a, b):
    import numpy as np

    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert neardup._linked(x, y, 75) == (100 * len(a & b) >= 75 * len(a | b))

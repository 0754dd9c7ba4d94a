import random

from txrisk.llm import fingerprints as fp
from txrisk.llm.runtime import ready


def rows_of(seed=1):
    rnd = random.Random(seed)
    rows = [(i * 3, " ".join(f"é{rnd.randrange(500)}" for _ in range(rnd.randint(0, 300)))) for i in range(50)]
    return rows + [(None, "a b"), (-7, None), (5, ""), (7, "x y z"), (7, "x y z"), (10 ** 15, "q" * 3000), (10 ** 15 + 1, "A  b")]


def test_edited_texts_and_likeness(spark):
    ready(spark)
    rows = rows_of()
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, bucket string, context int").repartition(4)
    got = sorted((tuple(r) for r in fp.edited_fingerprints(df).collect()), key=str)
    want = sorted(fp.brute_force(rows), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[5] - w[3]) < 0.2 and abs(g[6] - w[4]) < 0.2 for g, w in zip(got, want, strict=True))
    assert sum(abs(g[5] - w[3]) for g, w in zip(got, want, strict=True)) / len(got) < 0.03
    assert all(g[5] == fp.likeness(g[3], g[4]) for g in got)
    plain = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(df).collect()}
    assert all(plain[g[0]] == g[3] for g in got)
    assert plain[None] == plain[10 ** 15 + 1]                        # equal words


def test_single_row_is_its_own_next_and_empty_stays_empty(spark):
    ready(spark)
    one = spark.createDataFrame([(3, "hi there")], "doc_id long, text string")
    assert [r["near_next"] for r in fp.edited_fingerprints(one).collect()] == [1.0]
    assert fp.edited_fingerprints(one.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert [(r["n_chars"], r["near_edited"]) for r in fp.edited_fingerprints(nothing).collect()] == [(0, 1.0)] * 2


def test_band_links_are_verified(spark):
    ready(spark)
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(900)}" for _ in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:98] + ["x", "y"])), (3, " ".join(base[:60])), (4, None), (5, " ".join(base))]
    got = {(r["a"], r["b"]): r["jaccard"] for r in fp.band_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 1): 94 / 98, (5, 1): 1.0}


def test_band_classes_of_a_template_group(spark):
    """150 edits of one template, each with a near copy, beside other texts: nearly all links are found."""
    ready(spark)
    from tests.llm.test_neardup import shingles

    rnd = random.Random(7)
    base = [f"t{i}" for i in range(200)]
    texts = []
    for i in range(150):
        edit = [f"e{rnd.randrange(10 ** 6)}" if rnd.random() < 0.05 else w for w in base]
        copy = list(edit)
        copy[rnd.randrange(200)] = f"c{i}"
        texts += [" ".join(edit), " ".join(copy)]
    texts += [" ".join(f"v{rnd.randrange(3000)}" for _ in range(60)) for _ in range(40)] + [texts[0], texts[7]]
    rows = [*enumerate(texts), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for n, (b, y) in enumerate(sets) for a, x in sets[:n] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    for size in (2048, 16):
        got = {r["doc_id"]: r["component_id"] for r in fp.band_classes(df, node_size=size).collect()}
        assert len(got) == len(rows) and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links) and len(links) > 150
        # nothing is joined that brute force keeps apart
        parent = {i: i for i, _ in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        assert all(find(i) == find(c) for i, c in got.items())

import os
import random
import tempfile

from txrisk.operators.features import enrich_user_frequency, user_frequency_table
from txrisk.streaming.counts import add_batch, compact, user_frequency


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counts_equal_the_batch_table_after_replays_and_compactions(spark):
    rnd = random.Random(1)
    path = os.path.join(tempfile.mkdtemp(prefix="txrisk-counts-"), "counts")
    df = lambda users: spark.createDataFrame([(u,) for u in users], "user_id string")
    assert user_frequency(spark, path).count() == 0
    seen = []
    for n in range(9):
        users = [rnd.choice(["U1", "U2", "U3", None, f"N{n}"]) for _ in range(20)]
        if n in (2, 6):                                             # an attempt that was lost after its write
            add_batch(df(["wrong"] * 5 + users), path, ("r", n))
        add_batch(df(users), path, ("r", n))
        # a batch that is worked on sees what came before it
        assert _rows(user_frequency(spark, path, ("r", n))) == _rows(user_frequency_table(df(seen)) if seen else df([]).selectExpr("user_id", "0 AS n"))
        seen += users
        assert _rows(user_frequency(spark, path)) == _rows(user_frequency_table(df(seen)))
        if n % 3 == 2:
            assert compact(spark, path, ("r", n))                   # not the batch itself, it may be replayed
            add_batch(df(users), path, ("r", n))
            assert _rows(user_frequency(spark, path)) == _rows(user_frequency_table(df(seen)))
    # another run starts at 0 again
    add_batch(df(["U1"] * 4), path, ("other", 0))
    seen += ["U1"] * 4
    assert _rows(user_frequency(spark, path)) == _rows(user_frequency_table(df(seen)))
    assert set(os.listdir(os.path.join(path, "batches", "r"))) <= {"5", "6", "7", "8"}      # folded batches go
    assert len([x for x in os.listdir(path) if x.startswith("base-")]) <= 2
    tx = df(["U1", "new"])
    assert {r.user_id: r.user_frequency for r in enrich_user_frequency(tx, user_frequency(spark, path)).collect()} == {"U1": seen.count("U1"), "new": 15}


def test_of_two_compactions_one_wins(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="txrisk-counts-"), "counts")
    for n in range(3):
        add_batch(spark.createDataFrame([("U",)] * 2, "user_id string"), path, ("r", n))
    import txrisk.streaming.counts as counts

    def another(*args):                                             # commits between the look and the commit of the first
        counts.create_file = create
        assert compact(spark, path, ("r", 2))
        return create(*args)

    create, counts.create_file = counts.create_file, another
    try:
        assert not compact(spark, path, ("r", 2))
    finally:
        counts.create_file = create
    assert _rows(user_frequency(spark, path)) == [("U", 6)]

"""Global ranks and prefix sums without a single-partition window.

A plain ``percent_rank().over(Window.orderBy(x))`` moves every row into one
task. Here the work is split by value ranges instead:

1. collapse the input to one row per distinct sort value (partial aggregation
   folds hot values map-side, so a value holding a third of all rows costs
   one row);
2. cut the value domain into ``B`` ranges at approximate quantiles (numbers, times) or at values drawn from the
   input (strings), ``B`` growing with the rows; the range id is a pure, deterministic function of the
   value (a binary search in one array of boundaries), so nothing has to be materialised for the id to
   stay stable under recomputation or AQE;
3. per range totals (at most ``B`` rows per partition key, a proven bound)
   give exclusive offsets with a window over that small table;
4. a window partitioned by (partition keys, range) gives the running sum
   inside each range; offset + local sum is the global prefix.

The only driver round trip is for the boundaries: a row count and ``B`` values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_rk_bucket"
_PROXY = "_rk_proxy"


ROWS_PER_RANGE = 2_000_000
_DRAWN_PER_RANGE = 20
COMPILED_BOUNDS = 128


def order_proxy(df: DataFrame, col: str) -> Column:
    """``col`` in a form whose order is that of ``col``: times as microseconds, days and flags as numbers,
    other numbers and strings as they are."""
    from pyspark.sql import types as T

    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int")
    return c


def default_buckets(df: DataFrame, rows: int | None = None) -> int:
    """As many ranges as shuffle partitions, and more where a range would exceed ROWS_PER_RANGE rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, parts, -(-(rows or 0) // ROWS_PER_RANGE))


def _quantiles(df: DataFrame, col: str, n: int) -> tuple[int, list]:
    """(rows, sorted distinct approximate quantiles) of a numeric ``col``, nulls ignored, in one aggregation."""
    probs = [i / n for i in range(1, n)]
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx(col, probs, 20 * n).alias("qs")).first()
    return r["rows"], sorted(set(q for q in r["qs"] or [] if q is not None))


def boundaries(df: DataFrame, col: str, n_buckets: int | None) -> list:
    """Sorted distinct approximate quantiles of a numeric ``col``, or quantiles of values drawn from a string one
    (nulls ignored); without ``n_buckets`` as many as :func:`default_buckets` says for the rows."""
    from pyspark.sql import types as T

    if n_buckets is not None and n_buckets <= 1:
        return []
    if isinstance(df.schema[col].dataType, (T.StringType, T.BinaryType)):
        return _string_boundaries(df, col, n_buckets or default_buckets(df, df.count()))
    n = n_buckets or default_buckets(df)
    rows, found = _quantiles(df, col, n)
    if n_buckets is None and default_buckets(df, rows) > n:
        _, found = _quantiles(df, col, default_buckets(df, rows))
    return found


def _string_boundaries(df: DataFrame, col: str, n_buckets: int) -> list:
    """About ``_DRAWN_PER_RANGE`` distinct values a range, drawn by hash, and of those every so manieth. Ranges hold
    about the same number of distinct values, which is what the ranks run over."""
    distinct = df.agg(F.approx_count_distinct(col).alias("n")).first()["n"]
    want = _DRAWN_PER_RANGE * n_buckets
    values = df.select(col).filter(F.col(col).isNotNull())
    if distinct > want:
        values = values.filter(F.pmod(F.xxhash64(col), F.lit(1 << 40)) < F.lit(int((1 << 40) * want / distinct)))
    drawn = sorted((r[0] for r in values.distinct().collect()), key=lambda v: v.encode() if isinstance(v, str) else bytes(v))
    step = max(1, len(drawn) // n_buckets)
    return drawn[step::step][: n_buckets - 1]


def bucket_of(value: Column, bounds: Sequence, descending: bool = False) -> Column:
    """Range id of ``value``: number of boundaries strictly below it (0..len(bounds)).

    A tree of comparisons, which is compiled, up to ``COMPILED_BOUNDS`` boundaries; beyond, where its code would grow too long,
    a binary search in one array literal. NULL goes first for ascending, last for descending, as Spark orders NULLs by default.
    """
    n = len(bounds)
    b = F.lit(0)
    if 0 < n <= COMPILED_BOUNDS:
        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(value > F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

        b = tree(0, n)
    elif n:
        array = F.array(*[F.lit(x) for x in bounds])

        def halve(s: Column, _: Column) -> Column:
            # the answer lies in [lo, hi]; element_at counts from 1, so it looks at bounds[mid]
            mid = F.shiftright(s["lo"] + s["hi"], 1)
            above = (s["lo"] < s["hi"]) & (value > F.get(array, mid))
            return F.struct(F.when(above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

        steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
        b = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve, lambda s: s["lo"])
        # never NULL, and seen to be: else a join by the id would have it worked out for every row before the aggregation, to drop NULLs
        b = F.coalesce(b, F.lit(0))
    if descending:
        b = F.lit(n) - b
        return F.when(value.isNull(), F.lit(n + 1)).otherwise(b)
    return F.when(value.isNull(), F.lit(-1)).otherwise(b)


def key_boundaries(df: DataFrame, key: str, n_buckets: int | None = None) -> list:
    """Range boundaries for ``key`` taken from ``df`` (any frame holding the key column)."""
    return boundaries(df.select(order_proxy(df, key).alias(_PROXY)), _PROXY, n_buckets)


def _null_safe(parts: Sequence[str], null_parts: bool = True) -> Column:
    """Equality of partition keys and their ``_pk<i>`` copies; null-safe if they can be NULL."""
    cond = F.lit(True)
    for i, k in enumerate(parts):
        cond = cond & (F.col(k).eqNullSafe(F.col(f"_pk{i}")) if null_parts else F.col(k) == F.col(f"_pk{i}"))
    return cond


def prefix_sums(df: DataFrame, key: str, values: Sequence[str], partition_cols: Sequence[str] = (),
                descending: bool = False, n_buckets: int | None = None,
                broadcast_offsets: bool | None = None, bounds: list | None = None,
                maxes: Sequence[str] = (), null_parts: bool = True) -> DataFrame:
    """Running sums of ``values`` in ``key`` order, per ``partition_cols``.

    ``df`` must hold one row per (partition_cols, key). Adds ``<v>_before``
    (sum over strictly earlier keys), ``<v>_upto`` (inclusive) and
    ``<v>_total`` for each value column, and ``<m>_max_before`` (largest value
    of ``m`` over strictly earlier keys, NULLs ignored) for each of ``maxes``.
    ``bounds`` (from :func:`key_boundaries`) may be computed on another frame,
    e.g. the raw rows before aggregation. ``null_parts=False`` says that partition keys are never NULL.
    """
    parts = list(partition_cols)
    proxied = df.withColumn(_PROXY, order_proxy(df, key))
    if bounds is None:
        bounds = key_boundaries(df, key, n_buckets)
    keyed = proxied.withColumn(_BUCKET, bucket_of(F.col(_PROXY), bounds, descending)).drop(_PROXY)

    totals = keyed.groupBy(*parts, _BUCKET).agg(*[F.sum(v).alias(f"_t_{v}") for v in values],
                                                 *[F.max(m).alias(f"_tm_{m}") for m in maxes])
    w_off = Window.partitionBy(*parts).orderBy(_BUCKET)
    w_all = Window.partitionBy(*parts)
    earlier = w_off.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *parts, _BUCKET,
        *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_t_{v}").over(w_all).alias(f"{v}_total") for v in values],
        *[F.max(f"_tm_{m}").over(earlier).alias(f"_om_{m}") for m in maxes],
    )
    # Offsets hold at most (#partition keys x #buckets) rows; without partition
    # keys that is a proven bound, so it is broadcast. Otherwise AQE decides
    # from the measured size.
    if broadcast_offsets is None:
        broadcast_offsets = not parts
    if broadcast_offsets:
        offsets = F.broadcast(offsets)

    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
    w_loc = Window.partitionBy(*parts, _BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumns({
        **{f"_l_{v}": F.coalesce(F.sum(v).over(w_loc), F.lit(0)) for v in values},
        **{f"_lm_{m}": F.max(m).over(w_loc) for m in maxes},
    })
    # null-safe on the partition keys: rows with NULL keys form their own partition
    offs = offsets.select(*[F.col(k).alias(f"_pk{i}") for i, k in enumerate(parts)],
                          F.col(_BUCKET).alias("_ob"), *[c for c in offsets.columns if c not in parts + [_BUCKET]])
    out = local.join(offs, (F.col(_BUCKET) == F.col("_ob")) & _null_safe(parts, null_parts), "inner") \
        .drop("_ob", *[f"_pk{i}" for i in range(len(parts))])
    out = out.withColumns({
        **{f"{v}_before": F.col(f"_o_{v}") + F.col(f"_l_{v}") for v in values},
        **{f"{m}_max_before": F.greatest(F.col(f"_om_{m}"), F.col(f"_lm_{m}")) for m in maxes},
    }).withColumns({
        f"{v}_upto": F.col(f"{v}_before") + F.col(v) for v in values
    })
    return out.drop(_BUCKET, *[f"_o_{v}" for v in values], *[f"_l_{v}" for v in values],
                    *[f"_om_{m}" for m in maxes], *[f"_lm_{m}" for m in maxes])


def distributed_rank(df: DataFrame, order_col: str, partition_cols: Sequence[str] = (),
                     descending: bool = False, rank_col: str = "_rank", n_col: str = "_n",
                     n_buckets: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """``rank()`` (ties share the lowest rank) and partition size, computed distributedly (from the narrow
    ``source`` of a derived ``df``, where given)."""
    parts = list(partition_cols)
    narrow = source if source is not None else df
    counts = narrow.groupBy(*parts, order_col).agg(F.count(F.lit(1)).alias("_cnt"))
    # boundaries from the raw column: one pruned scan, no aggregation; buckets
    # then hold about n / B rows each (a hot value ends up alone in its bucket)
    bounds = key_boundaries(narrow, order_col, n_buckets)
    pre = prefix_sums(counts, order_col, ["_cnt"], parts, descending, bounds=bounds)
    ranks = pre.select(*parts, order_col,
                       (F.col("_cnt_before") + F.lit(1)).alias(rank_col),
                       F.col("_cnt_total").alias(n_col))
    # Join back on the sort value (null-safe). A hot value is one key here, so
    # AQE's skew-join split of the big side applies.
    keys = [*parts, order_col]
    renamed = ranks.select(*[F.col(k).alias(f"_rk_{i}") for i, k in enumerate(keys)], rank_col, n_col)
    cond = [F.col(k).eqNullSafe(F.col(f"_rk_{i}")) for i, k in enumerate(keys)]
    joined = df.join(renamed, cond, "inner")
    return joined.drop(*[f"_rk_{i}" for i in range(len(keys))])


def distributed_percent_rank(df: DataFrame, order_col: str, out_col: str = "percent_rank",
                             partition_cols: Sequence[str] = (), n_buckets: int | None = None,
                             source: DataFrame | None = None) -> DataFrame:
    """``percent_rank()`` = (rank - 1) / (n - 1), 0 when n = 1."""
    ranked = distributed_rank(df, order_col, partition_cols, n_buckets=n_buckets, source=source)
    pr = F.when(F.col("_n") > 1, (F.col("_rank") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return ranked.withColumn(out_col, pr.cast("double")).drop("_rank", "_n")

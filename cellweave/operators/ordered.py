"""Global order without a single task: value counts, running totals, exact quantiles, fills.

A value range is cut into buckets by sketched quantiles of the *distinct* values, so no bucket can
hold more than its share even when one value carries a third of all rows. Totals inside a bucket come
from a window over that bucket, totals before it from the short table of bucket sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH, DEEPEST = 8, 12  # of the tree of buckets
BUCKET_ROWS = 2_000_000


def clean(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame through a broadcast equi join on a constant key."""
    right = one_row.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(right), "_one").drop("_one")


def _by(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def _without(df: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """Drop helper columns; ``_all`` stays where the caller groups by a column of that name."""
    return df.drop(*columns) if by else df.drop("_all", *columns)


def value_counts(df: DataFrame, by: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """``(by, value, n)``: the pre-aggregation every ordered operator starts from."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return clean(df, value).groupBy(*by, value).agg(n.alias("n"))


def small_table(small: DataFrame, max_rows: int = 100_000) -> tuple[DataFrame, bool]:
    """A table read once, up to ``max_rows`` rows: ``(rows held in the plan, True)``, or beyond the bound the table itself and False.

    A caller that needs per-group values several times computes them once this way.
    """
    rows = small.limit(max_rows + 1).collect()
    return (small, False) if len(rows) > max_rows else (small.sparkSession.createDataFrame(rows, small.schema), True)


def attach_small(
    df: DataFrame, small: DataFrame, keys: Sequence[str], max_rows: int = 100_000, how: str = "inner"
) -> DataFrame:
    """Attach per-group values without shuffling ``df`` on its (few, hot) group keys.

    One row without keys is broadcast as it is. With keys the small side is read up to ``max_rows``
    rows; within that bound it is broadcast, beyond it an ordinary join is planned.
    """
    if not keys:
        return attach_one_row(df, small)
    held, bounded = small_table(small, max_rows)
    return df.join(F.broadcast(held) if bounded else held, list(keys), how)


def with_bucket(df: DataFrame, order: str, least: int = DEPTH) -> DataFrame:
    """Add ``_bucket``: which of ``2 ** depth`` sketched quantile intervals holds ``order``.

    A sketch depends on the order in which its parts are merged, so the cut points are fixed once and every branch of a plan,
    and every repeated task, uses the same ones. They are one row of at most ``2 ** DEEPEST`` numbers over all groups;
    ``depth`` follows the number of rows, so that a bucket holds about ``BUCKET_ROWS``, and is at least ``least``.
    The interval is found by bisection in plain generated code.
    """
    n = 1 << DEEPEST
    dtype = dict(df.dtypes)[order]
    number = F.unix_micros(F.col(order).cast("timestamp")) if dtype.startswith(("timestamp", "date")) else F.col(order)
    marked = df.withColumn("_x", number.cast("double"))
    probs = ", ".join(f"{i / n!r}D" for i in range(1, n))  # one parsed text: thousands of single literals build slowly
    found = marked.agg(F.expr(f"percentile_approx(_x, array({probs}), {10 * n})").alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    depth = min(DEEPEST, max(least, (found.n // BUCKET_ROWS).bit_length()))
    step = 1 << (DEEPEST - depth)
    cuts = df.sparkSession.createDataFrame([((found.cuts or [])[step - 1::step],)], "_cuts array<double>")
    out = attach_one_row(marked, cuts).withColumn("_bucket", F.lit(0))
    for half in (1 << k for k in reversed(range(depth))):
        passed = F.get(F.col("_cuts"), F.col("_bucket") + (half - 1)) < F.col("_x")
        out = out.withColumn("_bucket", F.col("_bucket") + F.when(passed, half).otherwise(0))
    return out.drop("_cuts", "_x")


def running_sum(
    df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, str], totals: bool = False,
    following: str | None = None, depth: int = DEPTH,
) -> DataFrame:
    """Inclusive running sums ``{out: column}`` along ``order`` within ``by``.

    ``totals`` adds ``<out>_total``; ``following`` adds the next value of ``order`` under that name.
    """
    src, keys = _by(df, by)
    cut = with_bucket(src, order, depth)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    edge = Window.partitionBy(*keys).orderBy("_bucket")
    before = edge.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    ends = cut.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()], F.min(order).alias("_first"))
    extra = [F.sum(f"_t_{o}").over(whole).alias(f"{o}_total") for o in sums] if totals else []
    if following:
        extra.append(F.lead("_first").over(edge).alias("_next"))
    offsets = ends.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums], *extra)
    local = cut.withColumns({o: F.sum(c).over(upto) for o, c in sums.items()})
    if following:
        local = local.withColumn(following, F.lead(order).over(inside))
    out = local.join(offsets, [*keys, "_bucket"])
    out = out.withColumns({o: F.col(o) + F.col(f"_o_{o}") for o in sums})
    if following:
        out = out.withColumn(following, F.coalesce(F.col(following), F.col("_next"))).drop("_next")
    return _without(out, by, "_bucket", *[f"_o_{o}" for o in sums])


def cumulative_counts(counts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``(by, value, n, upto, total)`` from value counts; ``upto`` counts rows <= value."""
    run = running_sum(counts, by, value, {"upto": "n"}, totals=True)
    return run.withColumnRenamed("upto_total", "total")


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], wide: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group; no group is ever held in one task.

    Long form ``(by, p, q)``; with ``wide`` one array column ``q`` in the order of ``probs``.
    """
    counts = value_counts(df, by, value) if counts is None else counts
    run, keys = _by(cumulative_counts(counts, by, value), by)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    pos = lambda p: p * (F.col("total") - 1)
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1
    hit = F.filter(
        F.transform(wanted, lambda p, i: F.struct(i.alias("i"), p.alias("p"),
                                                  F.floor(pos(p)).alias("lo"), F.ceil(pos(p)).alias("hi"))),
        lambda e: ((e.lo >= first) & (e.lo <= last)) | ((e.hi >= first) & (e.hi <= last)),
    )
    v = F.col(value).cast("double")
    rows = run.select(*keys, "total", v.alias("_v"), "upto", "n", F.explode(hit).alias("_h"))
    inside = lambda k: (F.col(f"_h.{k}") >= first) & (F.col(f"_h.{k}") <= last)
    out = rows.groupBy(*keys, F.col("_h.i").alias("_i"), F.col("_h.p").alias("p")).agg(
        F.max(F.when(inside("lo"), F.col("_v"))).alias("_a"),
        F.max(F.when(inside("hi"), F.col("_v"))).alias("_b"),
        F.max(pos(F.col("_h.p"))).alias("_pos"),
    )
    # The same arithmetic as the built-in percentile, so that both ways of group_quantiles give equal digits.
    mixed = (F.ceil("_pos") - F.col("_pos")) * F.col("_a") + (F.col("_pos") - F.floor("_pos")) * F.col("_b")
    out = out.withColumn("q", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(mixed))
    if not wide:
        return out.select(*by, "p", "q")
    packed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "q"))), lambda e: e.q)
    return _without(out.groupBy(*keys).agg(packed.alias("q")), by)


def group_quantiles(
    counts: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], most: int = 200_000
) -> DataFrame:
    """``(keys, q)``: exact quantiles for very many groups, from value counts ``(keys, value, n)``.

    Groups of at most ``most`` distinct values use the built-in weighted percentile, one shuffle for all of
    them. Larger groups, few by nature, would fill the memory of one task; they take the bucketed way, which gives the same numbers.
    """
    few = F.percentile(F.col(value), [float(p) for p in probs], F.col("n"))
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > most).select(*keys)
    rows = sizes.limit(100_001).collect()
    if not rows:
        return counts.groupBy(*keys).agg(few.alias("q"))
    large = F.broadcast(counts.sparkSession.createDataFrame(rows, sizes.schema)) if len(rows) <= 100_000 else sizes
    rest = counts.join(large, list(keys), "left_anti").groupBy(*keys).agg(few.alias("q"))
    crowded = counts.join(large, list(keys), "left_semi")
    return rest.unionByName(quantiles(crowded, keys, value, probs, wide=True, counts=crowded))


def neighbour_rows(
    df: DataFrame, by: Sequence[str], order: str, columns: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """``lag`` (-1) and ``lead`` (+1) along ``order``: ``{out: (column, step)}``.

    Inside a bucket a window does it; the first and last row of a bucket take the value from the short
    table of bucket ends. Rows of one group must differ in ``order``.
    """
    src, keys = _by(df, by)
    cut = with_bucket(src, order)
    w = Window.partitionBy(*keys, "_bucket").orderBy(order)
    edge = Window.partitionBy(*keys).orderBy("_bucket")
    names = sorted({c for c, _ in columns.values()})
    ends = cut.groupBy(*keys, "_bucket").agg(
        *[F.min_by(F.struct(c), order).alias(f"_f_{c}") for c in names],
        *[F.max_by(F.struct(c), order).alias(f"_l_{c}") for c in names],
    )
    ends = ends.select(
        *keys, "_bucket",
        *[F.lag(f"_l_{c}").over(edge).getField(c).alias(f"_p_{c}") for c in names],
        *[F.lead(f"_f_{c}").over(edge).getField(c).alias(f"_n_{c}") for c in names],
    )
    local = cut
    for out, (c, step) in columns.items():
        boxed = F.struct(F.col(c).alias("v"))
        local = local.withColumn(f"_b_{out}", (F.lag(boxed) if step < 0 else F.lead(boxed)).over(w))
    joined = local.join(ends, [*keys, "_bucket"])
    for out, (c, step) in columns.items():
        near = F.col(f"_b_{out}")
        far = F.col(f"_p_{c}" if step < 0 else f"_n_{c}")
        joined = joined.withColumn(out, F.when(near.isNotNull(), near.v).otherwise(far))
    return _without(joined, by, "_bucket", *[f"_b_{o}" for o in columns],
                    *[f"_{k}_{c}" for k in "pn" for c in names])


def ordered_fill(df: DataFrame, by: Sequence[str], order: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """Last non-null ``value`` at or before the row along ``order`` (then ``ties``)."""
    src, keys = _by(df, by)
    cut = with_bucket(src, order)
    w = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(value).isNotNull(), F.struct(order, *ties))
    ends = cut.groupBy(*keys, "_bucket").agg(F.max_by(F.col(value), known).alias("_end"))
    carry = ends.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    local = cut.withColumn(value, F.last(value, ignorenulls=True).over(w))
    out = local.join(carry, [*keys, "_bucket"])
    return _without(out.withColumn(value, F.coalesce(F.col(value), F.col("_carry"))), by, "_bucket", "_carry")

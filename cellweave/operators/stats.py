"""Distributions: histograms, quantiles, distances, calibration."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.frames import predicate_sql
from cellweave.operators.ordered import (
    attach_one_row, attach_small, clean, cumulative_counts, neighbour_rows, ordered_fill, quantiles, running_sum, small_table, value_counts,
)
from cellweave.session import durable


# --- histograms --------------------------------------------------------------------------------

def value_limits(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float] | None = None) -> DataFrame:
    """``(by, lo, hi)``: minimum and maximum, or two exact quantiles."""
    if probs is None:
        src = clean(df, value)
        aggs = [F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")]
        return src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    q = quantiles(df, by, value, probs, wide=True)
    return q.select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def bin_of(v: Column, lo: Column, hi: Column, n: Column) -> Column:
    """0-based bin, last bin closed on the right, null outside [lo, hi]."""
    pos = F.floor((v - lo) / (hi - lo) * n)
    return F.when((v >= lo) & (v <= hi), F.when(hi > lo, F.least(pos, n - 1)).otherwise(F.lit(0))).cast("int")


def histogram(
    df: DataFrame, by: Sequence[str], value: str, bins: int | Column, limits: DataFrame | None = None,
    limit_keys: Sequence[str] | None = None,
) -> DataFrame:
    """``(by, bin, left, right, n, density, percent, cumulative)`` with empty bins.

    ``limits`` is ``(keys, lo, hi)`` from :func:`value_limits`; its keys default to ``by``. Rows are reduced
    to at most ``bins`` counts per group map-side; what follows works on those.
    """
    keys = list(by if limit_keys is None else limit_keys)
    limits = value_limits(df, keys, value) if limits is None else limits
    n_bins = F.lit(bins) if isinstance(bins, int) else bins
    lim = limits.withColumn("_nb", n_bins.cast("int"))
    placed = attach_small(clean(df, value), lim, keys)
    b = bin_of(F.col(value).cast("double"), F.col("lo"), F.col("hi"), F.col("_nb"))
    got = placed.withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = lim if keys == list(by) else attach_small(got.select(*by).distinct(), lim, keys)
    frame = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return finish_histogram(frame.join(got, [*by, "bin"], "left"), by)


def finish_histogram(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    width = (F.col("hi") - F.col("lo")) / F.col("_nb")
    out = rows.withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(w)
    upto = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return out.select(
        *by, "bin", (F.col("lo") + F.col("bin") * width).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), "n",
        F.try_divide(F.col("n"), total * width).alias("density"), F.try_divide(100 * F.col("n"), total).alias("percent"),
        F.try_divide(upto, total).alias("cumulative"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return [float(v) for v in w / w.sum()]


def smooth(hist: DataFrame, by: Sequence[str], order: str, value: str, sigma: float = 1.0, out: str = "smoothed") -> DataFrame:
    """Gaussian smoothing along integer positions 0..n-1; the end values repeat outwards."""
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    w = F.array(*[F.lit(v) for v in weights])
    last = hist.groupBy(*by).agg(F.max(order).alias("_last")) if by else hist.agg(F.max(order).alias("_last"))
    ends = attach_small(hist, last, by)
    step = ends.withColumn("_k", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    src = F.least(F.greatest(F.col(order) + F.col("_k"), F.lit(0)), F.col("_last"))
    asked = step.select(*by, order, src.alias("_src"), F.get(w, F.col("_k") + r).alias("_w"))
    known = hist.select(*by, F.col(order).alias("_src"), F.col(value).alias("_v"))
    total = asked.join(known, [*by, "_src"]).groupBy(*by, order).agg(F.sum(F.col("_w") * F.col("_v")).alias(out))
    return hist.join(total, [*by, order])


def local_maxima(series: DataFrame, by: Sequence[str], order: str, value: str, n: int | None = None) -> DataFrame:
    """Rows above the previous and not below the next value; the ``n`` highest per group."""
    near = neighbour_rows(series, by, order, {"_prev": (value, -1), "_next": (value, 1)})
    peaks = near.where((F.col(value) > F.col("_prev")) & (F.col(value) >= F.col("_next"))).drop("_prev", "_next")
    if n is None:
        return peaks
    return top_per_group(peaks, by, [F.col(value).desc(), F.col(order)], n)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, salts: int = 64) -> DataFrame:
    """Best ``n`` rows per group in two steps, so a hot group is never ranked in one task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    last = Window.partitionBy(*by).orderBy(*order)
    cut = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    return cut.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r", "_salt")


def change_points(series: DataFrame, by: Sequence[str], order: str, label: str) -> DataFrame:
    """Where an ordered label changes: ``(by, order, label_from, label_to, midpoint)``."""
    near = neighbour_rows(series, by, order, {"_nl": (label, 1), "_nx": (order, 1)})
    return near.where(F.col("_nl") != F.col(label)).select(
        *by, order, F.col(label).alias("label_from"), F.col("_nl").alias("label_to"),
        ((F.col(order) + F.col("_nx")) / 2).alias("midpoint"))


def triangle_threshold(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bin centre farthest below the line from the peak to the far end of a 256-bin histogram."""
    g = Window.partitionBy(*by)
    nz = F.col("n") > 0
    h = hist.select(
        *by, "bin", "n", ((F.col("left") + F.col("right")) / 2).alias("_c"),
        F.max("n").over(g).alias("_peak"), F.max("bin").over(g).alias("_last"),
        F.min(F.when(nz, F.col("bin"))).over(g).alias("_low"), F.max(F.when(nz, F.col("bin"))).over(g).alias("_high"))
    h = h.withColumn("_at", F.min(F.when(F.col("n") == F.col("_peak"), F.col("bin"))).over(g))
    flip = (F.col("_at") - F.col("_low")) < (F.col("_high") - F.col("_at"))
    mirror = lambda c: F.when(flip, F.col("_last") - F.col(c)).otherwise(F.col(c))
    h = h.withColumns({"_i": mirror("bin"), "_p": mirror("_at"),
                       "_s": F.when(flip, F.col("_last") - F.col("_high")).otherwise(F.col("_low"))})
    width = F.col("_p") - F.col("_s")
    run = F.sqrt(F.col("_peak") * F.col("_peak") + width * width)
    length = F.try_divide(F.col("_peak") * (F.col("_i") - F.col("_s")) - width * F.col("n"), run)
    inside = h.where((F.col("_i") >= F.col("_s")) & (F.col("_i") < F.col("_p"))).withColumn("_len", length)
    return inside.groupBy(*by).agg(F.max_by("_c", F.struct("_len", -F.col("_i"))).alias("threshold"))


def otsu_threshold(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bin centre with the largest between-class variance."""
    g = Window.partitionBy(*by)
    up = g.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = (F.col("left") + F.col("right")) / 2
    h = hist.select(*by, "bin", c.alias("_c"), F.sum("n").over(up).alias("_w1"), F.sum(F.col("n") * c).over(up).alias("_s1"),
                    F.sum("n").over(g).alias("_w"), F.sum(F.col("n") * c).over(g).alias("_s"))
    w2 = F.col("_w") - F.col("_w1")
    gap = F.try_divide(F.col("_s1"), F.col("_w1")) - F.try_divide(F.col("_s") - F.col("_s1"), w2)
    h = h.where((F.col("_w1") > 0) & (w2 > 0)).withColumn("_var", F.col("_w1").cast("double") * w2 * gap * gap)
    return h.groupBy(*by).agg(F.max_by("_c", F.struct(F.col("_var"), -F.col("bin"))).alias("threshold"))


def threshold_levels(limits: DataFrame, threshold: str = "threshold", centre: float = 0.0) -> DataFrame:
    """Five levels -2..2 around a threshold clipped to 10-90 % of the range ``lo..hi``."""
    span = F.col("hi") - F.col("lo")
    low, high = F.col("lo") + 0.1 * span, F.col("hi") - 0.1 * span
    t = F.least(F.greatest(F.col(threshold), low), high)
    t = F.least(F.greatest(t + float(centre) * span, low), high)
    levels = [F.col("lo") + (t - F.col("lo")) * k / 3 for k in (1, 2, 3)] + [t + (F.col("hi") - t) * k / 3 for k in (1, 2)]
    packed = F.array(*[F.struct(F.lit(i - 2).alias("level"), v.alias("threshold")) for i, v in enumerate(levels)])
    keys = [c for c in limits.columns if c not in ("lo", "hi", threshold)]
    return limits.select(*keys, F.inline(packed))


def binned(df: DataFrame, by: Sequence[str], value: str, limits: DataFrame, bins: Column) -> DataFrame:
    """Histogram of each group as one array: ``(by, lo, hi, bins)`` with empty bins.

    Rows are counted by bin map-side; only counts meet in a group, as many as it has bins.
    """
    held, bounded = small_table(limits.withColumn("_nb", bins.cast("int")))
    v = F.col(value).cast("double")
    b = bin_of(v, F.col("lo"), F.col("hi"), F.col("_nb"))
    lim = F.broadcast(held) if bounded else held
    src = clean(df, value).select(*by, value)
    rows = src.join(lim, list(by)) if by else attach_one_row(src, held)
    got = rows.select(*by, b.alias("_b")).where(F.col("_b").isNotNull()).groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("n"))
    none = held.select(*by, F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_b"), F.lit(0).cast("long").alias("n"))
    full = got.unionByName(none).groupBy(*by, "_b").agg(F.sum("n").alias("n"))
    line = full.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_b", "n"))).alias("_h"))
    counts = F.transform("_h", lambda e: e["n"]).alias("bins")
    ends = held.select(*by, "lo", "hi")
    return (line.join(F.broadcast(ends) if bounded else ends, list(by)) if by else attach_one_row(line, ends)).select(*by, "lo", "hi", counts)


def smooth_array(values: Column, sigma: float) -> Column:
    """W7 on an array: Gaussian smoothing, the end values repeat outwards."""
    weights = gaussian_weights(sigma)
    r, last = len(weights) // 2, F.size(values) - 1
    at = lambda i: F.get(values, F.least(F.greatest(i, F.lit(0)), last))
    return F.transform(values, lambda _, i: sum((w * at(i + k - r) for k, w in enumerate(weights)), F.lit(0.0)))


def peaks_of_array(values: Column, n: int) -> Column:
    """W8 on an array: positions above the previous and not below the next value, the ``n`` highest, in order of position."""
    spots = F.transform(values, lambda v, i: F.struct(
        (-v).alias("h"), i.alias("i"), ((v > F.get(values, i - 1)) & (v >= F.get(values, i + 1))).alias("peak")))
    best = F.slice(F.sort_array(F.filter(spots, lambda s: s["peak"])), 1, n)
    return F.sort_array(F.transform(best, lambda s: s["i"]))


def calibrate_counts(
    df: DataFrame, by: Sequence[str], value: str, p0: float = 0.0, p1: float = 0.999, bin_size: float = 0.4,
    sigma: float = 1.0, first_peaks: int = 5,
) -> DataFrame:
    """A3: line from intensity to count: ``(by, slope, intercept, peaks)``.

    The peaks of the smoothed histogram are ordered by position and stand for counts 1, 2, ...; fewer
    peaks than asked for are accepted, with one the line is null, and a group without a peak has no row.
    Once counted, a histogram is one array per group, and all that follows are array functions without a shuffle.
    """
    bins = F.greatest(F.floor((F.col("hi") - F.col("lo")) / bin_size), F.lit(1))
    hist = binned(df, by, value, value_limits(df, by, value, [p0, p1]), bins)
    found = hist.withColumn("_s", smooth_array(F.col("bins"), sigma)).withColumn("_i", peaks_of_array(F.col("_s"), first_peaks))
    width = (F.col("hi") - F.col("lo")) / F.size("bins")
    edge = lambda i: F.col("lo") + i * width
    pts = found.where(F.size("_i") > 0).select(*by, F.transform("_i", lambda i: (edge(i) + edge(i + 1)) / 2).alias("_x"), F.size("_i").alias("peaks"))
    total = lambda a, fn: F.reduce(a, F.lit(0.0), lambda s, e: s + fn(e))
    pts = pts.withColumn("_mx", total("_x", lambda e: e) / F.col("peaks")).withColumn("_my", (F.col("peaks") + 1) / 2)
    off = F.transform("_x", lambda x, i: F.struct((x - F.col("_mx")).alias("dx"), (i + 1 - F.col("_my")).alias("dy")))
    slope = F.try_divide(total(off, lambda e: e["dx"] * e["dy"]), total(off, lambda e: e["dx"] * e["dx"]))
    line = pts.withColumn("slope", F.when(F.col("peaks") > 1, slope))
    return line.select(*by, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), F.col("peaks").cast("long").alias("peaks"))


def intensity_to_count(df: DataFrame, by: Sequence[str], value: str, out: str = "spot_count", **kw) -> DataFrame:
    """A3: predicted count per row."""
    line = calibrate_counts(df, by, value, **kw)
    joined = attach_small(df, line.drop("peaks"), by)
    return joined.withColumn(out, F.col("slope") * F.col(value) + F.col("intercept")).drop("slope", "intercept")


# --- grids -------------------------------------------------------------------------------------

def grid_counts(
    df: DataFrame, x: str, y: str, size: float, query: str | None = None, snap: str = "floor", keys: Sequence[str] = (),
    whole_extent: bool = True,
) -> DataFrame:
    """Points per grid cell. With ``query`` only matching points count, but every cell that holds
    any point stays, because the extent comes from all points."""
    place = (lambda c: F.floor(F.col(c) / size)) if snap == "floor" else (lambda c: F.bround(F.col(c) / size).cast("long"))
    hit = F.lit(True) if query is None else F.coalesce(F.expr(predicate_sql(query)), F.lit(False))
    out = df.groupBy(*keys, place(y).alias("row"), place(x).alias("col")).agg(F.count_if(hit).alias("n"))
    return out if whole_extent else out.where(F.col("n") > 0)


def grid_extent(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return grid.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))])


def shared_cells(df: DataFrame, x: str, y: str, size: float, cls: str) -> DataFrame:
    """Grid cells that hold more than one class (must be empty for exclusive classes)."""
    cell = df.groupBy(F.floor(F.col(y) / size).alias("row"), F.floor(F.col(x) / size).alias("col"), cls).agg(F.lit(1).alias("_k"))
    return cell.groupBy("row", "col").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") > 1)


# --- quantile based ----------------------------------------------------------------------------

def quantile_pairs(df: DataFrame, sample: str, value: str, first: object, second: object, probs: Sequence[float]) -> DataFrame:
    """Matched quantiles of two samples ``(p, q1, q2)``."""
    q = quantiles(df.where(F.col(sample).isin(first, second)), [sample], value, probs)
    pick = lambda s: F.max(F.when(F.col(sample) == s, F.col("q")))
    return q.groupBy("p").agg(pick(first).alias("q1"), pick(second).alias("q2"))


def tail_means(
    df: DataFrame, by: Sequence[str], value: str, p0: float, p1: float, counts: DataFrame | None = None
) -> DataFrame:
    """Mean of the values at or below the low and at or above the high quantile, as doubles.

    The rows are read once, for the stored value counts; ``counts`` hands them over where the caller has them.
    """
    counts = durable(value_counts(df, by, value)) if counts is None else counts
    q = quantiles(df, by, value, [p0, p1], wide=True, counts=counts)
    lim = q.select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    v = F.col(value).cast("double")
    mean = lambda inside: F.sum(F.when(inside, v * F.col("n"))) / F.sum(F.when(inside, F.col("n")))
    return attach_small(counts, lim, by).groupBy(*by).agg(
        mean(v <= F.col("lo")).alias("low_mean"), mean(v >= F.col("hi")).alias("high_mean"))


def unpivot_markers(df: DataFrame, ids: Sequence[str], markers: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(markers), "marker", "value")


def anchors(long: DataFrame, by: Sequence[str], value: str, tails: Mapping[str, tuple[float, float]]) -> DataFrame:
    """A16 without the mixture peaks: ``(by, anchor, value)`` with min, max and tail means, all from one reading of the rows."""
    counts = durable(value_counts(long, by, value))
    lim = value_limits(counts, by, value)
    rows = [lim.unpivot(list(by), ["lo", "hi"], "anchor", "value").replace({"lo": "min", "hi": "max"}, subset="anchor")]
    for name, (p0, p1) in tails.items():
        t = tail_means(long, by, value, p0, p1, counts).withColumnsRenamed({"low_mean": f"{name}_low", "high_mean": f"{name}_high"})
        rows.append(t.unpivot(list(by), [f"{name}_low", f"{name}_high"], "anchor", "value"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def fit_lines(df: DataFrame, by: Sequence[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """Least-squares slope and offset per group; ``weight`` repeats a pair."""
    if weight is None:
        return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    w, a, b = F.col(weight), F.col(x), F.col(y)
    t = df.groupBy(*by).agg(F.sum(w).alias("_n"), F.sum(w * a).alias("_x"), F.sum(w * b).alias("_y"),
                            F.sum(w * a * a).alias("_xx"), F.sum(w * a * b).alias("_xy"))
    n, sx, sy = F.col("_n"), F.col("_x"), F.col("_y")
    t = t.withColumn("slope", F.try_divide(n * F.col("_xy") - sx * sy, n * F.col("_xx") - sx * sx))
    return t.withColumn("intercept", F.try_divide(sy - F.col("slope") * sx, n)).select(*by, "slope", "intercept")


# --- correlation -------------------------------------------------------------------------------

def channel_correlation(pixels: DataFrame, tile: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """``(channel_a, channel_b, r)``: correlation per tile, averaged over tiles.

    Up to about fifty channels: one aggregate per pair, all in one pass with map-side combine. Tiles
    where a channel is constant do not count.
    """
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]
    per = pixels.groupBy(*tile).agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    mean = per.agg(*[F.avg(F.when(~F.isnan(f"r{k}"), F.col(f"r{k}"))).alias(f"r{k}") for k in range(len(pairs))])
    rows = F.array(*[
        F.struct(F.lit(a).alias("channel_a"), F.lit(b).alias("channel_b"), F.col(f"r{k}").alias("r"))
        for k, (a, b) in enumerate(pairs)])
    half = mean.select(F.inline(rows))
    other = half.where(F.col("channel_a") != F.col("channel_b")).selectExpr("channel_b channel_a", "channel_a channel_b", "r")
    return half.unionByName(other)


def crop_border(pixels: DataFrame, height: int, width: int, border: int, y: str = "y", x: str = "x") -> DataFrame:
    return pixels.where(F.col(y).between(border, height - border - 1) & F.col(x).between(border, width - border - 1))


# --- distances between samples -----------------------------------------------------------------

def histogram_overlap(
    df: DataFrame, sample: str, value: str, reference: object, bins: int = 100, cutoff_prob: float | None = None
) -> DataFrame:
    """Overlap over union of density histograms with shared bins: ``(sample, iou)`` against the reference.

    With ``cutoff_prob`` only bins to the right of that quantile of the reference count.
    """
    hist = histogram(df, [sample], value, bins, value_limits(df, [], value), limit_keys=[])
    if cutoff_prob is not None:
        cut = quantiles(df.where(F.col(sample) == reference), [], value, [cutoff_prob], wide=True)
        hist = attach_small(hist, cut, []).where(F.col("left") > F.col("q")[0]).drop("q")
    ref = hist.where(F.col(sample) == reference).select("bin", F.col("density").alias("d0"))
    both = hist.where(F.col(sample) != reference).join(ref, "bin")
    return both.groupBy(sample).agg(F.try_divide(F.sum(F.least("density", "d0")), F.sum(F.greatest("density", "d0"))).alias("iou"))


def pooled_steps(df: DataFrame, sample: str, value: str, reference: object, others: Sequence[object]) -> DataFrame:
    """Running counts of the reference and each other sample over their pooled distinct values:
    ``(sample, value, n0, n1, c0, c1, c0_total, c1_total, next)``."""
    counts = value_counts(df.where(F.col(sample).isin(reference, *others)), [sample], value)
    names = F.array(*[F.lit(o) for o in others])
    side = F.when(F.col(sample) == reference, names).otherwise(F.array(F.col(sample)))
    is_ref = F.col(sample) == reference
    long = counts.select(
        F.explode(side).alias("_s"), value, F.when(is_ref, F.col("n")).otherwise(0).alias("n0"),
        F.when(is_ref, 0).otherwise(F.col("n")).alias("n1"))
    pooled = long.groupBy(F.col("_s").alias(sample), value).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return running_sum(pooled, [sample], value, {"c0": "n0", "c1": "n1"}, totals=True, following="next")


def earth_mover(
    df: DataFrame, sample: str, value: str, reference: object, others: Sequence[object], cutoff: float | None = None
) -> DataFrame:
    """1-Wasserstein distance ``(sample, emd)`` of each other sample to the reference."""
    src = df if cutoff is None else df.where(F.col(value) > cutoff)
    s = pooled_steps(src, sample, value, reference, others)
    gap = F.abs(F.try_divide("c0", "c0_total") - F.try_divide("c1", "c1_total"))
    return s.groupBy(sample).agg(F.sum(gap * (F.coalesce("next", F.col(value)) - F.col(value))).alias("emd"))


def cramer_von_mises(df: DataFrame, sample: str, value: str, reference: object, others: Sequence[object]) -> DataFrame:
    """Two-sample statistic ``(sample, statistic, n0, n1, p_value)`` with mid-ranks for ties."""
    s = pooled_steps(df, sample, value, reference, others)
    d = lambda c: F.col(c).cast("double")
    mid = d("c0") + d("c1") - d("n0") - d("n1") + (d("n0") + d("n1") + 1) / 2

    def squares(n, c):
        first = d(c) - d(n)
        a = mid - first  # sum over i=1..n of (a - i)^2
        return d(n) * a * a - a * d(n) * (d(n) + 1) + d(n) * (d(n) + 1) * (2 * d(n) + 1) / 6

    t = s.groupBy(sample).agg(
        F.sum(squares("n0", "c0")).alias("u0"), F.sum(squares("n1", "c1")).alias("u1"),
        F.max("c0_total").alias("n0"), F.max("c1_total").alias("n1"))
    nx, ny = F.col("n0").cast("double"), F.col("n1").cast("double")
    u = nx * F.col("u0") + ny * F.col("u1")
    t = t.withColumn("statistic", F.try_divide(u, nx * ny * (nx + ny)) - F.try_divide(4 * nx * ny - 1, 6 * (nx + ny)))
    p = F.udf(lambda s, a, b: None if s is None else float(cvm_tail(s, a, b)), T.DoubleType())  # one row per sample
    return t.select(sample, "statistic", "n0", "n1", p("statistic", "n0", "n1").alias("p_value"))


def cvm_tail(statistic: float, nx: int, ny: int) -> float:
    """Asymptotic p-value of the two-sample statistic (Anderson 1962; series by Csorgo and Faraway 1996)."""
    n = nx + ny
    mean = (1 + 1 / n) / 6
    var = (n + 1) * (4.0 * nx * ny * n - 3.0 * (nx * nx + ny * ny) - 2.0 * nx * ny) / (45.0 * n * n * 4.0 * nx * ny)
    x = 1 / 6 + (statistic - mean) / math.sqrt(45 * var)
    if x < 0.003:
        return 1.0
    t = np.linspace(0.0, 12.0, 4001)
    total = 0.0
    for k in range(60):
        y = 4 * k + 1
        q = y * y / (16 * x)
        bessel = float(np.trapezoid(np.exp(-q * (np.cosh(t) + 1)) * np.cosh(t / 4), t))
        coef = math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1)) / (math.pi ** 1.5 * math.sqrt(x))
        term = coef * math.sqrt(y) * bessel
        total += term
        if term < 1e-12:
            break
    return max(0.0, min(1.0, 1.0 - total))


def match_distribution(df: DataFrame, sample: str, value: str, source: object, reference: object, out: str = "matched") -> DataFrame:
    """Rows of ``source`` with ``value`` mapped onto the distribution of ``reference``.

    Each distinct source value has a cumulative fraction; the reference value at that fraction is
    interpolated between the two neighbouring reference fractions.
    """
    counts = value_counts(df.where(F.col(sample).isin(source, reference)), [sample], value)
    frac = cumulative_counts(counts, [sample], value).withColumn("q", F.col("upto") / F.col("total"))
    is_ref = F.col(sample) == reference
    here = F.when(is_ref, F.struct(F.col("q").alias("q"), F.col(value).cast("double").alias("v")))
    rows = frac.select(F.col(value), F.col("q"), is_ref.alias("_ref"), here.alias("below"), here.alias("above"),
                       F.when(is_ref, 0).otherwise(1).alias("_tie"))
    down = ordered_fill(rows, [], "q", "below", ["_tie"])
    up = ordered_fill(down.withColumn("_nq", -F.col("q")), [], "_nq", "above", ["_tie"])
    a, b, q = F.col("below"), F.col("above"), F.col("q")
    mapped = F.when(a.isNull(), b.v).when(b.isNull() | (a.q == b.q), a.v).otherwise(
        a.v + (b.v - a.v) * (q - a.q) / (b.q - a.q))
    table = up.where(~F.col("_ref")).select(F.col(value), mapped.alias(out))
    return df.where(F.col(sample) == source).join(table, value)


# --- patterns and classes ----------------------------------------------------------------------

def pattern_sizes(
    df: DataFrame, markers: Sequence[str], min_size: int = 100, min_degree: int = 1, max_degree: int | None = None
) -> DataFrame:
    """Rows per boolean pattern with its degree."""
    sizes = df.groupBy(*markers).agg(F.count(F.lit(1)).alias("n"))
    degree = sum((F.col(m).cast("int") for m in markers[1:]), F.col(markers[0]).cast("int"))
    kept = sizes.withColumn("degree", degree).where((F.col("n") >= min_size) & (F.col("degree") >= min_degree))
    return kept if max_degree is None else kept.where(F.col("degree") <= max_degree)


def fold_rare(df: DataFrame, cls: str, min_rows: int = 500, other: str = "Ignore*", folded: str = "Others") -> DataFrame:
    """Classes with fewer than ``min_rows`` rows, and the class named ``other``, become one class."""
    sizes = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    rare = F.coalesce((F.col("_n") < min_rows) | (F.col(cls) == other), F.lit(True))
    kept = sizes.where(~rare).select(F.col(cls), F.lit(True).alias("_keep"))
    # at most rows / min_rows classes are kept; attach_small checks the number
    rows = kept.limit(100_001).collect()
    table = F.broadcast(df.sparkSession.createDataFrame(rows, kept.schema)) if len(rows) <= 100_000 else kept
    return df.join(table, cls, "left").withColumn(cls, F.when(F.col("_keep"), F.col(cls)).otherwise(F.lit(folded))).drop("_keep")


# --- images as pixel pairs ---------------------------------------------------------------------

def mask_agreement(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """IoU, area fractions and numbers of differing pixels of two co-registered masks."""
    x, y = F.coalesce(F.col(a), F.lit(0)), F.coalesce(F.col(b), F.lit(0))
    inter, union = F.count_if((x > 0) & (y > 0)), F.count_if((x > 0) | (y > 0))
    diff = F.abs(x - y)
    return pairs.groupBy(*by).agg(
        F.when(union > 0, inter / union).alias("iou"), (F.count_if(x > 0) / F.count(F.lit(1))).alias("fraction_a"),
        (F.count_if(y > 0) / F.count(F.lit(1))).alias("fraction_b"), F.count_if(diff > 0).alias("differ"),
        F.count_if(diff >= 2).alias("differ_2"), F.count_if(diff >= 3).alias("differ_3"))


def mutual_information(pairs: DataFrame, a: str, b: str, by: Sequence[str] = (), bins: int = 100) -> DataFrame:
    """Normalised mutual information ``(Hx + Hy) / Hxy`` from the joint ``bins`` x ``bins`` histogram."""
    src = clean(clean(pairs, a), b)
    aggs = [F.min(a).cast("double").alias("alo"), F.max(a).cast("double").alias("ahi"),
            F.min(b).cast("double").alias("blo"), F.max(b).cast("double").alias("bhi")]
    lim = src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    placed = attach_small(src, lim, by)
    n = F.lit(bins)
    joint = placed.groupBy(*by, bin_of(F.col(a).cast("double"), F.col("alo"), F.col("ahi"), n).alias("_i"),
                           bin_of(F.col(b).cast("double"), F.col("blo"), F.col("bhi"), n).alias("_j")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    p = joint.withColumn("p", F.col("n") / total)
    entropy = lambda df: df.groupBy(*by).agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    hx = entropy(p.groupBy(*by, "_i").agg(F.sum("p").alias("p"))).withColumnRenamed("h", "hx")
    hy = entropy(p.groupBy(*by, "_j").agg(F.sum("p").alias("p"))).withColumnRenamed("h", "hy")
    hxy = entropy(p).withColumnRenamed("h", "hxy")
    if by:
        joined = hx.join(hy, list(by)).join(hxy, list(by))
    else:
        joined = attach_small(attach_small(hx, hy, []), hxy, [])
    return joined.select(*by, F.when(F.col("hxy") > 0, (F.col("hx") + F.col("hy")) / F.col("hxy")).otherwise(F.lit(1.0)).alias("nmi"))


def first_improving(scores: DataFrame, by: Sequence[str], condition_order: str, score: str, before: str) -> DataFrame:
    """First condition whose score is not below the score before it was applied."""
    return scores.where(F.col(score) >= F.col(before)).groupBy(*by).agg(
        F.min(condition_order).alias(condition_order), F.min_by(score, condition_order).alias(score))

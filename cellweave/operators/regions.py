"""Per-object aggregates on spot and pixel tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.ordered import clean, group_quantiles, value_counts


def valid_spots(spots: DataFrame, obj: str = "mask_id", value: str = "channel_intensity") -> DataFrame:
    return spots.where((F.col(obj) > 0) & (F.col(value) > 0))


def spots_per_object(
    spots: DataFrame, keys: Sequence[str] = (), obj: str = "mask_id", value: str = "channel_intensity"
) -> DataFrame:
    """A1: intensity sum and number of spots per object."""
    return valid_spots(spots, obj, value).groupBy(obj, *keys).agg(
        F.sum(value).alias("sum_peak_int"), F.count(F.lit(1)).alias("count"))


def log_intensity_per_object(
    spots: DataFrame, keys: Sequence[str] = (), obj: str = "mask_id", value: str = "channel_intensity"
) -> DataFrame:
    """A2: sum of log10 intensity per object."""
    return valid_spots(spots, obj, value).groupBy(obj, *keys).agg(F.sum(F.log10(value)).alias("sum_log_int"))


def foreground(pixels: DataFrame, label: str = "label") -> DataFrame:
    return pixels.where(F.col(label) > 0)


def shape_table(pixels: DataFrame, keys: Sequence[str] = (), label: str = "label", y: str = "y", x: str = "x") -> DataFrame:
    """A4: area, centroid, half-open bounding box, extent, axes, eccentricity and orientation per object.

    Second moments carry the 1/12 of a unit pixel; the axes are four times the root of the eigenvalues.
    All aggregates are algebraic, so an object that spans many tiles or holds a third of all pixels is
    combined map-side.
    """
    g = foreground(pixels, label).groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("area"),
        F.avg(y).alias("centroid_y"), F.avg(x).alias("centroid_x"),
        F.min(y).alias("bbox_y0"), F.min(x).alias("bbox_x0"),
        (F.max(y) + 1).alias("bbox_y1"), (F.max(x) + 1).alias("bbox_x1"),
        F.var_pop(y).alias("_vy"), F.var_pop(x).alias("_vx"), F.covar_pop(y, x).alias("_c"),
    )
    a, b, c = F.col("_vy") + 1 / 12, F.col("_vx") + 1 / 12, F.col("_c")
    root = F.sqrt(F.pow((a - b) / 2, 2) + c * c)
    l1, l2 = (a + b) / 2 + root, F.greatest((a + b) / 2 - root, F.lit(0.0))
    box = (F.col("bbox_y1") - F.col("bbox_y0")) * (F.col("bbox_x1") - F.col("bbox_x0"))
    angle = F.when(a == b, F.when(c < 0, F.lit(-np.pi / 4)).otherwise(F.lit(np.pi / 4))).otherwise(
        F.atan2(2 * c, a - b) / 2)
    return g.withColumns({
        "extent": F.col("area") / box,
        "axis_major_length": 4 * F.sqrt(l1), "axis_minor_length": 4 * F.sqrt(l2),
        "eccentricity": F.when(l1 > 0, F.sqrt(F.greatest(1 - l2 / l1, F.lit(0.0)))).otherwise(F.lit(0.0)),
        "orientation": angle,
    }).drop("_vy", "_vx", "_c")


def row_ends(pixels: DataFrame, keys: Sequence[str] = (), label: str = "label", y: str = "y", x: str = "x") -> DataFrame:
    """First and last pixel of each object row: all a convex hull needs."""
    return foreground(pixels, label).groupBy(*keys, label, y).agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.count(F.lit(1)).alias("n"))


def hull_area(ys: np.ndarray, xs: np.ndarray) -> float:
    """Area of the convex hull of the pixel squares around the given pixels (monotone chain)."""
    corners = np.concatenate([np.stack([xs + dx, ys + dy], 1) for dx in (-0.5, 0.5) for dy in (-0.5, 0.5)])
    pts = np.unique(corners, axis=0)

    def chain(points):
        kept: list = []
        for p in points:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2], kept[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept[:-1]

    ring = np.array(chain(pts.tolist()) + chain(pts[::-1].tolist()))
    nx, ny = np.roll(ring[:, 0], -1), np.roll(ring[:, 1], -1)
    return float(abs(np.sum(ring[:, 0] * ny - nx * ring[:, 1])) / 2)


def solidity(pixels: DataFrame, keys: Sequence[str] = (), label: str = "label", y: str = "y", x: str = "x") -> DataFrame:
    """A5: object area over convex hull area (hull of the pixel squares).

    Pixels are first reduced to the ends of each object row. An object thus carries two numbers per
    image row, whatever its area; hulls are computed for whole Arrow batches of objects.
    """
    ends = row_ends(pixels, keys, label, y, x)
    packed = ends.groupBy(*keys, label).agg(
        F.sum("n").alias("area"),
        F.collect_list(F.array(F.col(y).cast("double"), F.col("x0").cast("double"), F.col("x1").cast("double"))).alias("_rows"))

    def hulls(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            a = np.array([np.asarray(v, dtype=float) for v in r])
            out.append(hull_area(np.concatenate([a[:, 0], a[:, 0]]), np.concatenate([a[:, 1], a[:, 2]])))
        return pd.Series(out, dtype=float)

    hull = F.pandas_udf(hulls, T.DoubleType())
    spread = packed.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, label)
    return spread.withColumn("hull_area", hull("_rows")).select(
        *keys, label, "area", "hull_area", (F.col("area") / F.col("hull_area")).alias("solidity"))


def intensity_stats(
    pixels: DataFrame, keys: Sequence[str], value: str, cutoff: float | None = None
) -> DataFrame:
    """Mean, median and population deviation per object; with ``cutoff`` the same above it.

    Values are counted per object first and the exact median works on those counts; an object with very
    many distinct values is spread over tasks.
    """
    v = F.col(value)
    counts = value_counts(pixels, keys, value)
    sums = [F.sum("n").alias("count"), (F.sum(v * F.col("n")) / F.sum("n")).alias("mean")]
    spread = [F.stddev_pop(value).alias("std")]
    if cutoff is not None:
        n = F.when(v > cutoff, F.col("n"))
        sums += [F.coalesce(F.sum(n), F.lit(0)).alias("count_above"), (F.sum(v * n) / F.sum(n)).alias("mean_above")]
        spread.append(F.stddev_pop(F.when(v > cutoff, v)).alias("std_above"))
    out = counts.groupBy(*keys).agg(*sums).join(clean(pixels, value).groupBy(*keys).agg(*spread), list(keys))
    half = group_quantiles(counts, keys, value, [0.5]).select(*keys, F.col("q")[0].alias("median"))
    out = out.join(half, list(keys))
    if cutoff is None:
        return out
    above = group_quantiles(counts.where(v > cutoff), keys, value, [0.5]).select(*keys, F.col("q")[0].alias("median_above"))
    return out.join(above, list(keys), "left")


def intensity_quartiles(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact quartiles per object and channel, from value counts."""
    q = group_quantiles(value_counts(pixels, keys, value), keys, value, [0.25, 0.5, 0.75])
    return q.select(*keys, *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])


def keep_largest(parts: DataFrame, keys: Sequence[str], size: str = "area") -> DataFrame:
    """Of several rows per object, the one with the largest area (map-side ``max_by``)."""
    rest = [c for c in parts.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(size), *[F.col(c) for c in rest if c != size])).alias("_r")
    return parts.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def objects_per_file(pixels: DataFrame, file: str, label: str = "label", approximate: bool = False) -> DataFrame:
    """A10: distinct foreground labels per file; files without any object are kept with 0."""
    fg = F.when(F.col(label) > 0, F.col(label))
    if approximate:
        return pixels.groupBy(file).agg(F.approx_count_distinct(fg, 0.01).alias("n_objects"))
    return pixels.groupBy(file, label).agg(F.lit(1).alias("_k")).groupBy(file).agg(F.count(fg).alias("n_objects"))


def user_stats(pixels: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """The caller's Column aggregates (or grouped-agg pandas UDFs) per object; the name is the output column."""
    return pixels.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])

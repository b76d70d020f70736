"""Scalar functions: rescaling, gamma, grid snapping, tile indices, file names, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.ordered import attach_small


def clip(v: Column, lo, hi) -> Column:
    """into ``[lo, hi]``; missing stays missing."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(v.isNotNull(), F.least(F.greatest(v, lit(lo)), lit(hi)))


def rescale(v: Column, lo, hi, out_lo=0.0, out_hi=1.0) -> Column:
    """linear from ``[lo, hi]`` to ``[out_lo, out_hi]``, clamped; null for an empty range."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    lo, hi, a, b = lit(lo), lit(hi), lit(out_lo), lit(out_hi)
    return (clip(v, lo, hi) - lo) / F.when(hi != lo, hi - lo) * (b - a) + a


def rescale_by_quantiles(df: DataFrame, by: Sequence[str], value: str, p0: float, p1: float) -> DataFrame:
    """each group onto 0..1 between two exact quantiles."""
    from cellweave.operators.stats import value_limits

    joined = attach_small(df, value_limits(df, by, value, [p0, p1]), list(by))
    return joined.withColumn(value, rescale(F.col(value), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def gamma(v: Column, lo, hi, exponent: float) -> Column:
    """power curve after rescaling to 0..1, single precision."""
    return F.pow(rescale(v, lo, hi), F.lit(float(exponent))).cast("float")


def snap_to_grid(df: DataFrame, y: str, x: str, height: float, width: float, keys: Sequence[str] = (), trim: bool = True) -> DataFrame:
    """stage positions onto a dense grid: ``grid_y, grid_x, tile_h, tile_w``.

    The step is the smallest position above half a tile; with ``trim`` the tile becomes the step rounded to
    a multiple of 16.
    """
    aggs = [F.min(F.when(F.col(c) > 0.5 * t, F.col(c))).alias(n) for c, t, n in ((y, height, "_sy"), (x, width, "_sx"))]
    steps = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    tile = (lambda s, t: (F.bround(F.col(s) / 16) * 16).cast("long")) if trim else (lambda s, t: F.lit(int(t)).cast("long"))
    out = attach_small(df, steps, list(keys)).withColumns({"tile_h": tile("_sy", height), "tile_w": tile("_sx", width)})
    return out.withColumns({
        "grid_y": F.bround(F.col(y) / F.col("_sy")).cast("long") * F.col("tile_h"),
        "grid_x": F.bround(F.col(x) / F.col("_sx")).cast("long") * F.col("tile_w")}).drop("_sy", "_sx")


def tile_row_col(i: Column, width: int, height: int, horizontal: bool = True, snake: bool = False) -> tuple[Column, Column]:
    """running tile number to row and column."""
    n = width if horizontal else height
    major, minor = F.floor(i / n), F.pmod(i, F.lit(n))
    if snake:
        minor = F.when(major % 2 == 1, n - 1 - minor).otherwise(minor)
    return (major, minor) if horizontal else (minor, major)


def tile_position(row: Column, col: Column, height: int, width: int, overlap: float) -> tuple[Column, Column]:
    return row * height * (1 - overlap), col * width * (1 - overlap)


# --- names -------------------------------------------------------------------------------------

def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """without the image suffix (``.ome.tif``/``.ome.tiff``, any case), else without the last suffix."""
    image = F.regexp_replace(name, r"(?i)\.ome\.tiff?$", "")
    return F.when(image != name, image).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def padded(number: Column, digits: int | Column) -> Column:
    """zero-padded channel number."""
    return F.lpad(number.cast("string"), digits, "0")


def name_part(name: Column, sep: str, index: int, length: int | None = None) -> Column:
    """one separated part (0-based), optionally cut."""
    part = F.get(F.split(name, sep), F.lit(index))
    return part if length is None else F.substring(part, 1, length)


def slug(text: Column) -> Column:
    """lower case, runs of other characters to one hyphen, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def countdown(df: DataFrame, start: Column, order: str, out: str = "date") -> DataFrame:
    """one day less per row along the dense 0-based row number ``order``."""
    return df.withColumn(out, F.date_sub(start, F.col(order).cast("int")))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Dense 0-based ``row_no`` along a unique ``order`` column, without a single-task window."""
    from cellweave.operators.ordered import running_sum

    return running_sum(df.withColumn("_one1", F.lit(1)), [], order, {"row_no": "_one1"}).withColumn(
        "row_no", F.col("row_no") - 1).drop("_one1")


def fill_template(template: str, *values: Column) -> Column:
    """text template with ``{}`` places."""
    pieces = template.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError(f"template has {len(pieces) - 1} places, {len(values)} values given")
    out = [F.lit(pieces[0])]
    for v, p in zip(values, pieces[1:]):
        out += [v.cast("string"), F.lit(p)]
    return F.concat(*out)

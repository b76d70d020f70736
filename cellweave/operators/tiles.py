"""Tile and pixel tables: halo exchange, block statistics, pooling, mosaics.

A tile row is ``(keys, tile_row, tile_col, h, w, pixels)`` with ``pixels`` row-major; a pixel row is
``(keys, y, x, value)``. Kernels see one tile plus its halo, never more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellweave.operators.ordered import attach_small


class Own(NamedTuple):
    """Where a block lies: its own rows and columns start after ``halo`` padded ones."""

    row: int
    col: int
    h: int
    w: int
    halo: int
    y0: int
    x0: int


class Owns(NamedTuple):
    """Where the blocks of a stack lie; all have one shape."""

    row: np.ndarray
    col: np.ndarray
    h: int
    w: int
    halo: int
    size: int


# --- conversions -------------------------------------------------------------------------------

def to_tiles(pixels: DataFrame, size: int, keys: Sequence[str] = (), value: str = "value", y: str = "y", x: str = "x") -> DataFrame:
    """Pixel rows to tiles; a group holds at most ``size * size`` pixels. Absent pixels are 0."""
    ly, lx = F.pmod(F.col(y), F.lit(size)), F.pmod(F.col(x), F.lit(size))
    g = pixels.groupBy(*keys, F.floor(F.col(y) / size).alias("tile_row"), F.floor(F.col(x) / size).alias("tile_col")).agg(
        (F.max(ly) + 1).cast("int").alias("h"), (F.max(lx) + 1).cast("int").alias("w"),
        F.map_from_entries(F.collect_list(F.struct((ly * size + lx).cast("int"), F.col(value).cast("double")))).alias("_m"))
    index = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    at = lambda i: (F.floor(i / F.col("w")) * size + i % F.col("w")).cast("int")
    return g.withColumn("pixels", F.transform(index, lambda i: F.coalesce(F.element_at("_m", at(i)), F.lit(0.0)))).drop("_m")


def to_pixels(tiles: DataFrame, size: int, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Tiles to pixel rows with global ``y`` and ``x``."""
    flat = tiles.select(*keys, "tile_row", "tile_col", "w", F.posexplode("pixels").alias("_i", value))
    return flat.select(
        *keys, (F.col("tile_row") * size + F.floor(F.col("_i") / F.col("w"))).alias("y"),
        (F.col("tile_col") * size + F.col("_i") % F.col("w")).alias("x"), value)


# --- halo exchange -----------------------------------------------------------------------------

def halo_pieces(tiles: DataFrame, size: int, halo: int) -> DataFrame:
    """Every tile sends its neighbours the strips that lie in their halo, itself the whole tile.

    Columns added: ``dr, dc`` (target minus source tile), ``py, px`` (first row and column sent, in source
    coordinates), ``ph, pw``; ``tile_row, tile_col`` become those of the target.
    """
    n = -(-halo // size) if halo else 0
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-n, n + 1) for b in range(-n, n + 1)])
    sent = tiles.withColumn("_s", F.explode(steps)).withColumns({"dr": F.col("_s.dr"), "dc": F.col("_s.dc")}).drop("_s")
    lo = lambda d: F.greatest(F.lit(0), F.col(d) * size - halo)
    hi = lambda d, extent: F.least(F.col(extent), F.col(d) * size + size + halo)
    sent = sent.withColumns({"py": lo("dr"), "px": lo("dc"), "_y1": hi("dr", "h"), "_x1": hi("dc", "w")})
    sent = sent.where((F.col("_y1") > F.col("py")) & (F.col("_x1") > F.col("px")))
    rows = F.transform(F.sequence(F.col("py"), F.col("_y1") - 1), lambda i: F.slice(
        F.col("pixels"), i * F.col("w") + F.col("px") + 1, F.col("_x1") - F.col("px")))
    whole = (F.col("dr") == 0) & (F.col("dc") == 0)
    return sent.withColumns({
        "pixels": F.when(whole, F.col("pixels")).otherwise(F.flatten(rows)),
        "ph": F.col("_y1") - F.col("py"), "pw": F.col("_x1") - F.col("px"),
        "tile_row": F.col("tile_row") + F.col("dr"), "tile_col": F.col("tile_col") + F.col("dc"),
    }).drop("_y1", "_x1")


def flipped(a: np.ndarray) -> np.ndarray:
    """Rows and columns of an image, or of each of a stack, exchanged."""
    return np.swapaxes(a, -1, -2)


def mirror_rows(img: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels that are absent taken from the nearest run of their row, mirrored at its end; where the result is known; how far that run is."""
    w = img.shape[-1]
    at, edge = np.arange(w), np.pad(there, [(0, 0)] * (there.ndim - 1) + [(1, 1)])
    ahead = lambda flag: np.maximum.accumulate(np.where(flag, at, -1), axis=-1)
    back = lambda flag: np.minimum.accumulate(np.where(flag, at, 2 * w)[..., ::-1], axis=-1)[..., ::-1]
    left, start, right, end = ahead(there), ahead(there & ~edge[..., :-2]), back(there), back(there & ~edge[..., 2:])
    dl, dr = np.where(left >= 0, at - left, 4 * w), np.where(right < w, right - at, 4 * w)
    n = np.maximum(np.where(dl <= dr, left - start, end - right) + 1, 1)
    k = (np.minimum(dl, dr) - 1) % (2 * n)
    k = np.where(k >= n, 2 * n - 1 - k, k)
    known = (left >= 0) | (right < w)
    source = np.where(there | ~known, at, np.where(dl <= dr, left - k, right + k))
    return np.take_along_axis(img, source, axis=-1), known, np.minimum(dl, dr)


def mirror_absent(img: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The image goes on as its mirror image wherever it is absent, along the row or column in which it is nearer; corners follow."""
    while (there.any(axis=(-1, -2)) & ~there.all(axis=(-1, -2))).any():
        row, by_row, far = mirror_rows(img, there)
        column, by_column, deep = (flipped(v) for v in mirror_rows(flipped(img), flipped(there)))
        img = np.where(there, img, np.where(by_row & (~by_column | (far < deep)), row, column))
        there = by_row | by_column
    return img


BUNCH = 256  # pixels a side of the tiles that one group holds; larger tiles are groups of their own


def stacks(pieces: pa.Table, size: int, halo: int, boundary) -> Iterator[tuple[np.ndarray, Owns]]:
    """Padded blocks of the tiles of one group, those of one shape stacked. A tile that only has neighbours has none."""
    row, col, h, w, dr, dc, py, px, ph, pw = (pieces.column(c).to_numpy().astype(np.int64) for c in (
        "tile_row", "tile_col", "h", "w", "dr", "dc", "py", "px", "ph", "pw"))
    lists = pieces.column("pixels").combine_chunks()
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    long = lists.value_lengths().to_numpy()
    if (long != ph * pw).any():
        raise ValueError("a tile has not h x w pixels")
    begin = np.cumsum(long) - long
    place = (row - row.min()) * (int(np.ptp(col)) + 1) + col - col.min()
    centres, at = np.unique(place[(dr == 0) & (dc == 0)], return_index=True)
    own = np.flatnonzero((dr == 0) & (dc == 0))[at]
    known = np.isin(place, centres)
    tile = np.searchsorted(centres, place)
    shape = np.stack([h[own], w[own]], axis=1)
    for a, b in np.unique(shape, axis=0):
        mine = np.flatnonzero((shape[:, 0] == a) & (shape[:, 1] == b))
        number = np.full(len(centres) + 1, -1)
        number[mine] = np.arange(len(mine))
        stack = np.full((len(mine), a + 2 * halo, b + 2 * halo), 0.0 if boundary == "reflect" else float(boundary))
        there = np.zeros(stack.shape, dtype=bool)
        some = np.flatnonzero(known & (number[tile] >= 0))
        kinds, kind = np.unique(np.stack([dr, dc, py, px, ph, pw], axis=1)[some], axis=0, return_inverse=True)
        order = np.argsort(kind.ravel(), kind="stable")
        for (ddr, ddc, y, x, m, n), part in zip(kinds, np.split(some[order], np.cumsum(np.bincount(kind.ravel()))[:-1]), strict=True):
            oy, ox = -ddr * size + y + halo, -ddc * size + x + halo
            ey, ex = min(oy + m, stack.shape[1]), min(ox + n, stack.shape[2])
            if ey <= oy or ex <= ox:
                continue
            sent = values[begin[part][:, None] + np.arange(m * n)].reshape(len(part), m, n)
            stack[number[tile[part]], oy:ey, ox:ex] = sent[:, : ey - oy, : ex - ox]
            there[number[tile[part]], oy:ey, ox:ex] = True
        gaps = ~there.all(axis=(1, 2))
        if boundary == "reflect" and gaps.any():
            stack[gaps] = mirror_absent(stack[gaps], there[gaps])
        yield stack, Owns(row[own[mine]], col[own[mine]], int(a), int(b), halo, size)


def apply_stacks(
    tiles: DataFrame, size: int, halo: int, fn: Callable[[np.ndarray, Owns], dict[str, object]], schema: str, keys: Sequence[str] = (), boundary="reflect",
) -> DataFrame:
    """``fn(stack, owns) -> columns`` on the padded blocks of many tiles at once; ``schema`` lists its columns, the key columns are put in front.

    A group holds a square of tiles of at most ``BUNCH`` pixels a side, or one tile, so what a call costs by itself is shared by small tiles.
    """
    names, side = list(keys), max(1, BUNCH // size)
    types = dict(tiles.dtypes)
    full = T.StructType.fromDDL(", ".join([f"`{k}` {types[k]}" for k in names] + [schema]))
    arrow = to_arrow_schema(full)

    def run(pieces: pa.Table) -> pa.Table:
        done = []
        for stack, owns in stacks(pieces, size, halo, boundary):
            out = fn(stack, owns)
            made = [out[f.name] for f in list(arrow)[len(names):]]
            held = [pieces.column(k).take(pa.array(np.zeros(len(made[0]), dtype=np.int64))) for k in names]
            columns = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in (*held, *made)]
            done.append(pa.table([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))
        return pa.concat_tables(done) if done else arrow.empty_table()

    pieces = halo_pieces(tiles, size, halo).withColumns({"_R": F.floor(F.col("tile_row") / side), "_C": F.floor(F.col("tile_col") / side)})
    spread = pieces.repartition(task_count(tiles), *names, "_R", "_C")
    return spread.groupBy(*names, "_R", "_C").applyInArrow(run, full)


def apply_blocks(
    tiles: DataFrame, size: int, halo: int, fn: Callable[[np.ndarray, Own], pd.DataFrame], schema: str,
    keys: Sequence[str] = (), boundary="reflect",
) -> DataFrame:
    """User function per tile with overlap, ``fn(block, own) -> rows``; ``schema`` lists its columns.

    ``boundary`` is ``"reflect"`` (absent tiles are mirrored too) or a fill number. The key columns are put in front.
    """
    names = [c.name for c in T.StructType.fromDDL(schema)]

    def each(stack: np.ndarray, owns: Owns) -> dict[str, object]:
        rows = [fn(block, Own(int(r), int(c), owns.h, owns.w, halo, int(r) * size, int(c) * size)) for block, r, c in zip(stack, owns.row, owns.col, strict=True)]
        return {n: pa.array(c, from_pandas=True) for n, c in pd.concat(rows)[names].items()}

    return apply_stacks(tiles, size, halo, each, schema, keys, boundary)


def task_count(df: DataFrame) -> int:
    """Shuffle partitions of the session. Kernels cost far more than the bytes they read, so their
    partitions are fixed by number; sized by bytes they would be merged into a few slow tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


TILE_SCHEMA = "tile_row bigint, tile_col bigint, h int, w int, pixels array<double>"


def trim(block: np.ndarray, own: Own | Owns) -> np.ndarray:
    return block[..., own.halo: own.halo + own.h, own.halo: own.halo + own.w]


def pixel_lists(stack: np.ndarray) -> pa.Array:
    """One list of pixels for each image of a stack."""
    flat = np.ascontiguousarray(stack, dtype=float).reshape(-1)
    each = int(np.prod(stack.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(stack) + 1, dtype=np.int32) * np.int32(each)), pa.array(flat))


def map_tiles(
    tiles: DataFrame, size: int, halo: int, kernel: Callable[[np.ndarray], np.ndarray], keys: Sequence[str] = (), boundary="reflect", stacked: bool = False
) -> DataFrame:
    """Kernel on the padded block with a result of the same shape; the halo is cut off again. A ``stacked`` kernel takes many blocks at once."""

    def fn(stack: np.ndarray, owns: Owns) -> dict[str, object]:
        out = np.asarray(kernel(stack), dtype=float) if stacked else np.stack([np.asarray(kernel(b), dtype=float) for b in stack])
        n = len(stack)
        return {"tile_row": owns.row, "tile_col": owns.col, "h": np.full(n, owns.h), "w": np.full(n, owns.w), "pixels": pixel_lists(trim(out, owns))}

    return apply_stacks(tiles, size, halo, fn, TILE_SCHEMA, keys, boundary)


def halo_ranges(grid: DataFrame, size: int, halo: int, height: Column, width: Column) -> DataFrame:
    """Clipped pixel ranges ``y0, y1, x0, x1`` of each block with its halo."""
    cut = lambda c, lim: F.least(F.greatest(c, F.lit(0)), lim)
    return grid.withColumns({
        "y0": cut(F.col("tile_row") * size - halo, height), "y1": cut((F.col("tile_row") + 1) * size + halo, height),
        "x0": cut(F.col("tile_col") * size - halo, width), "x1": cut((F.col("tile_col") + 1) * size + halo, width)})


def needed_halo(pixels: DataFrame, size: int, keys: Sequence[str] = (), label: str = "label", multiple: int = 16) -> DataFrame:
    """Halo that covers every object touching a block edge: ``(keys, halo)``, rounded up."""
    fg = pixels.where(F.col(label) > 0)
    block = {"_r": F.floor(F.col("y") / size), "_c": F.floor(F.col("x") / size)}
    part = fg.withColumns(block).groupBy(*keys, "_r", "_c", label).agg(
        (F.min("y") - F.first("_r") * size).alias("t"), (F.max("y") - F.first("_r") * size + 1).alias("b"),
        (F.min("x") - F.first("_c") * size).alias("l"), (F.max("x") - F.first("_c") * size + 1).alias("r"))
    reach = F.greatest(F.when(F.col("t") == 0, F.col("b")), F.when(F.col("l") == 0, F.col("r")),
                       F.when(F.col("b") == size, size - F.col("t")), F.when(F.col("r") == size, size - F.col("l")))
    return part.groupBy(*keys).agg((F.ceil(F.coalesce(F.max(reach), F.lit(0)) / multiple) * multiple).alias("halo"))


# --- block statistics --------------------------------------------------------------------------

def full_blocks(pixels: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    return pixels.withColumns({"block_row": F.floor(F.col("y") / size), "block_col": F.floor(F.col("x") / size)})


def block_stats(pixels: DataFrame, size: int, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population variance and Shannon entropy (bits) per full block; partial blocks are dropped."""
    b = [*keys, "block_row", "block_col"]
    counts = full_blocks(pixels, size).groupBy(*b, value).agg(F.count(F.lit(1)).alias("_n"))
    area = float(size * size)
    n, v = F.col("_n"), F.col(value).cast("double")
    g = counts.groupBy(*b).agg(
        F.sum("_n").alias("_t"), (F.sum(v * n) / area).alias("mean"), (F.sum(v * v * n) / area).alias("_m2"),
        (-F.sum(n / area * F.log2(n / area))).alias("entropy"))
    return g.where(F.col("_t") == size * size).select(
        *b, "mean", F.greatest(F.col("_m2") - F.col("mean") * F.col("mean"), F.lit(0.0)).alias("variance"), "entropy")


# --- pooling -----------------------------------------------------------------------------------

def pool(pixels: DataFrame, factor: int, how: str = "mean", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """T5: min-pool drops partial blocks; mean-pool pads them with zeros."""
    g = pixels.groupBy(*keys, F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x"))
    if how == "min":
        out = g.agg(F.min(value).alias(value), F.count(F.lit(1)).alias("_n"))
        return out.where(F.col("_n") == factor * factor).drop("_n")
    return g.agg((F.sum(value) / float(factor * factor)).alias(value))


def pyramid(pixels: DataFrame, levels: int, factor: int = 2, how: str = "mean", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """T5: long table of levels 0..``levels``; each level pools the one before."""
    cur = pixels.select(*keys, "y", "x", value)
    out = cur.withColumn("level", F.lit(0))
    for k in range(1, levels + 1):
        cur = pool(cur, factor, how, value, keys)
        out = out.unionByName(cur.withColumn("level", F.lit(k)))
    return out


# --- kernel density ----------------------------------------------------------------------------

def kernel_density(grid: DataFrame, bandwidth: float = 1.0, keys: Sequence[str] = (), reach: float = 4.0) -> DataFrame:
    """Gaussian density on the cells of a count grid ``(keys, row, col, n)``.

    Each non-empty cell spreads its weight over the offsets within ``reach`` bandwidths; the result is
    cut to the extent of the grid.
    """
    r = int(np.ceil(reach * bandwidth))
    offs = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= (reach * bandwidth) ** 2]
    norm = 1.0 / (2 * np.pi * bandwidth * bandwidth)
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                               F.lit(float(norm * np.exp(-(a * a + b * b) / (2 * bandwidth * bandwidth)))).alias("k")) for a, b in offs])
    seen = grid.where(F.col("n") > 0)
    total = seen.groupBy(*keys).agg(F.sum("n").alias("_t"))
    ext = grid.groupBy(*keys).agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    spread = seen.withColumn("o", F.explode(table)).groupBy(
        *keys, (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col")).agg(
        F.sum(F.col("n") * F.col("o.k")).alias("density"))
    placed = attach_small(attach_small(spread, total, list(keys)), ext, list(keys))
    inside = F.col("row").between(F.col("_r0"), F.col("_r1")) & F.col("col").between(F.col("_c0"), F.col("_c1"))
    return placed.where(inside).select(*keys, "row", "col", (F.col("density") / F.col("_t")).alias("density"))


# --- mosaics -----------------------------------------------------------------------------------

def stage_offsets(tiles: DataFrame, x: str, y: str, pixel_size: float, keys: Sequence[str] = ()) -> DataFrame:
    """Stage positions to pixel offsets ``dy, dx``: divided by the pixel size, rounded, minimum removed."""
    px = {"dy": F.bround(F.col(y) / pixel_size).cast("long"), "dx": F.bround(F.col(x) / pixel_size).cast("long")}
    at = tiles.withColumns(px)
    low = at.groupBy(*keys).agg(F.min("dy").alias("_y"), F.min("dx").alias("_x")) if keys else at.agg(F.min("dy").alias("_y"), F.min("dx").alias("_x"))
    return attach_small(at, low, list(keys)).withColumns({"dy": F.col("dy") - F.col("_y"), "dx": F.col("dx") - F.col("_x")}).drop("_y", "_x")


def place_tiles(pixels: DataFrame, order: str, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Pixels with their tile offset ``dy, dx`` to mosaic pixels; the later tile wins."""
    moved = pixels.withColumns({"y": F.col("y") + F.col("dy"), "x": F.col("x") + F.col("dx")})
    return moved.groupBy(*keys, "y", "x").agg(F.max_by(value, order).alias(value))


def fill_gaps(mosaic: DataFrame, fill: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Every pixel of the extent; gaps get the key's ``fill`` value.

    Only rows (one per ``y``) are enumerated on their own; each is exploded to its columns on the executors.
    """
    ext = mosaic.groupBy(*keys).agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    grid = attach_small(ext, fill, list(keys)).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_h"))))
    grid = grid.repartition(*keys, "y").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w"))))
    out = grid.join(mosaic, [*keys, "y", "x"], "left")
    return out.select(*keys, "y", "x", F.coalesce(value, "fill").alias(value))


def cut_tiles(pixels: DataFrame, tile: int, overlap: float, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """T12 inverse: a mosaic into overlapping tiles; tile ``i`` starts at ``i * round(tile * (1 - overlap))``."""
    step = int(round(tile * (1 - overlap)))
    first = lambda c: F.greatest(F.floor((F.col(c) - tile) / step) + 1, F.lit(0))
    cut = pixels.withColumn("tile_row", F.explode(F.sequence(first("y"), F.floor(F.col("y") / step)))).withColumn(
        "tile_col", F.explode(F.sequence(first("x"), F.floor(F.col("x") / step))))
    return cut.select(*keys, "tile_row", "tile_col", (F.col("y") - F.col("tile_row") * step).alias("y"),
                      (F.col("x") - F.col("tile_col") * step).alias("x"), value)


def class_sums(pixels: DataFrame, maps: DataFrame, on: Sequence[str], channel: str, cls: str, value: str = "value", weight: str = "weight") -> DataFrame:
    """Per class and channel the sum of values weighted by the class map, and over its support."""
    met = pixels.join(maps.where(F.col(weight) != 0), list(on))
    return met.groupBy(cls, channel).agg(F.sum(F.col(value) * F.col(weight)).alias("weighted_sum"),
                                         F.sum(F.when(F.col(weight) > 0, F.col(value)).otherwise(0.0)).alias("support_sum"))

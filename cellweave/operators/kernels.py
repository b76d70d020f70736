"""Numpy kernels per tile with halo and the operators built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators import stats as st
from cellweave.operators.components import connected_components
from cellweave.operators.ordered import attach_small, quantiles
from cellweave.operators.tiles import Owns, apply_stacks, flipped, map_tiles, mirror_rows, to_pixels, to_tiles, trim
from cellweave.session import durable


def gauss(sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def padded(img: np.ndarray, r: int, axes: Sequence[int] = (-2, -1), **how) -> np.ndarray:
    """An image, or each of a stack, padded by ``r`` pixels along ``axes``."""
    pad = [(0, 0)] * img.ndim
    for a in axes:
        pad[a] = (r, r)
    return np.pad(img, pad, **how)


def along(img: np.ndarray, weights: np.ndarray, axis: int, mode: str = "symmetric") -> np.ndarray:
    """Correlate with a short kernel along one axis of an image, or of each of a stack."""
    r = len(weights) // 2
    big = padded(img, r, (axis - 2,), mode=mode)
    n = img.shape[axis - 2]
    out = np.zeros(img.shape)
    for k, w in enumerate(weights):
        out += w * (big[..., k:k + n, :] if axis == 0 else big[..., k:k + n])
    return out


def laplacian(img: np.ndarray, mode: str) -> np.ndarray:
    second = np.array([1.0, -2.0, 1.0])
    return along(img, second, 0, mode) + along(img, second, 1, mode)


# --- T3 ----------------------------------------------------------------------------------------

def focus_scores(tiles: DataFrame, sigma: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Variance and norm of the Laplacian of each tile: ``(keys, tile_row, tile_col, variance, norm)``.

    A tile is scored on its own with mirrored borders (edge pixel not repeated), so there is neither halo
    nor shuffle: one Arrow batch of tiles in, one of numbers out.
    """

    def score(pixels: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = []
        for p, a, b in zip(pixels, h, w):
            img = np.asarray(p, dtype=float).reshape(a, b)
            if sigma:
                g = gauss(sigma)
                img = along(along(img, g, 0, "reflect"), g, 1, "reflect")
            lap = laplacian(img, "reflect") if min(img.shape) > 1 else np.zeros_like(img)
            rows.append((float(lap.var()), float(np.linalg.norm(lap))))
        return pd.DataFrame(rows, columns=["variance", "norm"])

    udf = F.pandas_udf(score, T.StructType([T.StructField("variance", T.DoubleType()), T.StructField("norm", T.DoubleType())]))
    return tiles.select(*keys, "tile_row", "tile_col", udf("pixels", "h", "w").alias("_s")).select(
        *keys, "tile_row", "tile_col", "_s.variance", "_s.norm")


# --- T4 ----------------------------------------------------------------------------------------

def along_image(img: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """:func:`along` on an image with NaN where it is absent; every line goes on as its own mirror image there."""
    there = ~np.isnan(img)
    if not there.all():
        img = mirror_rows(img, there)[0] if axis else flipped(mirror_rows(flipped(img), flipped(there))[0])
    return np.where(there, along(img, weights, axis), np.nan)


def log_response(img: np.ndarray, sigma: float) -> np.ndarray:
    """Negative Laplacian of Gaussian, bright spots positive; NaN marks pixels outside the image."""
    if sigma == 0:
        second = np.array([1.0, -2.0, 1.0])
        return -(along_image(img, second, 0) + along_image(img, second, 1))
    g = gauss(sigma)
    r = len(g) // 2
    k = np.arange(-r, r + 1)
    second = g * (k * k / sigma ** 4 - 1 / sigma ** 2)
    return -(along_image(along_image(img, second, 0), g, 1) + along_image(along_image(img, g, 0), second, 1))


def pairs_of(shape: tuple[int, int], dy: int, dx: int) -> tuple[tuple[slice, slice], tuple[slice, slice]]:
    """Slices of all pixels that have a neighbour at ``(dy, dx)``, ``dy >= 0``, and of those neighbours."""
    h, w = shape[-2:]
    return ((..., slice(0, h - dy), slice(max(0, -dx), w - max(0, dx))), (..., slice(dy, h), slice(max(0, dx), w + min(0, dx))))


STRAIGHT, DIAGONAL = ((0, 1), (1, 0)), ((1, 1), (1, -1))
AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def plateaus(img: np.ndarray, steps: Sequence[tuple[int, int]]) -> np.ndarray:
    """Raster number of the first pixel of the plateau (connected pixels of one value) that each pixel lies on."""
    lab = np.arange(img.size).reshape(img.shape)
    while True:
        before = lab.copy()
        for step in steps:
            a, b = pairs_of(img.shape, *step)
            low = np.where(img[a] == img[b], np.minimum(lab[a], lab[b]), img.size)
            lab[a] = np.minimum(lab[a], low)
            lab[b] = np.minimum(lab[b], low)
        lab = lab.ravel()[lab]
        if np.array_equal(before, lab):
            return lab


SPOT = "Y int, X int, _LoG_intensity double, channel_intensity double"


def tile_peaks(resp: np.ndarray, block: np.ndarray, owns: Owns) -> dict[str, np.ndarray]:
    """Peaks of each tile of a stack, and the parts of plateaus that go on in another tile.

    ``resp`` covers the tiles and a ring of one pixel, ``-inf`` outside the image. A part is known by its first pixel
    ``Y, X``; each of its rows names a pixel ``by, bx`` and an equal neighbour ``ny, nx`` of another part.
    """
    h, w = owns.h, owns.w
    at = resp[:, 1:-1, 1:-1]
    higher, lower = np.zeros(at.shape, bool), np.zeros(at.shape, bool)
    near = {(dy, dx): resp[:, 1 + dy:1 + dy + h, 1 + dx:1 + dx + w] for dy, dx in AROUND}
    for other in near.values():
        higher |= other > at
        lower |= (other < at) & (other > -np.inf)
    part, whole = plateaus(at, STRAIGHT).ravel(), plateaus(at, STRAIGHT + DIAGONAL).ravel()
    image = at.ravel() > -np.inf

    def on_whole(flag: np.ndarray) -> np.ndarray:
        out = np.zeros(at.size, bool)
        out[whole[flag.ravel()]] = True
        return out[whole]

    tile, yy, xx = np.indices(at.shape)
    y0, x0 = owns.row * owns.size, owns.col * owns.size
    link, outside = [], np.zeros(at.shape, bool)
    for (dy, dx), other in near.items():
        out = (yy + dy < 0) | (yy + dy >= h) | (xx + dx < 0) | (xx + dx >= w)
        same = other == at
        outside |= same & out
        target = tile * (h * w) + np.clip(yy + dy, 0, h - 1) * w + np.clip(xx + dx, 0, w - 1)
        link.append((dy, dx, same & (out | (part[target] != part.reshape(at.shape)))))
    crossing, dead, rises = on_whole(outside), on_whole(higher), on_whole(lower)
    first = np.flatnonzero((part == np.arange(at.size)) & image & ~crossing & ~dead & rises)
    rows = [np.stack([first, *[np.full(len(first), -1)] * 4], axis=1)]
    for dy, dx, met in link:
        t, y, x = np.nonzero(met & (crossing & image).reshape(at.shape))
        rows.append(np.stack([part[(t * h + y) * w + x], y + y0[t], x + x0[t], y + dy + y0[t], x + dx + x0[t]], axis=1))
    got = np.concatenate(rows)
    f = got[:, 0]
    t, y, x = f // (h * w), f // w % h, f % w
    return {
        "Y": (y + y0[t]).astype("int32"), "X": (x + x0[t]).astype("int32"), "_LoG_intensity": at.ravel()[f],
        "channel_intensity": block.ravel()[f], "dead": dead[f], "rises": rises[f], "crossing": got[:, 1] >= 0,
        "by": got[:, 1], "bx": got[:, 2], "ny": got[:, 3], "nx": got[:, 4]}


def spot_reach(sigma: float) -> int:
    """Pixels around a tile that its peaks depend on: the kernel and a ring of one."""
    return (1 if sigma == 0 else len(gauss(sigma)) // 2) + 1


def spot_candidates(tiles: DataFrame, size: int, sigma: float = 1.0, keys: Sequence[str] = (), halo: int | None = None) -> DataFrame:
    """T4: every local maximum over the eight neighbours: ``(keys, Y, X, _LoG_intensity, channel_intensity)``.

    A plateau with a higher neighbour anywhere has none; of another one the first pixel (in raster order) of each part
    that hangs together by straight steps is kept, across tiles too. The image goes on as its mirror image, so a first pixel
    in the first row or column lies on the mirrored side and is left out. A constant image has no maximum. ``halo`` follows from ``sigma``; a smaller one is an error.
    """
    reach = spot_reach(sigma)
    halo = reach if halo is None else halo
    if halo < reach:
        raise ValueError(f"sigma {sigma} needs a halo of {reach} pixels, not {halo}")

    def fn(stack: np.ndarray, owns: Owns) -> dict[str, np.ndarray]:
        resp = np.where(np.isnan(stack), -np.inf, log_response(stack, sigma))
        return tile_peaks(resp[:, halo - 1:halo + owns.h + 1, halo - 1:halo + owns.w + 1], trim(stack, owns), owns)

    found = durable(apply_stacks(
        tiles, size, halo, fn, SPOT + ", dead boolean, rises boolean, crossing boolean, by bigint, bx bigint, ny bigint, nx bigint",
        keys, boundary=float("nan")))
    columns = [*keys, "Y", "X", "_LoG_intensity", "channel_intensity"]
    peaks = found.where("not crossing").select(*columns)
    parts = found.where("crossing")
    if not parts.isEmpty():
        peaks = peaks.unionByName(crossing_peaks(parts, columns, keys))
    return peaks.where("Y > 0 and X > 0")


def crossing_peaks(parts: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Peaks of the plateaus that lie in several tiles."""
    parts = parts.withColumn("node", F.struct(*keys, "Y", "X"))
    back = parts.select(*keys, F.col("node").alias("other"), F.col("by").alias("ny"), F.col("bx").alias("nx"),
                        F.col("ny").alias("by"), F.col("nx").alias("bx"))
    edges = durable(parts.join(back, [*keys, "by", "bx", "ny", "nx"]).select(
        "node", "other", (F.abs(F.col("by") - F.col("ny")) + F.abs(F.col("bx") - F.col("nx")) == 1).alias("straight")).distinct())
    one = parts.groupBy("node", *columns).agg(F.bool_or("dead").alias("dead"), F.bool_or("rises").alias("rises"))
    whole = connected_components(edges, "node", "other").withColumnRenamed("component", "whole")
    flags = one.join(whole, "node", "left").withColumn("whole", F.coalesce("whole", "node"))
    good = flags.groupBy("whole").agg(F.bool_or("dead").alias("d"), F.bool_or("rises").alias("r")).where("r and not d").select("whole")
    part = connected_components(edges.where("straight"), "node", "other")
    first = flags.join(good, "whole").join(part, "node", "left")
    return first.where(F.coalesce("component", "node") == F.col("node")).select(*columns)


def detect_spots(
    tiles: DataFrame, size: int, sigma: float = 1.0, keys: Sequence[str] = (), halo: int | None = None, top: int = 65535, bins: int = 256
) -> DataFrame:
    """T4: maxima above the triangle threshold of all responses, with the response rescaled to ``0..top``."""
    cand = durable(spot_candidates(tiles, size, sigma, keys, halo))  # read three times below
    thr = st.triangle_threshold(st.histogram(cand, list(keys), "_LoG_intensity", bins), list(keys))
    kept = st.attach_small(cand, thr, list(keys)).where(F.col("_LoG_intensity") > F.col("threshold")).drop("threshold")
    lim = st.value_limits(kept, list(keys), "_LoG_intensity")
    scaled = (F.col("_LoG_intensity") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * top
    return st.attach_small(kept, lim, list(keys)).withColumn(
        "LoG_intensity", F.coalesce(F.bround(scaled), F.lit(0)).cast("int")).drop("lo", "hi")


# --- T6 ----------------------------------------------------------------------------------------

# Up to this radius the image is reduced by this factor before the ball rolls.
SHRINK = ((10, 1), (30, 2), (100, 4))
SHRINK_LARGE = 8


def shrink_factor(radius: float) -> int:
    return next((f for limit, f in SHRINK if radius <= limit), SHRINK_LARGE)


def ball_background(img: np.ndarray, radius: float) -> np.ndarray:
    """Lowest position of a ball of ``radius`` pressed from below, per pixel (image surrounded by +inf)."""
    r = int(math.ceil(radius))
    big = padded(img, r, constant_values=np.inf)
    h, w = img.shape[-2:]
    out = np.full(img.shape, np.inf)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            d2 = dy * dy + dx * dx
            if d2 <= radius * radius:
                np.minimum(out, big[..., r + dy:r + dy + h, r + dx:r + dx + w] + (radius - math.sqrt(radius * radius - d2)), out=out)
    return out


def resize_linear(img: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear with half-pixel centres, borders clamped."""
    out = img
    for axis in (-2, -1):
        n, m = img.shape[axis], shape[axis]
        pos = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(pos).astype(int)
        hi = np.minimum(lo + 1, n - 1)
        f = pos - lo
        a, b = np.take(out, lo, axis), np.take(out, hi, axis)
        f = f[:, None] if axis == -2 else f
        out = a * (1 - f) + b * f
    return out


def background_of(block: np.ndarray, radius: float) -> np.ndarray:
    third = np.full(3, 1 / 3)
    smooth = along(along(block, third, 0, "reflect"), third, 1, "reflect")
    f = shrink_factor(radius)
    h, w = smooth.shape[-2:]
    small = np.full((*smooth.shape[:-2], h // f, w // f), np.inf)
    for dy in range(f):  # minimum of every f x f square, one place of the squares at a time
        for dx in range(f):
            np.minimum(small, smooth[..., dy:h // f * f:f, dx:w // f * f:f], out=small)
    return resize_linear(ball_background(small, max(radius / f, 1.0)), block.shape[-2:])


def subtract_background(tiles: DataFrame, size: int, radius: float = 50.0, keys: Sequence[str] = ()) -> DataFrame:
    """Image minus rolling-ball background, never below zero. The tile must exceed two radii."""
    halo = math.ceil(radius)
    if size <= 2 * halo:
        raise ValueError(f"a radius of {radius} needs tiles wider than {2 * halo} pixels, these have {size}")
    return map_tiles(tiles, size, halo, lambda b: np.maximum(b - background_of(b, radius), 0), keys, stacked=True)


# --- T7 ----------------------------------------------------------------------------------------

def rank_filter(img: np.ndarray, offsets, how) -> np.ndarray:
    """Extreme or sum over any offsets; disks have :func:`disk_filter`."""
    r = max(max(abs(a), abs(b)) for a, b in offsets)
    big = padded(img, r, mode="symmetric")
    h, w = img.shape[-2:]
    out = None
    for a, b in offsets:
        v = big[..., r + a:r + a + h, r + b:r + b + w]
        out = v.copy() if out is None else how(out, v, out=out)
    return out


def sliding(img: np.ndarray, length: int, how) -> np.ndarray:
    """Extreme of ``length`` neighbours along rows, from running extremes of blocks of that length forwards and backwards."""
    w, lines = img.shape[-1], img.shape[:-1]
    blocks = np.concatenate([img, np.repeat(img[..., -1:], -w % length, axis=-1)], axis=-1).reshape(*lines, -1, length)
    ahead = how.accumulate(blocks, axis=-1).reshape(*lines, -1)
    back = how.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(*lines, -1)
    return how(back[..., :w - length + 1], ahead[..., length - 1:w])


def disk_filter(img: np.ndarray, radius: int, how) -> np.ndarray:
    """Extreme over a disk: each of its rows is a chord, chords of one length share one pass along rows. Linear in the radius."""
    big = padded(img, radius, mode="symmetric")
    h, w = img.shape[-2:]
    chords: dict[int, list[int]] = {}
    for a in range(-radius, radius + 1):
        chords.setdefault(math.isqrt(radius * radius - a * a), []).append(a)
    out = None
    for half, places in chords.items():
        row = sliding(big[..., radius - half:radius + w + half], 2 * half + 1, how)
        for a in places:
            part = row[..., radius + a:radius + a + h, :]
            out = part.copy() if out is None else how(out, part, out=out)
    return out


def outline(tiles: DataFrame, size: int, grow: int = 1, shrink: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Labels kept only where the neighbourhood is not uniform (maximum over one disk, minimum over another)."""
    def kernel(b):
        return np.where(disk_filter(b, grow, np.maximum) == disk_filter(b, shrink, np.minimum), 0, b)
    return map_tiles(tiles, size, max(grow, shrink), kernel, keys, stacked=True)


def dilate(tiles: DataFrame, size: int, radius: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Grey dilation with a disk."""
    return map_tiles(tiles, size, radius, lambda b: disk_filter(b, radius, np.maximum), keys, stacked=True)


def nearest_in_row(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the nearest label of the same row and that label, ties the smaller; without any the distance is that of twice the width."""
    w = img.shape[-1]
    at = np.arange(w)
    left = np.maximum.accumulate(np.where(img > 0, at, -2 * w), axis=-1)
    right = np.minimum.accumulate(np.where(img > 0, at, 3 * w)[..., ::-1], axis=-1)[..., ::-1]
    dl, dr = np.minimum(at - left, 2 * w), np.minimum(right - at, 2 * w)
    ll, lr = np.take_along_axis(img, np.maximum(left, 0), -1), np.take_along_axis(img, np.minimum(right, w - 1), -1)
    first = (dl < dr) | (dl == dr) & (ll <= lr)
    return np.where(first, dl, dr), np.where(first, ll, lr)


def lower_envelope(cost: np.ndarray, known: np.ndarray, scale: int) -> np.ndarray:
    """``min over k of scale * (y - k) ** 2 + cost[k]`` down each column, over the ``known`` rows k; -1 where there is none.

    The parabolas that are lowest somewhere are kept on a stack for each column, with the first row where each is lowest; all columns move together.
    """
    n, w = cost.shape
    row, since, top = np.zeros((n, w), np.int64), np.zeros((n, w), np.int64), np.full(w, -1)
    for q in range(n):
        todo = np.flatnonzero(known[q])
        while len(todo):
            t = top[todo]
            p = row[np.maximum(t, 0), todo]
            gap = cost[q, todo] + scale * q * q - cost[p, todo] - scale * p * p
            start = np.where(t < 0, 0, gap // np.where(t < 0, 1, 2 * scale * (q - p)) + 1)
            over = (t >= 0) & (start <= since[np.maximum(t, 0), todo])
            new = ~over & (start < n)
            at = todo[new]
            top[at] += 1
            row[top[at], at], since[top[at], at] = q, start[new]
            todo = todo[over]
            top[todo] -= 1
    out, cols, k = np.full((n, w), -1, np.int64), np.flatnonzero(top >= 0), np.zeros(w, np.int64)
    for y in range(n):
        while True:
            more = cols[k[cols] < top[cols]]
            more = more[since[k[more] + 1, more] <= y]
            if not len(more):
                break
            k[more] += 1
        p = row[k[cols], cols]
        out[y, cols] = scale * (y - p) ** 2 + cost[p, cols]
    return out


def grow_labels(img: np.ndarray, distance: int) -> np.ndarray:
    """Two passes of an exact distance transform that carry the label: along rows, then down columns, where squared distance and the
    place of the label among all labels are one number. The work doesn't depend on the distance."""
    labels, place = np.unique(img[img > 0], return_inverse=True)
    if not len(labels):
        return img
    ranks = np.zeros(img.shape, dtype=np.int64)
    ranks[img > 0] = place + 1
    d, rank = nearest_in_row(ranks)
    scale = len(labels) + 1
    columns = lambda a: np.moveaxis(a, -2, 0).reshape(a.shape[-2], -1)  # noqa: E731 - those of all images of a stack beside each other
    best = lower_envelope(columns(d * d * scale + rank), columns(d <= distance), scale)
    best = np.moveaxis(best.reshape(img.shape[-2], *img.shape[:-2], img.shape[-1]), 0, -2)
    hit = (img <= 0) & (best >= 0) & (best // scale <= distance * distance)
    out = img.copy()
    out[hit] = labels[best[hit] % scale - 1]
    return out


def expand_labels(tiles: DataFrame, size: int, distance: int, keys: Sequence[str] = ()) -> DataFrame:
    """Background within ``distance`` of an object takes the nearest label, ties the smallest."""
    return map_tiles(tiles, size, distance, lambda b: grow_labels(b, distance), keys, boundary=0, stacked=True)


def to_binary(tiles: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Objects as 1 with touching objects kept apart: pixels next to another label become background."""
    def kernel(b):
        uniform = disk_filter(b, 1, np.maximum) == disk_filter(b, 1, np.minimum)
        return ((b > 0) & uniform).astype(float)
    return map_tiles(tiles, size, 1, kernel, keys, stacked=True)


# --- T9 ----------------------------------------------------------------------------------------

def window_entropy(block: np.ndarray, k: int, cells: int = 1 << 24) -> np.ndarray:
    """Entropy (bits) of the values in each ``k`` x ``k`` window; NaN marks pixels outside the image.

    Each row of a strip has a histogram of its window, which moves along the row: one column of pixels leaves, one enters, and the sum of
    ``c log2 c`` follows. A strip has as many rows as keep the histograms within ``cells`` counts.
    """
    r = k // 2
    h, w = block.shape[-2:]
    big = padded(block, r, constant_values=np.nan).reshape(-1, h + 2 * r, w + 2 * r)
    values, code = np.unique(big, return_inverse=True)
    code = code.reshape(big.shape)
    inside = ~np.isnan(big)
    levels = len(values)
    term = np.arange(k * k + 2) * np.log2(np.maximum(np.arange(k * k + 2), 1))
    out = np.zeros((len(big) * h, w))
    strip = max(1, min(len(out), cells // levels))
    for a in range(0, len(out), strip):
        line = np.arange(a, min(a + strip, len(out)))
        image, first, rows = line // h, line % h, np.arange(len(line))
        counts = np.zeros((len(rows), levels), dtype=np.int32)
        total, n = np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64)

        def change(column: int, by: int) -> None:
            for dy in range(k):
                level, real = code[image, first + dy, column], inside[image, first + dy, column]
                c = counts[rows, level]
                counts[rows, level] = c + by
                total[:] += np.where(real, term[np.minimum(c + by, k * k)] - term[np.minimum(c, k * k)], 0.0)
                n[:] += by * real

        for x in range(k - 1):
            change(x, 1)
        for x in range(w):
            change(x + k - 1, 1)
            m = np.maximum(n, 1)
            out[line, x] = np.maximum(np.log2(m) - total / m, 0.0)
            change(x, -1)
    return out.reshape(block.shape)


def local_entropy(tiles: DataFrame, size: int, k: int = 9, keys: Sequence[str] = ()) -> DataFrame:
    """Entropy image of tiles that hold integer grey levels."""
    return map_tiles(tiles, size, k // 2, lambda b: window_entropy(b, k), keys, boundary=float("nan"), stacked=True)


def channel_maximum(tiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Largest value over the channels of each pixel, one tile per place; a channel that lacks the tile does not count.

    Tiles travel as pixel rows, so a task holds one row of a tile in all channels, never a tile in all channels. Tiles of one
    place must have one shape; nulls and NaN do not count, a pixel without any value becomes 0.
    """
    at = [*keys, "tile_row", "tile_col", "h", "w"]
    line = lambda i: F.transform(F.slice("pixels", i * F.col("w") + 1, F.col("w")), lambda v: F.when(~F.isnan(v), v))
    rows = tiles.where((F.col("h") > 0) & (F.col("w") > 0)).select(*at, F.inline(F.transform(
        F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.struct(i.alias("_i"), line(i).alias("_v")))))
    each = rows.groupBy(*at, "_i").agg(F.collect_list("_v").alias("_all"))
    best = each.withColumn("_v", F.reduce("_all", F.array_repeat(F.lit(None).cast("double"), F.col("w")), lambda a, v: F.zip_with(a, v, lambda p, q: F.greatest(p, q))))
    done = best.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_rows"))
    flat = F.flatten(F.transform("_rows", lambda r: r["_v"]))
    return done.select(*at, F.transform(flat, lambda v: F.coalesce(v, F.lit(0.0))).alias("pixels"))


def tissue_mask(
    tiles: DataFrame, size: int, dilation: int = 2, level: int = 0, centre: float = -0.2, k: int = 9, grey: int = 1023,
    keys: Sequence[str] = (), channel: str | None = None,
) -> DataFrame:
    """Pixels ``(keys, y, x, value, tissue)`` of a thumbnail; ``keys`` name the image, so all slides are one job.

    With ``channel`` the maximum over an image's channels is taken first. Then per image log1p, rescale to ``0..grey``, window entropy,
    Otsu threshold moved by ``centre`` and the chosen level; bright pixels (first quartile of the tissue) are rescued, the mask
    is dilated, and when more than 90 % is tissue everything is kept. An image of one value has no tissue.
    """
    own = list(keys) or ["_image"]
    base = tiles if keys else tiles.withColumn("_image", F.lit(0))
    if channel is not None:
        base = channel_maximum(base, own)
    img = base.withColumn("pixels", F.transform("pixels", lambda v: F.log1p(v)))
    ends = img.groupBy(*own).agg(F.min(F.array_min("pixels")).alias("_lo"), F.max(F.array_max("pixels")).alias("_hi"))
    levels = attach_small(img, ends, own).withColumn("pixels", F.transform("pixels", lambda v: F.floor(
        (v - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) * grey).cast("double"))).drop("_lo", "_hi")
    at = [*own, "y", "x"]
    ent = to_pixels(local_entropy(levels, size, k, own), size, own, value="entropy")
    both = durable(to_pixels(img, size, own).join(ent, at))
    limits = st.value_limits(both, own, "entropy")
    lim = limits.join(st.otsu_threshold(st.histogram(both, own, "entropy", 256, limits), own), own)
    thr = st.threshold_levels(lim, centre=centre).where(F.col("level") == level).select(*own, F.col("threshold").alias("_t"))
    marked = attach_small(both, thr, own, how="left").withColumn("_in", F.coalesce(F.col("entropy") > F.col("_t"), F.lit(False)))
    bright = quantiles(marked.where("_in"), own, "value", [0.25], wide=True).select(*own, F.col("q")[0].alias("_b"))
    seeds = attach_small(marked, bright, own, how="left").withColumn("tissue", F.col("_in") | F.coalesce(F.col("value") >= F.col("_b"), F.lit(False)))
    seeds = durable(seeds.select(*at, "value", F.col("tissue").cast("int").alias("value_in")))
    grown = to_pixels(dilate(to_tiles(seeds, size, own, value="value_in"), size, dilation, own), size, own, value="_g") if dilation else (
        seeds.select(*at, F.col("value_in").cast("double").alias("_g")))
    grown = durable(grown)
    share = grown.groupBy(*own).agg(F.avg("_g").alias("_share"))
    out = attach_small(seeds.join(grown, at), share, own)
    return out.select(*keys, "y", "x", "value", ((F.col("_g") > 0) | (F.col("_share") > 0.9)).alias("tissue"))


def apply_mask(pixels: DataFrame, mask: DataFrame, factor: int, flag: str = "tissue", value: str = "value") -> DataFrame:
    """Full-size pixels outside the (reduced) mask, or beyond it, become zero."""
    at = pixels.withColumns({"_y": F.floor(F.col("y") / factor), "_x": F.floor(F.col("x") / factor)})
    m = mask.where(F.col(flag)).select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.lit(True).alias("_keep"))
    out = at.join(m, ["_y", "_x"], "left").drop("_y", "_x")
    return out.withColumn(value, F.when(F.col("_keep"), F.col(value)).otherwise(F.lit(0))).drop("_keep")


# --- T11 ---------------------------------------------------------------------------------------

def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Whole-pixel shift that registers ``b`` with ``a`` and one minus the squared correlation there."""
    fa, fb = np.fft.fft2(a), np.fft.fft2(b)
    cross = fa * np.conj(fb)
    corr = np.fft.ifft2(cross / np.maximum(np.abs(cross), 100 * np.finfo(float).eps))
    at = np.unravel_index(np.argmax(np.abs(corr)), corr.shape)
    shift = [float(i - n if i > n // 2 else i) for i, n in zip(at, corr.shape)]
    power = float(np.sum(np.abs(fa) ** 2) * np.sum(np.abs(fb) ** 2))
    hit = np.abs(np.fft.ifft2(cross)[at]) * a.size
    err = 1.0 - float(hit * hit) / power if power > 0 else 1.0
    return shift[0], shift[1], math.sqrt(max(err, 0.0))


def block_shifts(first: DataFrame, second: DataFrame, keys: Sequence[str] = (), masked: DataFrame | None = None) -> DataFrame:
    """``(keys, tile_row, tile_col, dy, dx, error)`` between equal tiles of two channels; blocks absent from
    ``masked`` (keys of the blocks to use) are skipped."""
    on = [*keys, "tile_row", "tile_col"]
    pair = first.select(*on, "h", "w", F.col("pixels").alias("_a")).join(second.select(*on, F.col("pixels").alias("_b")), on)
    if masked is not None:
        pair = pair.join(masked.select(*on).distinct(), on, "left_semi")

    def shift(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = [phase_shift(np.asarray(p, float).reshape(i, j), np.asarray(q, float).reshape(i, j)) for p, q, i, j in zip(a, b, h, w)]
        return pd.DataFrame(rows, columns=["dy", "dx", "error"])

    udf = F.pandas_udf(shift, T.StructType([T.StructField(n, T.DoubleType()) for n in ("dy", "dx", "error")]))
    return pair.select(*on, udf("_a", "_b", "h", "w").alias("_s")).select(*on, "_s.*")

"""Connected components of graphs and images (T8), greedy minimum spacing.

Each round is cut off with a reliable checkpoint, so a lost executor costs one round at most; only
row counts come back to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.tiles import TILE_SCHEMA, Owns, apply_stacks, pixel_lists, to_pixels
from cellweave.session import durable


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)``; the component is its smallest node. Alternating large and small stars.

    A star's smallest node is found by a map-side combined minimum, never by gathering its neighbours. The
    number of rounds grows with the logarithm of the graph.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    cur = durable(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None  # number and hash of the pairs after a round; unchanged means settled
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        nxt = durable(small)
        sign = tuple(nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        cur, settled, last = nxt, sign == last, sign
        if settled:
            root = cur.groupBy("u").agg(F.min("v").alias("component"))
            return nodes.join(root.withColumnRenamed("u", "node"), "node", "left").withColumn(
                "component", F.coalesce("component", "node"))


def tile_labels(mask: np.ndarray, start: np.ndarray, eight: bool) -> np.ndarray:
    """Labels within each tile of a stack: each object carries the raster position of its first pixel plus the ``start`` of the tile."""
    n, h, w = mask.shape
    big = np.iinfo(np.int64).max
    lab = np.where(mask > 0, np.arange(mask.size).reshape(mask.shape), big)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    while True:
        before = lab.copy()
        for dy, dx in steps:
            ys, yt = slice(0, h - dy), slice(dy, h)
            xs, xt = (slice(0, w - dx), slice(dx, w)) if dx >= 0 else (slice(-dx, w), slice(0, w + dx))
            low = np.minimum(lab[:, ys, xs], lab[:, yt, xt])
            both = (lab[:, ys, xs] < big) & (lab[:, yt, xt] < big)
            lab[:, ys, xs] = np.where(both, low, lab[:, ys, xs])
            lab[:, yt, xt] = np.where(both, np.minimum(low, lab[:, yt, xt]), lab[:, yt, xt])
        fg = lab < big
        lab[fg] = np.minimum(lab[fg], lab.ravel()[lab[fg]])  # jump to the label of the label's pixel
        if np.array_equal(before, lab):
            return np.where(fg, lab % max(h * w, 1) + start[:, None, None], 0)


FAN = 8  # regions a side that are merged into one


def joined_labels(y: np.ndarray, x: np.ndarray, label: np.ndarray, eight: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct labels of some pixels and, for each, the smallest label it is connected with through neighbouring pixels."""
    names, at = np.unique(label, return_inverse=True)
    wide = int(x.max() - x.min()) + 3
    place = (y - y.min()) * wide + (x - x.min()) + 1
    order = np.argsort(place, kind="stable")
    spots, at = place[order], at[order]
    pairs = []
    for step in [1, wide] + ([wide + 1, wide - 1] if eight else []):
        k = np.minimum(np.searchsorted(spots, spots + step), len(spots) - 1)
        met = spots[k] == spots + step
        pairs.append(np.stack([at[met], at[k[met]]]))
    a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
    root = np.arange(len(names))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(before, root):
            return names, names[root]


def border_roots(edge: DataFrame, size: int, levels: int, eight: bool, keys: Sequence[str]) -> DataFrame | None:
    """``(keys, label, component)`` for the labels that are not the smallest of their object. ``edge``: border pixels ``(keys, y, x, label)``.

    Regions of ``FAN`` x ``FAN`` tiles merge the labels at their inner borders, then regions of as many such regions, and so on. Only the
    pixels at a region's outer border go on, so a task holds the borders of one region. Every level tells which label became which;
    composed from the top down they give the final label of each.
    """
    kinds = dict(edge.dtypes)
    own = [f"`{k}` {kinds[k]}" for k in keys]

    def merging(span: int):
        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            y, x, label = (pdf[c].to_numpy() for c in ("y", "x", "label"))
            names, root = joined_labels(y, x, label, eight)
            now = root[np.searchsorted(names, label)]
            outer = (y % span == 0) | (y % span == span - 1) | (x % span == 0) | (x % span == span - 1)
            moved = names != root
            none, gone = np.zeros(int(moved.sum()), np.int64), np.zeros(int(outer.sum()), np.int64)
            out = pd.DataFrame({"y": np.append(y[outer], none), "x": np.append(x[outer], none), "label": np.append(now[outer], names[moved]),
                                "root": np.append(gone, root[moved])})
            for k in keys:
                out.insert(0, k, pd.Series([pdf[k].iloc[0]] * len(out), dtype=pdf[k].dtype))
            return out

        return merge

    steps, span = [], size
    for _ in range(levels):
        span *= FAN
        region = [*keys, F.floor(F.col("y") / span), F.floor(F.col("x") / span)]
        schema = ", ".join([*reversed(own), "y long, x long, label long, root long"])
        both = durable(edge.groupBy(*region).applyInPandas(merging(span), schema))
        steps.append(both.where("root > 0").select(*keys, "label", F.col("root").alias("component")))
        edge = both.where("root = 0").select(*keys, "y", "x", "label")
    known = None
    for step in reversed(steps):
        if known is not None:
            above = known.select(*keys, F.col("component").alias("_top"), F.col("label").alias("component"))
            step = known.unionByName(step.join(above, [*keys, "component"], "left").select(*keys, "label", F.coalesce("_top", "component").alias("component")))
        known = step
    return known


def label_components(tiles: DataFrame, size: int, width: int, eight: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Pixels ``(keys, y, x, label)`` of a binary mask, labelled across the tiles of each image.

    ``width`` is the width of the images in tiles, of the widest at least; the label is 1 + the smallest (tile, raster) number in the
    object. Tiles are labelled on their own; labels at their borders are merged region by region (:func:`border_roots`) and what
    changes is told to the tiles that hold such labels, so no pixels are moved.
    """
    keys = list(keys)
    area = size * size
    kinds = dict(tiles.dtypes)

    def fn(stack: np.ndarray, owns: Owns) -> dict[str, object]:
        lab = tile_labels(stack, (owns.row * width + owns.col) * area + 1, eight)
        n = len(stack)
        return {"tile_row": owns.row, "tile_col": owns.col, "h": np.full(n, owns.h), "w": np.full(n, owns.w), "pixels": pixel_lists(lab)}

    local = durable(apply_stacks(tiles, size, 0, fn, TILE_SCHEMA, keys))
    px = to_pixels(local, size, keys, value="label").where(F.col("label") > 0).withColumn("label", F.col("label").cast("long"))
    at = lambda c: F.pmod(F.col(c), F.lit(size))
    edge = px.where((at("y") == 0) | (at("y") == size - 1) | (at("x") == 0) | (at("x") == size - 1))
    last = local.agg(F.max(F.greatest("tile_row", "tile_col"))).first()[0]
    levels, reach = 0, 1
    while last is not None and reach <= last:
        levels, reach = levels + 1, reach * FAN
    if not levels:
        return px
    known = border_roots(edge, size, levels, eight, keys)
    tile = F.floor((F.col("label") - 1) / area)
    told = known.groupBy(*keys, F.floor(tile / width).alias("tile_row"), (tile % width).alias("tile_col")).agg(
        F.sort_array(F.collect_list(F.struct("label", "component"))).alias("_told"))  # labels at the border of one tile
    rows = local.join(told, [*keys, "tile_row", "tile_col"], "left").withColumns({"_from": F.col("_told.label"), "_to": F.col("_told.component")}).drop("_told")

    def renamed(frames):
        for pdf in frames:
            out = []
            for pixels, old, new in zip(pdf["pixels"], pdf["_from"], pdf["_to"], strict=True):
                v = np.asarray(pixels).astype(np.int64)
                if old is not None:
                    k = np.minimum(np.searchsorted(old, v), len(old) - 1)
                    v = np.where(np.asarray(old)[k] == v, np.asarray(new)[k], v)
                out.append(v)
            yield pdf.drop(columns=["_from", "_to"]).assign(pixels=out)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "tile_row long, tile_col long, h int, w int, pixels array<long>"])
    final = rows.select(*keys, "tile_row", "tile_col", "h", "w", "pixels", "_from", "_to").mapInPandas(renamed, schema)
    return to_pixels(final, size, keys, value="label").where(F.col("label") > 0)


def placeable(points: DataFrame, idc: str, score: str, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Rows with id and keys, a score that is a number, and a finite place."""
    there = F.col(idc).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    for c in keys:
        there &= F.col(c).isNotNull()
    for c in (x, y):
        there &= F.abs(F.col(c).cast("double")) < F.lit(float("inf"))  # NaN is larger than infinity here
    return points.where(there)


#: Points a task decides on at once, those around its tile included; tiles of 8 to the power of 0 to ``TILE_LEVELS`` cells are tried.
TILE_POINTS = 200_000
TILE_LEVELS = 10
WINNER_ROUNDS = 3


def greedy_in_tile(pdf: pd.DataFrame, spacing: float) -> np.ndarray:
    """Which rows ``(_id, _s, _x, _y, _cx, _cy, own)`` are sure to be kept: the greedy choice in one tile and the cells around it.

    A point from outside the tile that no kept point covers is open, since its own betters may be out of sight; so is a point with an open
    better one within ``spacing``. A cell with many open points counts as open altogether.
    """
    order = pdf.sort_values(["_s", "_id"], ascending=[False, True]).index.to_numpy()
    xs, ys, cx, cy, own = (pdf[c].to_numpy() for c in ("_x", "_y", "_cx", "_cy", "own"))
    kept, opened = {}, {}
    sure = np.zeros(len(pdf), dtype=bool)
    for k in order:
        x, y, a, b = xs[k], ys[k], int(cx[k]), int(cy[k])
        cells = [(i, j) for i in (a - 1, a, a + 1) for j in (b - 1, b, b + 1)]
        if any(abs(u - x) <= spacing and abs(v - y) <= spacing for c in cells for u, v in kept.get(c, ())):
            continue
        near = (opened[c] for c in cells if c in opened)
        if not own[k] or any(len(o) > 64 or any(abs(u - x) <= spacing and abs(v - y) <= spacing for u, v in o) for o in near):
            opened.setdefault((a, b), []).append((x, y))
        else:
            kept.setdefault((a, b), []).append((x, y))
            sure[k] = True
    return sure


def kept_in_tiles(left: DataFrame, spacing: float, keys: Sequence[str]) -> DataFrame | None:
    """Points of ``left`` that are sure to be kept by what a tile and its surroundings tell; chains inside a tile take no rounds.

    The tiles have one width, that with the most points in tiles of at most ``TILE_POINTS`` rows with their surroundings. Fuller
    tiles are left out.
    """
    k = list(keys)
    cells = left.groupBy(*k, "_cx", "_cy").agg(F.count(F.lit(1)).alias("n"))
    widths = cells.withColumn("_w", F.explode(F.array(*[F.lit(8**i).cast("long") for i in range(TILE_LEVELS + 1)])))

    def touched(df: DataFrame, width: Column) -> DataFrame:
        at = lambda c, d: F.floor((F.col(c) + d) / width).cast("long")
        spread = lambda c: F.explode(F.array_distinct(F.array(*[at(c, d) for d in (-1, 0, 1)])))
        both = df.withColumn("_tx", spread("_cx")).withColumn("_ty", spread("_cy"))
        return both.withColumn("own", (F.col("_tx") == at("_cx", 0)) & (F.col("_ty") == at("_cy", 0)))

    tile = [*k, "_tx", "_ty"]
    full = touched(widths, F.col("_w")).groupBy("_w", *tile).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("own"), F.col("n"))).alias("mine"))
    full = durable(full.where((F.col("n") <= TILE_POINTS) & (F.col("mine") > 0)))
    best = full.groupBy("_w").agg(F.sum("mine").alias("mine")).orderBy(F.col("mine").desc(), F.col("_w").desc()).first()
    if best is None:
        return None
    rows = touched(left, F.lit(best["_w"])).join(full.where(F.col("_w") == best["_w"]).select(*tile), tile, "left_semi")
    columns = left.columns

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        return pdf.loc[greedy_in_tile(pdf, spacing), columns]

    return rows.groupBy(*tile).applyInPandas(choose, left.schema)


def spaced_peaks(
    points: DataFrame, idc: str, score: str, spacing: float, x: str = "x", y: str = "y", n: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Greedy selection by score (ties: smaller id) with no two kept points within ``spacing`` on both axes.

    Equal to the sequential greedy choice. A round keeps cell winners that beat the winners of all
    neighbouring cells and drops what they cover; a crowded cell sends one row to its neighbours. Chains of points that depend on each
    other outlast some rounds; from then on every other round decides whole tiles (:func:`kept_in_tiles`).
    Points without an id, a key, a score or a place (null, NaN or infinite) are never kept and cover nothing.
    """
    if not spacing > 0:
        raise ValueError("spacing must be positive")
    k = list(keys)
    points = placeable(points, idc, score, x, y, k)
    at = lambda c: F.floor(F.col(c) / spacing)
    base = points.select(*k, F.col(idc).alias("_id"), F.col(score).alias("_s"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    left = durable(base.withColumns({"_cx": at("_x"), "_cy": at("_y")}))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    rank = F.struct(F.col("_s"), -F.col("_id"))
    shift = {"_cx": F.col("_cx") + F.col("_o.a"), "_cy": F.col("_cy") + F.col("_o.b")}
    cell = [*k, "_cx", "_cy"]
    kept, turn = None, 0
    while True:  # a round of winners keeps at least one point of every key
        turn += 1
        best = left.groupBy(*cell).agg(F.max_by(F.struct("_id", "_s", "_x", "_y"), rank).alias("p"), F.max(rank).alias("r"))
        around = best.select(*cell, "r", F.explode(near).alias("_o")).withColumns(shift).groupBy(*cell).agg(F.max("r").alias("top"))
        sure = kept_in_tiles(left, spacing, k) if turn > WINNER_ROUNDS and (turn - WINNER_ROUNDS) % 2 else None
        win = durable((best.join(around, cell).where(F.col("r") == F.col("top")).select(*cell, "p.*") if sure is None
                       else sure.select(*cell, "_id", "_s", "_x", "_y")))
        kept = win if kept is None else kept.unionByName(win)
        cover = win.select(*cell, F.col("_x").alias("_wx"), F.col("_y").alias("_wy"), F.explode(near).alias("_o")).withColumns(shift).drop("_o")
        hit = (F.abs(F.col("_x") - F.col("_wx")) <= spacing) & (F.abs(F.col("_y") - F.col("_wy")) <= spacing)
        covered = left.join(cover, cell).where(hit).select(*k, "_id").distinct()
        left = durable(left.join(covered, [*k, "_id"], "left_anti"))
        if left.limit(1).count() == 0:
            out = kept.select(*k, F.col("_id").alias(idc), F.col("_s").alias(score), F.col("_x").alias(x), F.col("_y").alias(y))
            if n is None or not k:
                return out if n is None else out.orderBy(F.col(score).desc(), idc).limit(n)
            place = Window.partitionBy(*k).orderBy(F.col(score).desc(), idc)
            return out.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= n).drop("_k")


def peaks_with_relaxed_spacing(
    points: DataFrame, idc: str, score: str, n: int, spacing: float = 100.0, factor: float = 0.9, x: str = "x", y: str = "y",
    keys: Sequence[str] = (),
) -> DataFrame:
    """The spacing, one for all keys, shrinks (whole numbers) until every key has ``n`` points; below 1 it is an error."""
    k = list(keys)
    every = placeable(points, idc, score, x, y, k).select(*k).distinct() if k else None
    while True:
        got = durable(spaced_peaks(points, idc, score, spacing, x, y, n, k))
        if every is None:
            done = got.count() >= n
        else:
            full = got.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
            done = every.join(full, k, "left_anti").isEmpty()
        if done:
            return got
        spacing = int(factor * spacing)
        if spacing < 1:
            raise ValueError(f"fewer than {n} points at any spacing")

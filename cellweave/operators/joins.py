"""Key joins on cell, spot and pixel tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.ordered import cumulative_counts, value_counts

CHUNK, SALTS = 256, 64  # chunks of a column's values; parts of a product


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of per-cell tables."""
    return left.join(right, list(keys), "left")


def merge_long(
    frames: Mapping[str, DataFrame], keys: Sequence[str], values: Sequence[str], fill: float | None = 0.0
) -> DataFrame:
    """Full outer merge of one table per name as ``<value>_<name>`` columns.

    The tables are stacked and grouped once, so n tables cost one shuffle instead of n joins; rows of
    equal key are combined map-side.
    """
    names = list(frames)
    if len(set(names)) != len(names):
        raise ValueError("names must be unique")
    stacked = reduce(
        DataFrame.unionByName,
        [f.select(*keys, *[F.col(v).cast("double") for v in values], F.lit(n).alias("_name")) for n, f in frames.items()],
    )
    return pivot_known(stacked, keys, "_name", names, {v: F.sum for v in values}, fill)


def pivot_known(
    long: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], values: Mapping[str, object],
    fill: float | None = None,
) -> DataFrame:
    """Pivot with a given list of names: no extra job to find them; columns ``<value>_<name>``."""
    aggs = []
    for n in names:
        for v, how in values.items():
            a = how(F.when(F.col(name) == n, F.col(v)))
            aggs.append((F.coalesce(a, F.lit(fill)) if fill is not None else a).alias(f"{v}_{n}"))
    return long.groupBy(*keys).agg(*aggs)


def inner_suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes=("_x", "_y")) -> DataFrame:
    """Inner join; columns present on both sides get the suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, list(keys), "inner")


def shape_with_channels(
    shapes: DataFrame, pixels: DataFrame, keys: Sequence[str], channel: str, channels: Sequence[str],
    stats: Mapping[str, Column],
) -> DataFrame:
    """Shape table plus statistics per channel; the long pixels are grouped once, not once per channel."""
    if len(set(channels)) != len(channels):
        raise ValueError("channel names must be unique")
    long = pixels.groupBy(*keys, channel).agg(*[c.alias(n) for n, c in stats.items()])
    wide = pivot_known(long, keys, channel, channels, {n: F.max for n in stats})
    return shapes.join(wide, list(keys), "left")


def strict_lookup(
    df: DataFrame, lookup: DataFrame, key: str, value: str, out: str | None = None, missing_ok: bool = False
) -> DataFrame:
    """Copy ``value``; an absent key or a key mapped twice stops the job."""
    out = out or value
    table = lookup.groupBy(key).agg(F.first(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    joined = df.join(table, key, "left")
    key_text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key mapped twice: "), key_text)))
    if not missing_ok:
        checked = checked.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("key not found: "), key_text)))
    return joined.withColumn(out, checked.otherwise(F.col("_v"))).drop("_v", "_n")


def unmatched(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other side lacks."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def gather(points: DataFrame, pixels: DataFrame, keys: Sequence[str], label: str = "label", out: str = "mask_id") -> DataFrame:
    """Label of the pixel under each point, 0 where the mask has none."""
    fg = pixels.where(F.col(label) > 0).select(*keys, F.col(label).alias(out))
    return points.join(fg, list(keys), "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def gather_tiles(
    points: DataFrame, tiles: DataFrame, tile: int, x: str = "X", y: str = "Y", pixels: str = "pixels",
    keys: Sequence[str] = (), out: str = "mask_id",
) -> DataFrame:
    """J7 on tile tables ``(tile_row, tile_col, w, pixels)``: one join row per point, then an array index."""
    located = points.withColumns(
        {"tile_row": F.floor(F.col(y) / tile), "tile_col": F.floor(F.col(x) / tile)}
    )
    joined = located.join(tiles.select(*keys, "tile_row", "tile_col", "w", pixels),
                          [*keys, "tile_row", "tile_col"], "left")
    pos = (F.pmod(F.col(y), F.lit(tile)) * F.col("w") + F.pmod(F.col(x), F.lit(tile))).cast("int")
    inside = F.pmod(F.col(x), F.lit(tile)) < F.col("w")
    value = F.when(inside, F.get(F.col(pixels), pos))
    return joined.withColumn(out, F.coalesce(value, F.lit(0))).drop("tile_row", "tile_col", "w", pixels)


def recolour(
    pixels: DataFrame, values: DataFrame, value: str, label: str = "label", keys: Sequence[str] = (),
    missing: float = 0, background: float = 0, out: str = "value",
) -> DataFrame:
    """Label to value. Background, often most of the image, never enters the join."""
    table = values.select(*keys, label, F.col(value).alias(out))
    fg = pixels.where(F.col(label) > 0).join(table, [*keys, label], "left")
    fg = fg.withColumn(out, F.coalesce(F.col(out), F.lit(missing)))
    bg = pixels.where(F.coalesce(F.col(label) <= 0, F.lit(True))).withColumn(out, F.lit(background))
    return fg.unionByName(bg.select(*fg.columns))


def counts_as_colours(counts: DataFrame, column: str) -> DataFrame:
    """Counts are rounded half to even and shifted by one before they colour a mask."""
    return counts.withColumn(column, (F.bround(column, 0) + 1).cast("int"))


def type_by_pattern(
    df: DataFrame, conditions: DataFrame, markers: Sequence[str], cell_type: str = "cell_type", default: str = "Others"
) -> DataFrame:
    """Boolean pattern to cell type.

    The condition table is reduced to one row per pattern, so it has at most 3^k rows for k markers;
    up to ten markers it is broadcast, beyond that an ordinary join is planned.
    """
    table = conditions.groupBy(*markers).agg(F.min(cell_type).alias(cell_type))
    small = F.broadcast(table) if len(markers) <= 10 else table
    return df.join(small, list(markers), "left").withColumn(cell_type, F.coalesce(cell_type, F.lit(default)))


def rank_pairs(
    df: DataFrame, sample: str, value: str, first: object, second: object, block: int = 64
) -> DataFrame:
    """Sorted values of two samples paired by rank, as runs ``(v1, v2, pairs)``.

    Equal values form one run of ranks, so a value shared by a third of the rows stays one row. Runs are
    cut at blocks of ``block`` ranks; a block joins at most ``block`` runs of either side.
    """
    counts = value_counts(df.where(F.col(sample).isin(first, second)), [sample], value)
    run = cumulative_counts(counts, [sample], value)
    lo, hi = F.col("upto") - F.col("n"), F.col("upto") - 1
    big = block * 4096
    spans = run.select(sample, value, lo.alias("a"), hi.alias("b"))
    coarse = spans.withColumn("c", F.explode(F.sequence(F.floor(F.col("a") / big), F.floor(F.col("b") / big))))
    coarse = coarse.withColumns({"a": F.greatest("a", F.col("c") * big), "b": F.least("b", (F.col("c") + 1) * big - 1)})
    fine = coarse.withColumn("blk", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))))
    fine = fine.withColumns(
        {"a": F.greatest("a", F.col("blk") * block), "b": F.least("b", (F.col("blk") + 1) * block - 1)}
    ).drop("c")
    s1 = fine.where(F.col(sample) == first).select("blk", F.col(value).alias("v1"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    s2 = fine.where(F.col(sample) == second).select("blk", F.col(value).alias("v2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    pairs = F.least("b1", "b2") - F.greatest("a1", "a2") + 1
    met = s1.join(s2, "blk").where((F.col("a1") <= F.col("b2")) & (F.col("a2") <= F.col("b1")))
    return met.groupBy("v1", "v2").agg(F.sum(pairs).alias("pairs"))


def mask_difference(
    first: DataFrame, second: DataFrame, keys: Sequence[str] = ("y", "x"), label: str = "label",
    block: int | None = None, y: str = "y", x: str = "x",
) -> DataFrame:
    """Pixels where two masks differ, labelled by the mask with more foreground.

    The winner is chosen per block of ``block`` pixels, or once for the whole image; the second mask
    wins ties. Foreground counts are a separate small aggregate, so no block is windowed in one task.
    """
    a = first.where(F.col(label) > 0).select(*keys, F.col(label).alias("_a"))
    b = second.where(F.col(label) > 0).select(*keys, F.col(label).alias("_b"))
    both = a.join(b, list(keys), "full")
    if block:
        both = both.withColumns({"_r": F.floor(F.col(y) / block), "_c": F.floor(F.col(x) / block)})
        tile = ["_r", "_c"]
    else:
        both, tile = both.withColumn("_r", F.lit(0)), ["_r"]
    extra = [k for k in keys if k not in (y, x)]
    tile = extra + tile
    win = both.groupBy(*tile).agg((F.count("_a") > F.count("_b")).alias("_first"))
    joined = both.join(F.broadcast(win) if not block and not extra else win, tile)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    differs = zero("_a") != zero("_b")
    kept = F.when(F.col("_first"), zero("_a")).otherwise(zero("_b"))
    return joined.where(differs & (kept > 0)).select(*keys, kept.alias(label))


def missing_combinations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Combinations of the distinct values of ``cols`` that no row has. A null is a value like any other.

    The distinct values of a column are hashed into ``CHUNK`` chunks, each a row with an array. What has been combined so far is dealt over ``SALTS`` parts, every
    part meets every chunk of the next column and unfolds it, so the product is made by many tasks. The output is
    the product less the rows, so it has the size that its caller asks for.
    """
    full = None
    for c in cols:
        values = df.select(c).distinct().withColumn("_k", F.pmod(F.xxhash64(F.col(c)), F.lit(CHUNK)))
        if full is None:
            full = values.withColumn("_salt", F.pmod(F.xxhash64(F.col(c), F.lit(1)), F.lit(SALTS))).drop("_k")
            continue
        chunks = values.groupBy("_k").agg(F.collect_list(F.struct(F.col(c))).alias("_v"))
        spread = chunks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.col("_salt").cast("long"), "_v")
        full = full.join(spread, "_salt").select(*full.columns, F.explode("_v").alias("_e")).withColumn(c, F.col("_e")[c]).drop("_e")
        full = full.withColumn("_salt", F.pmod(F.xxhash64(*[k for k in full.columns if k != "_salt"]), F.lit(SALTS)))
    rows = df.select(*cols).distinct().withColumnsRenamed({c: f"_r_{c}" for c in cols})
    on = F.lit(True)
    for c in cols:
        on &= F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return full.drop("_salt").join(rows, on, "left_anti")

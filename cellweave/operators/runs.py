"""Masks as runs: ``(keys, y, x0, x1, label)``, the pixels ``x0`` to ``x1`` of a row that carry one label.

Runs are cut at multiples of ``block`` columns, so a run lies in one block and joins are equi joins on ``(keys, y, block)``. What is moved and
compared is in proportion to the runs, whatever the size of the objects. Background (label 0 or less, or null) has no runs.
Runs of one mask never overlap; where a pixel table names a pixel twice, the largest label counts. Rows with a null place are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
FINE = 8


def _block(column: str, block: int):
    return F.floor(F.col(column) / block)


def in_blocks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one block on one task, moved once for all that is done with blocks, and ``FINE`` times the session's partitions, so that what a task sorts stays small."""
    return df.repartition(FINE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "y", "_b")


def pixels_to_runs(pixels: DataFrame, keys: Sequence[str] = (), label: str = "label", block: int = BLOCK, y: str = "y", x: str = "x") -> DataFrame:
    """Runs of a pixel table; at most ``block`` pixels of a row meet in a group."""
    fg = pixels.where((F.col(label) > 0) & F.col(y).isNotNull() & F.col(x).isNotNull())
    placed = fg.select(*keys, F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x"), F.col(label).alias("label")).withColumn("_b", _block("x", block))
    marked = in_blocks(placed, keys).groupBy(*keys, "y", "_b", "x").agg(F.max("label").alias("label"))
    row = Window.partitionBy(*keys, "y", "_b").orderBy("x")
    fresh = (F.lag("x").over(row) == F.col("x") - 1) & (F.lag("label").over(row) == F.col("label"))
    marked = marked.withColumn("_new", F.when(fresh, 0).otherwise(1))
    part = marked.withColumn("_k", F.sum("_new").over(row))
    runs = part.groupBy(*keys, "y", "_b", "_k").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("label").alias("label"))
    return runs.select(*keys, "y", "x0", "x1", "label")


def tiles_to_runs(tiles: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of a tile table, cut at tile borders; every tile on its own, nothing is moved."""
    kinds = dict(tiles.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.to_dict("records"):
                img = np.asarray(t["pixels"], dtype=float).reshape(int(t["h"]), int(t["w"]))
                edge = np.ones((img.shape[0], img.shape[1] + 1), dtype=bool)
                edge[:, 1:-1] = img[:, 1:] != img[:, :-1]
                row, begin = np.nonzero(edge[:, :-1])
                end = np.nonzero(edge[:, 1:])[1]
                label = img[row, begin]
                fg = label > 0
                if not fg.any():
                    continue
                yield pd.DataFrame({**{k: [t[k]] * int(fg.sum()) for k in keys}, "y": t["tile_row"] * size + row[fg], "x0": t["tile_col"] * size + begin[fg],
                                    "x1": t["tile_col"] * size + end[fg], "label": label[fg].astype(np.int64)})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "y long, x0 long, x1 long, label long"])
    return tiles.select(*keys, "tile_row", "tile_col", "h", "w", "pixels").mapInPandas(run, schema)


def cut_runs(runs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same mask with its runs cut at multiples of ``block`` columns."""
    pieces = runs.withColumn("_b", F.explode(F.sequence(_block("x0", block), _block("x1", block))))
    return pieces.withColumns({"x0": F.greatest("x0", F.col("_b") * block), "x1": F.least("x1", F.col("_b") * block + (block - 1))}).drop("_b")


def runs_to_pixels(runs: DataFrame, keys: Sequence[str] = (), value: str = "label") -> DataFrame:
    return runs.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), value)


def gather_runs(
    points: DataFrame, runs: DataFrame, keys: Sequence[str] = (), x: str = "x", y: str = "y", block: int = BLOCK, out: str = "mask_id"
) -> DataFrame:
    """Label of the run under each point, 0 where there is none. ``runs`` need not be cut."""
    own = [f"_m_{k}" for k in keys]
    cut = cut_runs(runs, block).select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("y").alias("_my"), _block("x0", block).alias("_mb"),
                                       F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("label").alias("_label"))
    placed = points.withColumn("_b", _block(x, block))
    on = (F.col(y) == F.col("_my")) & (F.col("_b") == F.col("_mb")) & F.col(x).between(F.col("_x0"), F.col("_x1"))
    for k, o in zip(keys, own, strict=True):
        on &= F.col(k) == F.col(o)
    met = placed.join(cut, on, "left").withColumn(out, F.coalesce("_label", F.lit(0)))
    return met.drop("_b", "_my", "_mb", "_x0", "_x1", "_label", *own)


def recolour_runs(
    runs: DataFrame, values: DataFrame, value: str, label: str = "label", keys: Sequence[str] = (), missing: float = 0, out: str = "value"
) -> DataFrame:
    """The value of the label on every run; a label without one takes ``missing``. The background stays without runs."""
    table = values.select(*keys, label, F.col(value).alias(out))
    return runs.join(table, [*keys, label], "left").withColumn(out, F.coalesce(F.col(out), F.lit(missing)))


def merged_runs(first: DataFrame, second: DataFrame, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``(keys, y, x0, x1, a, b)``: stretches of a row on which both masks are constant and one has a label, 0 for none.

    A run is an event where it begins and one behind its end; running sums over the events of a row and block give the labels.
    """
    def events(runs, one, other):
        cut = cut_runs(runs, block).withColumn("_b", _block("x0", block))
        ends = F.array(F.struct(F.col("x0").alias("x"), F.col("label").alias("d")), F.struct((F.col("x1") + 1).alias("x"), (-F.col("label")).alias("d")))
        return cut.select(*keys, "y", "_b", F.inline(ends)).select(*keys, "y", "_b", "x", F.col("d").alias(one), F.lit(0).cast("long").alias(other))

    both = events(first, "_da", "_db").unionByName(events(second, "_db", "_da"))
    at = in_blocks(both, keys).groupBy(*keys, "y", "_b", "x").agg(F.sum("_da").alias("_da"), F.sum("_db").alias("_db"))
    row = Window.partitionBy(*keys, "y", "_b").orderBy("x")
    told = at.select(*keys, "y", F.col("x").alias("x0"), (F.lead("x").over(row) - 1).alias("x1"), F.sum("_da").over(row).alias("a"), F.sum("_db").over(row).alias("b"))
    return told.where("a <> 0 or b <> 0")


def difference_runs(first: DataFrame, second: DataFrame, keys: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Where two masks differ, labelled by the mask with more foreground in the square of ``block`` pixels, or in the whole image of
    the keys; the second mask wins ties. Equal to :func:`joins.mask_difference`, as runs."""
    both = merged_runs(first, second, keys, block or BLOCK)
    if block:
        both = both.withColumns({"_r": _block("y", block), "_c": _block("x0", block)})
    else:
        both = both.withColumns({"_r": F.lit(0), "_c": F.lit(0)})
    size = F.col("x1") - F.col("x0") + 1
    square = [*keys, "_r", "_c"]
    win = both.groupBy(*square).agg((F.sum(F.when(F.col("a") > 0, size).otherwise(0)) > F.sum(F.when(F.col("b") > 0, size).otherwise(0))).alias("_first"))
    kept = F.when(F.col("_first"), F.col("a")).otherwise(F.col("b"))
    differ = both.where("a <> b").join(win, square)
    return differ.where(kept > 0).select(*keys, "y", "x0", "x1", kept.alias("label"))


def agreement_runs(first: DataFrame, second: DataFrame, area: int, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """The figures of :func:`stats.mask_agreement` for images of ``area`` pixels each. A group without any run has no row, without ``by`` one of nulls and zeros."""
    both = merged_runs(first, second, by, block).withColumn("_n", F.col("x1") - F.col("x0") + 1)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    a, b, gap = F.col("a") > 0, F.col("b") > 0, F.abs(F.col("a") - F.col("b"))
    return both.groupBy(*by).agg(
        (total(a & b) / F.sum("_n")).alias("iou"), (total(a) / area).alias("fraction_a"), (total(b) / area).alias("fraction_b"),
        total(gap > 0).alias("differ"), total(gap >= 2).alias("differ_2"), total(gap >= 3).alias("differ_3"))

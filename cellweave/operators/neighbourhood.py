"""Neighbourhood composition, interaction and class distances.

All of them work on weighted locations: cells of one class at one position count once with a weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.discs import class_sums_within
from cellweave.operators.spatial import locations, nearest_neighbours


def neighbour_counts(
    points: DataFrame, radius: float, idc: str, cls: str, x: str = "x", y: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """A27, long form without zeros: ``(by, id, class, n)`` neighbours per class within ``radius``."""
    asked = locations(points, x, y, by).drop("n")
    told = locations(points, x, y, [*by, cls])
    per = class_sums_within(asked, told, radius, cls, by)
    packed = per.groupBy(*by, "x", "y").agg(F.collect_list(F.struct("class", "n")).alias("near"))  # one entry per class
    own = points.select(*by, F.col(idc), F.col(cls).alias("_own"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = own.join(packed, [*by, "x", "y"]).select(*by, idc, "_own", F.inline("near"))
    less = F.when(F.col("class") == F.col("_own"), F.col("n") - 1).otherwise(F.col("n"))
    return rows.select(*by, idc, "class", less.alias("n")).where(F.col("n") > 0)


def composition(
    points: DataFrame, radius: float, idc: str, cls: str, classes: Sequence[object], x: str = "x", y: str = "y",
    by: Sequence[str] = (),
) -> DataFrame:
    """A27, wide form: counts ``n_<class>`` and fractions ``f_<class>``; a cell without neighbours keeps
    zero counts and null fractions."""
    long = neighbour_counts(points, radius, idc, cls, x, y, by)
    wide = long.groupBy(*by, idc).agg(*[F.sum(F.when(F.col("class") == c, F.col("n"))).alias(f"n_{c}") for c in classes])
    out = points.select(*by, idc, cls).join(wide, [*by, idc], "left").fillna(0, [f"n_{c}" for c in classes])
    total = sum((F.col(f"n_{c}") for c in classes[1:]), F.col(f"n_{classes[0]}"))
    return out.withColumns({f"f_{c}": F.when(total > 0, F.col(f"n_{c}") / total) for c in classes})


def mean_composition(comp: DataFrame, cls: str, classes: Sequence[object], by: Sequence[str] = ()) -> DataFrame:
    """Mean neighbour counts per class, cells without neighbours included."""
    return comp.groupBy(*by, cls).agg(*[F.avg(f"n_{c}").alias(f"n_{c}") for c in classes])


def interaction_counts(
    points: DataFrame, radius: float, cls: str, x: str = "x", y: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """``(by, class_src, class_dst, n)`` directed neighbour pairs, self excluded."""
    locs = locations(points, x, y, [*by, cls])
    near = class_sums_within(locations(points, x, y, by), locs, radius, cls, by).withColumnsRenamed({"class": "class_dst", "n": "t_n"})
    met = locs.withColumnRenamed(cls, "class_src").join(near, [*by, "x", "y"])
    pairs = F.col("n") * (F.col("t_n") - F.when(F.col("class_src") == F.col("class_dst"), 1).otherwise(0))
    out = met.groupBy(*by, "class_src", "class_dst").agg(F.sum(pairs).alias("n"))
    return out.where(F.col("n") > 0)


def interaction_matrix(points: DataFrame, radius: float, cls: str, x="x", y="y", by: Sequence[str] = ()) -> DataFrame:
    """The same with ``fraction`` of each source class (the window runs over class pairs only)."""
    n = interaction_counts(points, radius, cls, x, y, by)
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "class_src")))


def class_distances(
    points: DataFrame, idc: str, cls: str, classes: Sequence[object], k: int = 1, x: str = "x", y: str = "y",
    by: Sequence[str] = (),
) -> DataFrame:
    """A30 per cell: mean distance to the ``k`` nearest cells of each class ``(by, id, class, to_class, dist)``;
    null where a class is absent. ``by`` keeps slides apart."""
    names = F.array(*[F.lit(c) for c in classes])
    src = points.select(*by, F.col(idc).alias("_s"), x, y, F.col(cls).alias("_c")).withColumn("to_class", F.explode(names))
    dst = points.where(F.col(cls).isin(*classes)).select(*by, F.col(idc).alias("_d"), x, y, F.col(cls).alias("to_class"))
    near = nearest_neighbours(src, dst, k, "_s", "_d", x, y, exclude_self=True, by=[*by, "to_class"])
    mean = near.groupBy(*by, F.col("src").alias("_s"), "to_class").agg(F.avg("dist").alias("dist"))
    return src.select(*by, "_s", "_c", "to_class").join(mean, [*by, "_s", "to_class"], "left").select(
        *by, F.col("_s").alias(idc), F.col("_c").alias(cls), "to_class", "dist")


def mean_class_distances(per_cell: DataFrame, cls: str) -> DataFrame:
    """Mean over the cells of each class."""
    return per_cell.groupBy(cls, "to_class").agg(F.avg("dist").alias("dist"))

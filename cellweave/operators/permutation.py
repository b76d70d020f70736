"""Label permutations that are computed instead of stored, and the enrichment built on them.

The cells of a slide have ranks from 0 on, and class borders cut the ranks into classes of the right sizes. A permutation of the
ranks is a keyed network of ``ROUNDS`` rounds over twice ``b`` bits, walked until it lands below the number of cells; it maps ranks one to one, so
every permutation keeps the class sizes. So the label of any cell in any permutation is a function of its rank: the task that
holds a pair of places computes the labels it needs, no table of permutations x cells exists, and a permutation costs no pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.discs import ASKED, around, by_group, disc_sums
from cellweave.operators.neighbourhood import interaction_counts
from cellweave.operators.ordered import attach_small
from cellweave.operators.spatial import location_pairs, locations
from cellweave.session import durable

ROUNDS = 4
CROWD = 4096  # cells at one place, beyond which their labels are counted beforehand, in parts of as many
PAIRS = 20_000  # pairs of places handled at once
TABLE = 8_000_000  # numbers of the tables of sums held at once
PRIME, TWO31 = (1 << 31) - 1, 1 << 31


def half_bits(n: int) -> int:
    """Bits of one half: the least with ``4 ** bits >= n``, 1 at least."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def round_key(seed: int, perm: int, k: int) -> int:
    return (seed * 7919 + perm * 104729 + k * 1299709 + 12345) % PRIME


def scrambled(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    t = (half * 1103515245 + key) % TWO31
    t ^= t >> 15
    return (((t * 48271 + key) % PRIME) >> 8) & ((1 << bits) - 1)


def permuted(ranks: np.ndarray, n: int, seed: int, perm: int) -> np.ndarray:
    """Where permutation ``perm`` of 0 to ``n - 1`` puts each of ``ranks``."""
    bits = half_bits(n)
    out, todo = ranks.astype(np.int64), np.arange(len(ranks))
    while len(todo):
        v = out[todo]
        left, right = v >> bits, v & ((1 << bits) - 1)
        for k in range(ROUNDS):
            left, right = right, left ^ scrambled(right, round_key(seed, perm, k), bits)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= n]
    return out


def ranked_locations(points: DataFrame, cls: str, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """``(by, x, y, n, r)``: places in order, with the rank ``r`` of the first of their ``n`` cells on the slide.

    Rows are dealt by ranges of the order, summed within each range, and a table of range sums supplies what lies before.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*by, "x", "y"]
    dealt = locations(points.where(F.col(cls).isNotNull()), x, y, by).repartitionByRange(parts, *order)
    dealt = durable(dealt.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy("x", "y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy("_part", *by).agg(F.sum("n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_part", *by, F.coalesce(before, F.lit(0)).alias("_start"))
    ranked = dealt.withColumn("_upto", F.sum("n").over(inside)).join(starts, ["_part", *by])
    return ranked.select(*by, "x", "y", "n", (F.col("_start") + F.col("_upto") - F.col("n")).alias("r"))


def class_borders(points: DataFrame, cls: str, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """``(by, classes, tops)``: classes in order and the first rank behind each."""
    sizes = locations(points.where(F.col(cls).isNotNull()), x, y, [*by, cls]).groupBy(*by, cls).agg(F.sum("n").alias("n"))
    packed = F.array_sort(F.collect_list(F.struct(F.col(cls).alias("c"), "n")))  # one entry for each class
    table = sizes.groupBy(*by).agg(packed.alias("_t"))
    upto = F.transform("_t", lambda e, i: F.aggregate(F.slice("_t", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, s: a + s["n"]))
    return table.select(*by, F.col("_t.c").alias("classes"), upto.alias("tops"))


def class_counts(first: np.ndarray, n: np.ndarray, tops: np.ndarray, seed: int, perm: int) -> np.ndarray:
    """Cells of each class among the ranks ``first`` to ``first + n - 1``, row by row."""
    row = np.repeat(np.arange(len(n)), n)
    ranks = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[row]
    label = np.searchsorted(tops, permuted(ranks, int(tops[-1]), seed, perm), side="right")
    return np.bincount(row * len(tops) + label, minlength=len(n) * len(tops)).reshape(len(n), len(tops))


def crowds(places: DataFrame, by: Sequence[str], perms: int, seed: int) -> DataFrame:
    """``(by, r, told)``: for places of more than ``CROWD`` cells the class counts of every permutation, summed over parts."""
    parts = places.where(F.col("n") > CROWD).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CROWD).cast("long"))))
    parts = parts.select(*by, "r", "tops", (F.col("r") + F.col("at")).alias("first"), F.least(F.lit(CROWD), F.col("n") - F.col("at")).alias("m"))
    parts = parts.repartition(*by, "r", "first")  # the parts of one place go to many tasks

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            told = []
            for first, m, tops in zip(pdf["first"], pdf["m"], pdf["tops"], strict=True):
                each = [class_counts(np.array([first]), np.array([m]), np.asarray(tops), seed, p)[0] for p in range(1, perms + 1)]
                told.append(np.concatenate(each))
            yield pdf[[*by, "r"]].assign(told=told)

    kinds = dict(places.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "r long, told array<long>"])
    flat = parts.mapInPandas(count, schema).select(*by, "r", F.posexplode("told").alias("k", "v"))
    summed = flat.groupBy(*by, "r", "k").agg(F.sum("v").alias("v"))
    return summed.groupBy(*by, "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("told"))


def permuted_counts(points: DataFrame, radius: float, cls: str, perms: int, seed: int = 0, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """``(by, perm, class_src, class_dst, n)``: directed neighbour pairs in each label permutation, where there are any.

    A pair of places carries the ranks of its cells, or their counts where many share a place. The labels of all permutations are made in one pass
    over the pairs; a task adds up classes x classes numbers for each permutation and slide and sends these alone. Around crowded cells no pairs are
    made: discs are summed by strips (``discs.py``).
    """
    by = list(by)
    borders = durable(class_borders(points, cls, x, y, by))
    places = durable(attach_small(ranked_locations(points, cls, x, y, by), borders.drop("classes"), by))
    told = durable(crowds(places, by, perms, seed))
    entries = F.when(F.col("n") > 1, F.size("tops")).otherwise(1).alias("entries")
    places = places.select("*", entries).drop("tops").join(told, [*by, "r"], "left")
    sparse, crowd, near, keys = around(places, places, radius, by, F.col("entries"))
    pairs = attach_small(location_pairs(sparse, places, radius, by), borders.drop("classes"), by)
    kinds = dict(places.dtypes)
    columns = [*by, "r", "n", "told", "t_r", "t_n", "t_told", "dist", "tops"]

    def labels(part: pd.DataFrame, r: str, n: str, told: str, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its place, and for each permutation and place its counts."""
        rank, place = np.unique(part[r].to_numpy(), return_inverse=True)
        some = np.full(len(rank), -1)
        some[place] = np.arange(len(part))
        size, known = part[n].to_numpy()[some], part[told].to_numpy()[some]
        crowd = size > CROWD
        out = np.zeros((perms, len(rank), len(tops)))
        for p in range(perms):
            out[p, ~crowd] = class_counts(rank[~crowd], size[~crowd], tops, seed, p + 1)
        for k in np.flatnonzero(crowd):
            out[:, k] = np.asarray(known[k], dtype=float).reshape(perms, len(tops))
        return place, out

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for slide, m in sums.items():
                p, a, b = np.nonzero(m)
                if len(p):
                    yield pd.DataFrame({**{c: [v] * len(p) for c, v in zip(by, slide, strict=True)}, "perm": p + 1, "a": a, "b": b, "n": m[p, a, b].astype(np.int64)})
            sums.clear()

        for pdf in frames:
            for slide, whole in pdf.groupby(by, sort=False) if by else [((), pdf)]:
                tops = np.asarray(whole["tops"].iloc[0])
                m = sums.setdefault(tuple(slide), np.zeros((perms, len(tops), len(tops))))
                for at in range(0, len(whole), PAIRS):
                    part = whole.iloc[at:at + PAIRS]
                    i, a = labels(part, "r", "n", "told", tops)
                    j, b = labels(part, "t_r", "t_n", "t_told", tops)
                    own = part["dist"].to_numpy() == 0
                    for p in range(perms):
                        m[p] += a[p][i].T @ b[p][j] - np.diag(a[p][i[own]].sum(axis=0))
            if sum(m.size for m in sums.values()) > 4_000_000:
                yield from flush()
        yield from flush()

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "perm int, a int, b int, n long"])
    def in_crowd(a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        tops = np.asarray(a["tops"].iloc[0])
        k = len(tops)
        one = t["n"].to_numpy() == 1
        rows = np.r_[np.flatnonzero(one), np.repeat(np.flatnonzero(~one), k)]  # a place of several cells has an entry for each class
        single, piles = t[one]["r"].to_numpy(), t[~one]
        own = np.isin(a["r"].to_numpy(), t["r"].to_numpy())
        x, y = t["x"].to_numpy()[rows], t["y"].to_numpy()[rows]
        m = np.zeros((perms, k, k), dtype=np.int64)
        most = max(1, TABLE // (ASKED * k))
        for begin in range(0, perms, most):
            some = range(begin, min(begin + most, perms))

            def told_entries(order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for p in some:
                    label = np.searchsorted(tops, permuted(single, int(tops[-1]), seed, p + 1), side="right")
                    label = np.r_[label, np.tile(np.arange(k), len(piles))]
                    weight = np.r_[np.ones(len(single), dtype=np.int64), cell_counts(piles, tops, p).ravel()]
                    yield label[order], weight[order]

            for part, sums in disc_sums(a["x"].to_numpy(), a["y"].to_numpy(), x, y, told_entries, k, radius):
                for p, n in zip(some, sums, strict=True):
                    mine = cell_counts(a.iloc[part], tops, p)
                    m[p] += mine.T @ n - np.diag(mine[own[part]].sum(axis=0))
        p, i, j = np.nonzero(m)
        return pd.DataFrame({**{c: [a[c].iloc[0]] * len(p) for c in by}, "perm": p + 1, "a": i, "b": j, "n": m[p, i, j]})

    def cell_counts(part: pd.DataFrame, tops: np.ndarray, p: int) -> np.ndarray:
        """Cells of each class at every place of ``part`` in permutation ``p + 1``."""
        size, known = part["n"].to_numpy(), part["told"].to_numpy()
        out = np.zeros((len(part), len(tops)), dtype=np.int64)
        out[size <= CROWD] = class_counts(part["r"].to_numpy()[size <= CROWD], size[size <= CROWD], tops, seed, p + 1)
        for i in np.flatnonzero(size > CROWD):
            out[i] = np.asarray(known[i]).reshape(perms, len(tops))[p]
        return out

    crowd = attach_small(crowd, borders.drop("classes"), by).select(*keys, "x", "y", "r", "n", "told", "tops")
    crowded = by_group(crowd, near.select(*keys, "x", "y", "r", "n", "told"), keys, in_crowd, schema)
    counts = pairs.select(*columns).mapInPandas(add, schema).unionByName(crowded).groupBy(*by, "perm", "a", "b").agg(F.sum("n").alias("n"))
    named = attach_small(counts, borders.drop("tops"), by)
    return named.select(*by, "perm", F.get("classes", F.col("a")).alias("class_src"), F.get("classes", F.col("b")).alias("class_dst"), "n")


def enrichment(
    points: DataFrame, radius: float, cls: str, perms: int = 100, seed: int = 0, x: str = "x", y: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """Counts of neighbour pairs by class against label permutations within each slide: ``(by, class_src, class_dst, n, mean, std, z)``.

    Only pairs of classes that meet in the data or in some permutation have a row. ``std`` is that of the ``perms`` permutations, ``z`` is null where it
    is 0. Cells without a class or a place take no part; a null slide is no slide.
    """
    by = list(by)
    points = points.where(F.col(cls).isNotNull())
    for c in by:
        points = points.where(F.col(c).isNotNull())
    pair = [*by, "class_src", "class_dst"]
    shuffled = permuted_counts(points, radius, cls, perms, seed, x, y, by).groupBy(*pair).agg(
        F.sum("n").cast("double").alias("_s"), F.sum(F.col("n").cast("double") * F.col("n")).alias("_sq"))
    seen = interaction_counts(points, radius, cls, x, y, by)
    both = seen.join(shuffled, pair, "full").fillna(0, ["n", "_s", "_sq"]).withColumn("mean", F.col("_s") / perms)
    spread = F.sqrt(F.greatest(F.col("_sq") / perms - F.col("mean") * F.col("mean"), F.lit(0.0)))
    both = both.withColumn("std", spread)
    return both.select(*pair, "n", "mean", "std", F.when(F.col("std") > 0, (F.col("n") - F.col("mean")) / F.col("std")).alias("z"))

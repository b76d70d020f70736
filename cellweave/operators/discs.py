"""Sums over discs without the list of pairs: neighbours by class around every place.

Places are dealt to grid cells as wide as the radius. Where few places lie around a cell, pairs are joined. Around a crowded cell one task holds its
places and those of the nine cells about it, cut into thin strips along y: in each strip the disc is one stretch of x, a difference of two running
sums, and only places between the widest and the narrowest chord of the strip are compared one by one. With ``D`` places in a disc
that is some ``sqrt(D)`` steps a place instead of ``D``. Very crowded cells are cut into chunks on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.spatial import location_pairs, spread_hot

DENSE = 512  # places in the nine cells about a cell, beyond which its discs are summed by strips
HELD = 100_000  # places told to one group
ASKED = 8192  # places asked at once
RIM = 2_000_000  # pairs compared at once
FEW = 16  # classes whose running sums are held at once

Entries = tuple[np.ndarray, np.ndarray]


def disc_sums(
    ax: np.ndarray, ay: np.ndarray, tx: np.ndarray, ty: np.ndarray, entries: Callable[[np.ndarray], Iterable[Entries]], kinds: int, radius: float
) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Slices of the asked places, each with one table ``(asked, kinds)`` for every pair ``(label, weight)`` that ``entries`` gives for the told places.

    ``entries`` gets the order in which the told places are to be taken. A place counts when ``dx * dx + dy * dy <= radius * radius``.
    """
    step = radius / max(1, int(np.sqrt(len(tx)) / 6))
    low = ty.min()
    strip = np.floor((ty - low) / step).astype(np.int64)
    order = np.lexsort((tx, strip))
    tx, ty, strip = tx[order], ty[order], strip[order]
    begins = np.flatnonzero(np.r_[True, strip[1:] != strip[:-1]])
    ends = np.r_[begins[1:], len(tx)]
    bottom, top = np.minimum.reduceat(ty, begins), np.maximum.reduceat(ty, begins)
    told = list(entries(order))
    r2 = radius * radius
    slack = 1e-9 * radius + 8 * np.spacing(max(np.abs(ax).max(), np.abs(tx).max(), np.abs(ay).max(), np.abs(ty).max()))
    for at in range(0, len(ax), ASKED):
        part = slice(at, min(at + ASKED, len(ax)))
        px, py = ax[part], ay[part]
        sure, rim = [], []
        for b, e, lo, hi in zip(begins, ends, bottom, top, strict=True):
            near = np.maximum(np.maximum(lo - py, py - hi), 0.0)
            who = np.flatnonzero(near <= radius + slack)
            if not len(who):
                continue
            x, near, far = px[who], near[who], np.maximum(np.abs(py[who] - lo), np.abs(py[who] - hi))
            wide = np.sqrt(np.maximum(r2 - near * near, 0.0) + 2 * radius * slack) + slack
            tall = r2 - far * far - 2 * radius * slack
            narrow = np.sqrt(np.maximum(tall, 0.0)) - slack
            xs = tx[b:e]
            first, last = np.searchsorted(xs, x - wide, "left") + b, np.searchsorted(xs, x + wide, "right") + b
            some = (tall > 0) & (narrow > 0)
            inner = np.where(some, np.searchsorted(xs, x - narrow, "left") + b, last)
            outer = np.maximum(np.where(some, np.searchsorted(xs, x + narrow, "right") + b, last), inner)
            whole = outer > inner
            sure.append((who[whole], inner[whole], outer[whole]))
            rim += [(who, first, inner), (who, outer, last)]
        sums = [np.zeros((len(px), kinds), dtype=np.int64) for _ in told]
        for (label, weight), out in zip(told, sums, strict=True):
            for few in range(0, kinds, FEW):
                some = np.flatnonzero((label >= few) & (label < few + FEW))
                upto = np.zeros((len(label) + 1, min(FEW, kinds - few)), dtype=np.int64)
                upto[some + 1, label[some] - few] = weight[some]
                np.cumsum(upto, axis=0, out=upto)
                for who, inner, outer in sure:
                    out[who, few:few + FEW] += upto[outer] - upto[inner]
        if rim:
            who, first, last = (np.concatenate(c) for c in zip(*rim, strict=True))
            some = last > first
            for i, j in _pairs(who[some], first[some], last[some]):
                dx, dy = px[i] - tx[j], py[i] - ty[j]
                inside = dx * dx + dy * dy <= r2
                i, j = i[inside] * kinds, j[inside]
                for (label, weight), out in zip(told, sums, strict=True):
                    out += np.bincount(i + label[j], weights=weight[j], minlength=out.size).astype(np.int64).reshape(out.shape)
        yield part, sums


def _pairs(who: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an asked place and each told one from ``first`` to ``last - 1``, some ``RIM`` at a time."""
    n = last - first
    upto = np.cumsum(n)
    cuts = np.unique(np.searchsorted(upto, np.arange(RIM, upto[-1] if len(upto) else 0, RIM))) if len(upto) else []
    for a, b in zip(np.r_[0, cuts].astype(int), np.r_[cuts, len(n)].astype(int), strict=True):
        m = n[a:b]
        if m.sum():
            yield np.repeat(who[a:b], m), np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[a:b], m)


def around(
    asking: DataFrame, answering: DataFrame, radius: float, by: Sequence[str], size: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """``(asked where it is sparse, asked in crowds, told to crowds, keys of the groups)``; the last three meet by cogroup. ``size``: entries a told row takes, else 1."""
    side = float(radius)
    cells = [*by, "_cx", "_cy"]
    at = {"_cx": F.floor(F.col("x") / side), "_cy": F.floor(F.col("y") / side)}
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])

    def about(df):
        moved = df.withColumn("_s", F.explode(steps))
        return moved.withColumns({"_cx": F.col("_cx") + F.col("_s.a"), "_cy": F.col("_cy") + F.col("_s.b")}).drop("_s")

    full = about(answering.withColumns(at).groupBy(*cells).agg(F.sum(F.lit(1) if size is None else size).alias("_n"))).groupBy(*cells).agg(F.sum("_n").alias("_n"))
    full = full.where(F.col("_n") > DENSE).select(*cells, F.ceil(F.col("_n") / HELD).alias("_s"))
    ask = asking.withColumns(at)
    sparse = ask.join(full.drop("_s"), cells, "left_anti").drop("_cx", "_cy")
    crowd = ask.join(full.drop("_s"), cells, "left_semi")
    told = about(answering.withColumns(at)).join(full.drop("_s"), cells, "left_semi")
    return (sparse, *spread_hot(crowd, told, cells, full.where("_s > 1"), ["x", "y"], ["x", "y"]))


def by_group(asked: DataFrame, told: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on each group that has rows on both sides; one task never gets all groups because they are small in bytes."""
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        return fn(a, t) if len(a) and len(t) else pd.DataFrame(columns=names)

    told = told.select(*[F.col(c).alias(c) for c in told.columns])  # columns of its own: both sides may come from one table
    left, right = asked.repartition(parts, *keys).groupBy(*keys), told.repartition(parts, *keys).groupBy(*keys)
    return left.cogroup(right).applyInPandas(run, schema)


def class_sums_within(asked: DataFrame, told: DataFrame, radius: float, cls: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, x, y, class, n)``: the weights ``n`` of ``told (by, x, y, cls, n)`` within ``radius`` of each of ``asked (by, x, y)``, by class, where there are any."""
    by = list(by)
    sparse, crowd, near, keys = around(asked.select(*by, "x", "y"), told, radius, by)
    out = [*by, "x", "y", "class"]
    met = location_pairs(sparse, told, radius, by).groupBy(*by, "x", "y", F.col(f"t_{cls}").alias("class")).agg(F.sum("t_n").alias("n"))
    types = dict(told.dtypes)

    def count(a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(t["class"], use_na_sentinel=False)
        weight, rows = t["n"].to_numpy(), []
        sums = disc_sums(a["x"].to_numpy(), a["y"].to_numpy(), t["x"].to_numpy(), t["y"].to_numpy(), lambda o: [(code[o], weight[o])], len(names), radius)
        for part, (n,) in sums:
            i, c = np.nonzero(n)
            rows.append(a[[*by, "x", "y"]].iloc[i + part.start].assign(**{"class": names.take(c), "n": n[i, c]}))
        return pd.concat(rows)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "x double, y double, class string, n long"])
    text = F.col(cls).cast("string").alias("class")  # a text keeps null apart and every digit
    found = by_group(crowd, near.select(*keys, "x", "y", text, "n"), keys, count, schema).withColumn("class", F.col("class").cast(types[cls]))
    return met.unionByName(found.groupBy(*out).agg(F.sum("n").alias("n")))

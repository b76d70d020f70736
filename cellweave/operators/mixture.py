"""One-dimensional Gaussian mixtures and the gates built on them (A16 peaks, A17-A19)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.ordered import attach_small, group_quantiles, quantiles, value_counts
from cellweave.session import durable, fresh_path

FEW_GROUPS = 10_000  # so many states are broadcast; more are joined by key
FLOOR = 1e-6  # smallest variance of a component


@dataclass(frozen=True)
class Mixture:
    """Components in order of their mean."""

    weights: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def component(self, v: Column) -> Column:
        """Index of the most probable component."""
        score = [F.lit(math.log(w) - math.log(s)) - F.pow((v - m) / s, 2) / 2
                 for w, m, s in zip(self.weights, self.means, self.stds)]
        packed = F.array(*[F.struct(c.alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(score)])
        return -F.array_max(packed).getField("i")


def _settled(df: DataFrame, stem: str) -> DataFrame:
    """Written to the shared folder and read back, so that a round is computed once."""
    path = fresh_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mixture_states(
    long: DataFrame, by: Sequence[str], value: str, k: int = 2, tol: float = 1e-3, weight: str | None = None
) -> DataFrame:
    """One mixture per group, all groups fitted together on all rows: ``(by, parts)``, an array of ``(m, w, s)`` by mean.

    Equal values are merged into one weighted row and written once. A round of expectation-maximisation is
    a single map-side combined aggregate over that table; the state of the groups is a table too, of which
    only the number of open groups reaches the driver. A group is done when its likelihood gains less than
    ``tol`` a row; as a round never lowers it, that comes for every group. The start is quantiles and the
    overall variance, so it is deterministic; other solvers start elsewhere and agree within a tolerance.
    ``weight`` names a count of equal rows. Null, NaN and infinite values are left out; a group without any other has no mixture. Where sums of squares leave the
    range of doubles the likelihood is no number, which stops the job.
    """
    keys = list(by) or ["_all"]
    src = long.withColumn("_v", F.col(value).cast("double")).where(F.abs("_v") < F.lit(float("inf")))
    src = src if by else src.withColumn("_all", F.lit(0))
    counts = durable(value_counts(src, keys, "_v", None if weight is None else F.col(weight)))
    probs = [(i + 0.5) / k for i in range(k)]
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    start = counts.groupBy(*keys).agg(mean(F.col("_v")).alias("m"), mean(F.col("_v") * F.col("_v")).alias("m2"))
    spread = F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(FLOOR)))
    state = start.join(group_quantiles(counts, keys, "_v", probs), keys).select(
        *keys, F.array_repeat(F.lit(1.0 / k), k).alias("_w"), F.col("q").cast("array<double>").alias("_m"),
        F.array_repeat(spread, k).alias("_s"), F.lit(None).cast("double").alias("_fit"), F.lit(True).alias("_open"))
    state = _settled(state, "mixture")
    x, n = F.col("_v"), F.col("n")
    while groups := state.where("_open").count():
        going = state.where("_open").withColumnRenamed("_fit", "_last")
        here = counts.join(F.broadcast(going) if groups <= FEW_GROUPS else going, keys)
        logs = F.array(*[F.log(F.col("_w")[i]) - F.log(F.col("_s")[i]) - F.pow((x - F.col("_m")[i]) / F.col("_s")[i], 2) / 2 for i in range(k)])
        here = here.withColumn("_l", logs).withColumn("_top", F.array_max("_l"))
        here = here.withColumn("_e", F.transform("_l", lambda v: F.exp(v - F.col("_top"))))
        here = here.withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda a, v: a + v))
        share = [n * F.col("_e")[i] / F.col("_t") for i in range(k)]
        sums = [(F.sum(n * (F.col("_top") + F.log("_t"))) / F.sum(n)).alias("_fit"), F.sum(n).alias("_n"), F.first("_last").alias("_last")]
        for i in range(k):
            sums += [F.sum(share[i]).alias(f"_r{i}"), F.sum(share[i] * x).alias(f"_x{i}"), F.sum(share[i] * x * x).alias(f"_xx{i}")]
        mass = [F.greatest(F.col(f"_r{i}"), F.lit(1e-12)) for i in range(k)]
        means = [F.col(f"_x{i}") / mass[i] for i in range(k)]
        stds = [F.sqrt(F.greatest(F.col(f"_xx{i}") / mass[i] - means[i] * means[i], F.lit(FLOOR))) for i in range(k)]
        unsound = F.isnan("_fit") | F.col("_fit").isNull()
        gained = F.when(unsound, F.raise_error(F.lit("the likelihood of a mixture is no number"))).otherwise(
            F.col("_last").isNull() | (F.abs(F.col("_fit") - F.col("_last")) >= tol))
        moved = here.groupBy(*keys).agg(*sums).select(
            *keys, F.array(*[F.greatest(w / F.col("_n"), F.lit(1e-12)) for w in mass]).alias("_w"),
            F.array(*means).alias("_m"), F.array(*stds).alias("_s"), "_fit", gained.alias("_open"))
        state = _settled(state.where("not _open").unionByName(moved), "mixture")
    parts = F.transform(F.arrays_zip("_m", "_w", "_s"), lambda p: F.struct(p["_m"].alias("m"), p["_w"].alias("w"), p["_s"].alias("s")))
    return state.select(*keys, F.array_sort(parts).alias("parts"))


def _mixture(parts) -> Mixture:
    return Mixture(tuple(p["w"] for p in parts), tuple(p["m"] for p in parts), tuple(p["s"] for p in parts))


def fit_mixtures(long: DataFrame, by: Sequence[str], value: str, k: int = 2, tol: float = 1e-3) -> dict[tuple, Mixture]:
    """A17 for groups whose mixtures the caller wants at hand, one row a group; :func:`mixture_table` keeps them distributed."""
    return {tuple(r)[:-1]: _mixture(r.parts) for r in mixture_states(long, by, value, k, tol).collect()}


def fit_mixture(df: DataFrame, value: str, k: int = 2, **kw) -> Mixture:
    """A17 for one sample."""
    fits = fit_mixtures(df, [], value, k, **kw)
    if not fits:
        raise ValueError("a mixture needs at least one finite value")
    return fits[(0,)]


def cutoff_values(mix: Mixture, steps: int = 5000) -> list[float]:
    """Grid positions where the most probable component changes."""
    grid = np.linspace(mix.means[0] - 2 * mix.stds[0], mix.means[-1] + 2 * mix.stds[-1], steps)
    score = [math.log(w) - math.log(s) - ((grid - m) / s) ** 2 / 2 for w, m, s in zip(mix.weights, mix.means, mix.stds)]
    best = np.argmax(score, axis=0)
    return [float(v) for v in grid[:-1][np.diff(best) != 0]]


def auto_gate(mix: Mixture, n_stds: float = 3.0, log_transform: bool = True) -> Column:
    """Mean of the highest component minus ``n_stds`` deviations."""
    bound = F.lit(mix.means[-1] - n_stds * mix.stds[-1])
    return F.expm1(bound) if log_transform else bound


def mixture_table(long: DataFrame, by: Sequence[str], value: str, k: int = 2) -> DataFrame:
    """``(by, component, weight, mean, std)``, components in order of their mean."""
    rows = mixture_states(long, by, value, k).select(*by, F.posexplode("parts").alias("component", "p"))
    return rows.select(*by, "component", F.col("p.w").alias("weight"), F.col("p.m").alias("mean"), F.col("p.s").alias("std"))


def channel_windows(long: DataFrame, by: str, value: str, k: int = 3, top: float = 0.999) -> DataFrame:
    """Display window per channel and cut-off ``(by, i, low, high)``: ``low`` where the predicted component
    of log1p values changes, ``high`` the ``top`` quantile of the values above it. The rows are read once, for their value counts."""

    @F.pandas_udf("array<double>")
    def cuts(parts: pd.Series) -> pd.Series:
        return pd.Series([[math.expm1(c) for c in cutoff_values(_mixture(p))] for p in parts])

    counts = durable(value_counts(long, [by], value))
    fits = mixture_states(counts.withColumn("_l", F.log1p(value)), [by], "_l", k, weight="n")
    lows = fits.select(by, F.posexplode(cuts("parts")).alias("i", "low")).withColumn("i", F.col("i") + 1)
    above = attach_small(counts, _settled(lows, "windows"), [by]).where(F.col(value) > F.col("low"))
    high = quantiles(above, [by, "i", "low"], value, [top], counts=above)
    return high.select(by, "i", "low", F.col("q").alias("high"))

"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut in halves, each half has its own codebook, and a cell of the product grid is a pair of codewords. A vector
is filed in the cell of its nearest codewords and looks into cells in the order of the multi-sequence walk, by rising sum of
both squared distances, until the sum exceeds that of its own cell by a *slack*. The slack is set for a target recall:
sample vectors are turned by exactly the threshold angle in random directions, and the slack is the quantile of the
excess at which the turned vector's cell is reached. Nearer pairs are found more often still. What two vectors share a cell
visit is verified by cosine in double precision; a pair counts once for both, whichever of the two looked.

The codebooks are fitted on ``SAMPLE`` vectors; all vectors are filed and all look. Cells and those that look into them are
cut into blocks, so a task compares at most ``BLOCK`` with ``LOOKS`` vectors. A block reports the number of links of each of its
vectors and a spanning forest of its links, never all pairs. Equal vectors are one with a weight from the start.

A vector that is null, empty, all zero, or holds a null or non-finite component links with nothing. A shorter vector counts as
padded with zeros. Rows that repeat are vectors of their own; a null vec_id takes part in counts, components name the smallest
id that isn't null. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import stored
from cellweave.operators.components import connected_components

THRESHOLD = 0.95
TARGET = 0.995
SAMPLE = 20_000
PER_CELL = 256
BLOCK, LOOKS = 2048, 8192
STRIP = 512


def unit(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for k, v in enumerate(rows):
        out[k, :len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # the square of a large component would be infinite, that of a small one zero
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means from rows at even steps; an emptied codeword keeps its place."""
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = squared(x, words).argmin(axis=1)
        for j in np.unique(own):
            words[j] = x[own == j].mean(axis=0)
    return words


def squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :], 0)


@dataclass(frozen=True)
class Grid:
    first: np.ndarray
    second: np.ndarray
    slack: float
    dim: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.dim // 2
        return squared(x[:, :h], self.first), squared(x[:, h:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visits(self, x: np.ndarray) -> Iterator[list[int]]:
        """Cells each row looks into, nearest first."""
        a, b = self.distances(x)
        for p, q in zip(a, b, strict=True):
            yield [i * len(self.second) + j for i, j in walk(p, q, p.min() + q.min() + self.slack)]


def walk(a: np.ndarray, b: np.ndarray, stop: float) -> Iterator[tuple[int, int]]:
    """Multi-sequence walk: pairs by rising a[i] + b[j], up to ``stop``."""
    ia, ib = a.argsort(kind="stable"), b.argsort(kind="stable")
    heap = [(a[ia[0]] + b[ib[0]], 0, 0)]
    while heap:
        total, r, c = heapq.heappop(heap)
        if total > stop + 1e-12:
            return
        yield int(ia[r]), int(ib[c])
        if c + 1 < len(ib):
            heapq.heappush(heap, (a[ia[r]] + b[ib[c + 1]], r, c + 1))
        if c == 0 and r + 1 < len(ia):
            heapq.heappush(heap, (a[ia[r + 1]] + b[ib[0]], r + 1, 0))


def fit(x: np.ndarray, k: int, threshold: float, target: float) -> Grid:
    """Codebooks of a sample and the slack for ``target``."""
    dim, h = x.shape[1], x.shape[1] // 2
    grid = Grid(codebook(x[:, :h], k), codebook(x[:, h:], k), 0.0, dim)
    rng = np.random.default_rng(7)
    some = x[np.linspace(0, len(x) - 1, min(len(x), 4000)).astype(int)].repeat(max(1, 4000 // len(x)), axis=0)
    turn = rng.normal(size=some.shape)
    turn -= (turn * some).sum(1, keepdims=True) * some
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
    a, b = grid.distances(some)
    there = grid.cells(threshold * some + np.sqrt(1 - threshold**2) * turn)
    rows = np.arange(len(some))
    excess = a[rows, there // len(grid.second)] + b[rows, there % len(grid.second)] - a.min(1) - b.min(1)
    return Grid(grid.first, grid.second, float(np.quantile(excess, target, method="higher")), dim)


def compare(entries: pd.DataFrame, looks: pd.DataFrame, dim: int, threshold: float) -> pd.DataFrame:
    """Links within a block: ``(a, null, weight)`` adds to the links of a, ``(a, b, null)`` is a forest edge.

    The looking rows are taken in strips, so no more links than ``STRIP`` rows have are held at once. Labels of the entries
    go on from strip to strip; an edge is told for every label that fell.
    """
    e, q = (np.frombuffer(b"".join(p["vec"]), dtype=np.float64).reshape(-1, dim) for p in (entries, looks))
    qn, en = looks["node"].to_numpy(), entries["node"].to_numpy()
    qw, ew = looks["weight"].to_numpy(), entries["weight"].to_numpy()
    # Where an entry looks into the other's cell itself, it counts the pair there.
    homes, home = np.unique(looks["home"].to_numpy(), return_inverse=True)
    seen = np.zeros((len(e), len(homes)), dtype=bool)
    asked = np.concatenate(list(entries["visits"]))
    at = np.minimum(np.searchsorted(homes, asked), len(homes) - 1)
    there = homes[at] == asked
    seen[np.repeat(np.arange(len(e)), entries["visits"].str.len())[there], at[there]] = True
    to_q, to_e = np.zeros(len(q), np.int64), np.zeros(len(e), np.int64)
    label_e, edges = en.copy(), []
    for lo in range(0, len(q), STRIP):
        hi = min(lo + STRIP, len(q))
        i, j = np.nonzero((q[lo:hi] @ e.T >= threshold) & (qn[lo:hi, None] != en[None, :]))
        if not len(i):
            continue
        to_q[lo:hi] += np.bincount(i, ew[j], minlength=hi - lo).astype(np.int64)
        new = ~seen[j, home[lo + i]]
        to_e += np.bincount(j[new], qw[lo + i[new]], minlength=len(e)).astype(np.int64)
        label_q, before_e = qn[lo:hi].copy(), label_e.copy()
        while True:
            before = label_q.copy()
            np.minimum.at(label_e, j, label_q[i])
            np.minimum.at(label_q, i, label_e[j])
            if np.array_equal(before, label_q):
                break
        edges += [np.column_stack([qn[lo:hi], label_q]), np.column_stack([before_e, label_e])]
    pairs = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    node, add = np.concatenate([qn, en]), np.concatenate([to_q, to_e])
    linked = add > 0
    return pd.DataFrame({
        "a": pd.array(np.concatenate([node[linked], pairs[:, 0]]), dtype="Int64"),
        "b": pd.array([None] * int(linked.sum()) + pairs[:, 1].tolist(), dtype="Int64"),
        "w": pd.array(add[linked].tolist() + [None] * len(pairs), dtype="Int64")})


def links(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, v)`` of all rows, ``v`` null if it links with nothing; and ``(v, n_links, component_id)`` per distinct vector."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, v).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"))
    classes = stored(classes.withColumn("node", F.xxhash64("v", "low")), "vectors")
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "a long, b long, w long")
    found = empty
    if n:
        part = min(1.0, 1.2 * SAMPLE / n)
        drawn = classes.where(F.pmod("node", F.lit(1 << 20)) <= int(part * (1 << 20))).orderBy("node").limit(SAMPLE).select("v").collect()
        x = unit([r.v for r in drawn], dim) if drawn else unit([classes.select("v").first().v], dim)
        grid = fit(x, max(1, min(round((n / PER_CELL) ** 0.5), len(x))), threshold, target)
        found = stored(_blocks(classes, grid, threshold), "vector-links")
    direct = found.where("w is not null").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("n"))
    roots = connected_components(found.where("b is not null"), "a", "b")
    named = classes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows, named.join(low, "component").join(direct, "node", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")


def _blocks(classes: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(grid)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = unit(list(b["v"]), shared.value.dim)
                yield pd.DataFrame({"node": b["node"], "weight": b["weight"], "vec": [r.tobytes() for r in x],
                                    "home": shared.value.cells(x), "visits": list(shared.value.visits(x))})

    filed = stored(classes.select("node", "weight", "v").mapInPandas(file, "node long, weight long, vec binary, home long, visits array<long>"), "filed")
    looks = filed.withColumn("cell", F.explode("visits"))
    sizes = filed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("es"))
    asked = looks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LOOKS).alias("qs"))
    sizes = stored(sizes.join(asked, "cell"), "cells")
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    left = filed.withColumn("cell", F.col("home")).join(sizes, "cell").select(
        "cell", own("es").alias("e"), F.explode(spread("qs")).alias("q"), "node", "weight", "vec", "visits")
    right = looks.drop("visits").join(sizes, "cell").select(
        F.col("cell").alias("at"), F.explode(spread("es")).alias("e"), own("qs").alias("q"), *[F.col(c).alias(c) for c in ("node", "weight", "vec", "home")])
    dim = grid.dim

    def block(entries: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(asking):
            return pd.DataFrame({"a": [], "b": [], "w": []}).astype("Int64")
        return compare(entries, asking, dim, threshold)

    return left.groupBy("cell", "e", "q").cogroup(right.groupBy("at", "e", "q")).applyInPandas(block, "a long, b long, w long")


def report(vectors: DataFrame) -> DataFrame:
    rows, found = links(vectors)
    own = F.coalesce("component_id", "vec_id")
    return rows.join(found, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"))

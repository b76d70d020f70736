"""Sums over discs by strips against brute force, and the operators on them with crowds, chunks and piles."""

import numpy as np
import pandas as pd
import pytest

from cellweave.operators import discs
from cellweave.operators import neighbourhood as nb
from cellweave.operators import permutation as pm
from cellweave.operators import spatial as sp


def test_disc_sums_equal_brute_force(monkeypatch):
    monkeypatch.setattr(discs, "RIM", 1000)
    monkeypatch.setattr(discs, "ASKED", 100)
    monkeypatch.setattr(discs, "FEW", 3)
    rng = np.random.default_rng(0)
    x, y = np.round(rng.random(4000) * 3, 2), np.round(rng.random(4000) * 3, 2)  # many places at the very rim
    label, weight = rng.integers(0, 5, 4000), rng.integers(1, 4, 4000)
    got = np.concatenate([s for _, (s,) in discs.disc_sums(x[:300], y[:300], x, y, lambda o: [(label[o], weight[o])], 5, 0.25)])
    near = (x[:300, None] - x) ** 2 + (y[:300, None] - y) ** 2 <= 0.25 * 0.25
    assert (got == near.astype(int) @ (np.eye(5, dtype=int)[label] * weight[:, None])).all()


def test_strips_compare_few_pairs(monkeypatch):
    seen = []
    pairs = discs._pairs
    monkeypatch.setattr(discs, "_pairs", lambda *a: (seen.append(len(i)) or (i, j) for i, j in pairs(*a)))
    rng = np.random.default_rng(1)
    x, y = rng.random(20_000) * 3, rng.random(20_000) * 3
    one = np.ones(20_000, dtype=int)
    met = sum(int(s.sum()) for _, (s,) in discs.disc_sums(x, y, x, y, lambda o: [(one[o] - 1, one[o])], 1, 1.0))
    assert 0 < sum(seen) < 0.15 * met


@pytest.mark.parametrize("held", [40, 100_000])
def test_crowds_give_the_rows_of_pairs(spark, monkeypatch, held):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"id": range(600), "slide": rng.integers(0, 2, 600), "cls": rng.choice(["a", "b", None], 600, p=[0.5, 0.4, 0.1]),
                      "x": np.round(rng.normal(0, 0.5, 600), 1), "y": np.round(rng.normal(0, 0.5, 600), 1)})
    points = spark.createDataFrame(p.astype(object).where(p.notna(), None), "id long, slide long, cls string, x double, y double")

    def rows():
        counts = nb.neighbour_counts(points, 0.3, "id", "cls", by=["slide"]).collect()
        met = nb.interaction_counts(points, 0.3, "cls", by=["slide"]).collect()
        scores = pm.enrichment(points, 0.3, "cls", perms=3, seed=4, by=["slide"]).collect()
        return [sorted((tuple(r) for r in part), key=repr) for part in (counts, met, scores)]

    monkeypatch.setattr(discs, "DENSE", 10**9)
    want = rows()
    monkeypatch.setattr(discs, "DENSE", 5)
    monkeypatch.setattr(discs, "HELD", held)
    monkeypatch.setattr(pm, "CROWD", 3)
    assert rows() == want and all(want)


def test_edges_are_made_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(sp, "PAIRED", 20)
    monkeypatch.setattr(sp, "IDS", 3)
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"id": range(300), "slide": rng.integers(0, 2, 300), "x": np.round(rng.random(300), 1), "y": np.round(rng.random(300), 1)})
    p.loc[0, "x"] = np.nan
    edges = sp.radius_neighbours(spark.createDataFrame(p), 0.25, "id", by=["slide"])
    q = p[p.x.notna()].merge(p, on="slide", suffixes=("", "_t"))
    d2 = (q.x - q.x_t) ** 2 + (q.y - q.y_t) ** 2
    q = q[(d2 <= 0.25 * 0.25) & (q.id != q.id_t)]
    assert sorted(map(tuple, edges.select("src", "dst").collect())) == sorted(zip(q.id.tolist(), q.id_t.tolist()))
    monkeypatch.setattr(sp, "PAIRED", 10_000)
    plan = sp.radius_neighbours(spark.createDataFrame(p), 0.25, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # ids came back by two more joins of all pairs

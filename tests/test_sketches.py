"""Stored sketches, merged by later phases, against exact counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import sketches as sk
from cellweave.session import fresh_path

SCHEMA = "slide string, channel string, value double, label long"


def test_merged_phases_answer_like_all_rows(spark):
    """Four phases of different sizes and places; one slide has two thirds of the rows, a third of them one value."""
    path = fresh_path(spark, "sk")
    rng, seen = np.random.default_rng(5), {"a": [], "b": []}
    for phase, n in enumerate([40_000, 3_000, 1, 60_000]):
        for slide, share in (("a", 1.0), ("b", 0.5)):
            v = rng.normal(phase, 1 + phase, max(1, int(n * share)))
            v[: len(v) // 3] = 2.0
            seen[slide].append(v)
        rows = spark.createDataFrame([(s, "c", float(x), i % 700) for s in seen for i, x in enumerate(seen[s][-1])], SCHEMA)
        for _ in range(2 if phase == 1 else 1):  # a repeated job replaces its phase
            sk.store_phase(sk.sketch(rows, ["slide", "channel"], "value", "label"), path, f"{phase:02d}")
    kept = sk.stored_phases(spark, path)
    assert dict(kept.dtypes)["phase"] == "string" and {r.phase for r in kept.select("phase").distinct().collect()} == {"00", "01", "02", "03"}
    whole = sk.merge(kept, ["slide"])
    probs = [0.0, 0.05, 0.3, 0.5, 0.9, 1.0]
    for r in sk.sketched_quantiles(whole, ["slide"], probs).collect():
        all_v = np.concatenate(seen[r.slide])
        lo, hi = (all_v < r.q).mean(), (all_v <= r.q).mean()
        assert max(lo - r.p, r.p - hi, 0) <= 2 * sk.rank_error()
        if r.p in (0.0, 1.0):
            assert r.q == (all_v.min() if r.p == 0 else all_v.max())
    for r in sk.sketched_ranks(whole, ["slide"], [-1.0, 2.0, 1e9]).collect():
        assert abs(r.share - (np.concatenate(seen[r.slide]) <= r.value).mean()) <= 2 * sk.rank_error()
    for r in sk.sketched_objects(whole, ["slide"]).collect():
        assert abs(r.n_objects / 699 - 1) <= 4 * sk.distinct_error()
    part = sk.merge(sk.stored_phases(spark, path, ["01", "02"]), ["slide", "channel"]).collect()
    assert {r.slide: r.n for r in part} == {s: len(seen[s][1]) + len(seen[s][2]) for s in seen}


def test_rank_gaps_are_the_distance_from_the_span_of_a_value(spark):
    rows = spark.createDataFrame([("s", "c", float(v), 1) for v in [1, 2, 2, 2, 3, 4, 5, 6, 7, 8]], SCHEMA)
    found = spark.createDataFrame([("s", 0.1, 1.0), ("s", 0.3, 2.0), ("s", 0.9, 5.0)], "slide string, p double, q double")
    got = {r.p: (r.n, round(r.gap, 9)) for r in sk.rank_gaps(rows, ["slide"], "value", found).collect()}
    assert got == {0.1: (10, 0.0), 0.3: (10, 0.0), 0.9: (10, 0.2)}


def test_groups_without_values_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", "c", None, None), ("a", "c", float("nan"), 0), ("b", "c", 1.5, 7), (None, "c", 2.5, -1)], SCHEMA)
    s = sk.merge(sk.sketch(rows, ["slide"], "value", "label"), ["slide"])
    q = {(r.slide, r.p): r.q for r in sk.sketched_quantiles(s, ["slide"], [0.0, 0.5]).collect()}
    assert q == {("a", 0.0): None, ("a", 0.5): None, ("b", 0.0): 1.5, ("b", 0.5): 1.5, (None, 0.0): 2.5, (None, 0.5): 2.5}
    assert {r.slide: r.n_objects for r in sk.sketched_objects(s, ["slide"]).collect()} == {"a": 0, "b": 1, None: 0}
    assert {r.slide: r.share for r in sk.sketched_ranks(s, ["slide"], [2.0]).collect()} == {"a": None, "b": 1.0, None: 0.0}
    none = sk.sketch(rows.limit(0), ["slide"], "value", "label")
    assert sk.sketched_quantiles(sk.merge(none, ["slide"]), ["slide"], [0.5]).count() == 0
    assert sk.merge(sk.sketch(rows, [], "value"), []).first().n == 2


def test_phase_names_are_folders(spark):
    for bad in ("", "a/b", "x=1"):
        with pytest.raises(ValueError):
            sk.store_phase(spark.range(1).select(F.lit(1).alias("n")), "/nowhere", bad)

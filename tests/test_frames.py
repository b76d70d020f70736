import math

import pytest
from pyspark.sql import functions as F

from cellweave.operators import frames as fr
from cellweave.operators import joins as jn
from cellweave.operators import ordered as od

NAN = float("nan")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fill_and_round_is_half_even_and_covers_nan(spark):
    df = spark.createDataFrame([(1, 0.125), (2, None), (3, NAN)], "k int, v double")
    assert rows(fr.fill_and_round(df, ["v"])) == [(1, 0.12), (2, 0.0), (3, 0.0)]


def test_min_above_skips_missing(spark):
    df = spark.createDataFrame([(1, 5.0, NAN), (2, 5.0, 1.0), (3, None, None)], "k int, a double, b double")
    assert [r.k for r in fr.min_above(df, ["a", "b"], 2).collect()] == [1]


def test_class_markers_long_form(spark):
    df = spark.createDataFrame([(1, "A: B: A"), (2, "Ignore*"), (3, None), (4, "C")], "id int, c string")
    got = fr.class_markers(df, "c").select("id", "marker").collect()
    assert sorted(map(tuple, got)) == [(1, "A"), (1, "B"), (4, "C")]


def test_class_indicators_whole_names_only(spark):
    df = spark.createDataFrame([(1, "CD4: CD8"), (2, "CD45"), (3, "Ignore*"), (4, None)], "k int, c string")
    got = fr.class_indicators(df, "c").drop("c")
    assert got.columns == ["k", "CD4", "CD45", "CD8"]
    assert rows(got) == [(1, True, False, True), (2, False, True, False), (3, False, False, False), (4, False, False, False)]


def test_arg_max_tie_takes_smallest(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 2, 1.0), ("a", 1, 0.5)], "t string, z int, s double")
    assert rows(fr.arg_max(df, ["t"], "z", "s")) == [("a", 2, 1.0)]


def test_fill_down_and_running_product(spark):
    df = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, "b"), (4, None)], "i long, v string")
    assert [r.v for r in fr.fill_down(df, "i", "v").orderBy("i").collect()] == [None, "a", "a", "b", "b"]
    one = spark.range(1).select(fr.running_product(F.array(F.lit(2.0), F.lit(3.0), F.lit(4.0))).alias("p"))
    assert one.first().p == [2.0, 6.0, 24.0]


def test_stratified_sample_pads_short_bins(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "k long, v double")
    got = fr.stratified_sample(df, "v", ["k"], 2, 8).collect()
    assert len(got) == 16
    assert {r.k for r in got if r.bin == 1} == {0, 1, 2, 3, 4}


def test_stratified_sample_is_the_same_on_any_partitioning(spark):
    df = spark.range(500).selectExpr("id k", "cast(id % 97 as double) v")
    a = fr.stratified_sample(df.repartition(1), "v", ["k"], 4, 5, seed=2)
    b = fr.stratified_sample(df.repartition(7), "v", ["k"], 4, 5, seed=2)
    assert rows(a) == rows(b)


def test_combine_cycles_rejects_unequal_sizes(spark):
    df = spark.createDataFrame([("a", 0, 8, 8), ("b", 1, 8, 9)], "cycle string, channel int, h int, w int")
    with pytest.raises(Exception, match="sizes differ"):
        fr.combine_cycles(df, "a").collect()
    df = spark.createDataFrame([("a", 1, 8, 8), ("b", 0, 8, 8)], "cycle string, channel int, h int, w int")
    with pytest.raises(Exception, match="no channel left"):
        fr.combine_cycles(df, "a").collect()


def test_strict_lookup_fails_on_missing_and_duplicate(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(Exception, match="key not found: b"):
        jn.strict_lookup(df, spark.createDataFrame([("a", 1)], "k string, v int"), "k", "v").collect()
    with pytest.raises(Exception, match="key mapped twice: a"):
        jn.strict_lookup(df, spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int"), "k", "v").collect()


def test_merge_long_equals_outer_joins(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, s double")
    b = spark.createDataFrame([(2, 5.0), (3, 7.0)], "id long, s double")
    assert rows(jn.merge_long({"a": a, "b": b}, ["id"], ["s"])) == [(1, 2.0, 0.0), (2, 3.0, 5.0), (3, 0.0, 7.0)]
    empty = a.where("false")
    assert rows(jn.merge_long({"a": a, "b": empty}, ["id"], ["s"])) == [(1, 2.0, 0.0), (2, 3.0, 0.0)]


def test_recolour_background_and_missing(spark):
    px = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 2, 9), (0, 3, None)], "y int, x int, label int")
    v = spark.createDataFrame([(1, 5)], "label int, n int")
    got = jn.recolour(px, v, "n", missing=2, background=3)
    assert {(r.x, r.value) for r in got.collect()} == {(0, 3), (1, 5), (2, 2), (3, 3)}


def test_mask_difference_second_wins_ties(spark):
    a = spark.createDataFrame([(0, 0, 1)], "y int, x int, label int")
    b = spark.createDataFrame([(0, 1, 2)], "y int, x int, label int")
    assert rows(jn.mask_difference(a, b)) == [(0, 1, 2)]


def test_rank_pairs_long_runs(spark):
    left = [("a", 1.0)] * 1000 + [("a", 2.0)] * 5
    right = [("b", float(i % 3)) for i in range(700)]
    got = jn.rank_pairs(spark.createDataFrame(left + right, "s string, v double"), "s", "v", "a", "b", block=4)
    xs, ys = sorted(v for _, v in left), sorted(v for _, v in right)
    want = {}
    for p in zip(xs, ys):
        want[p] = want.get(p, 0) + 1
    assert {(r.v1, r.v2): r.pairs for r in got.collect()} == want


def test_quantiles_match_linear_interpolation(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.concatenate([np.full(400, 3.0), rng.normal(size=801)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (NAN,)], "v double")
    p = [0, 0.001, 0.25, 0.5, 0.77, 0.999, 1]
    got = od.quantiles(df, [], "v", p, wide=True).first().q
    assert np.allclose(got, np.percentile(v, [100 * q for q in p]))


def test_running_sum_with_groups_and_following(spark):
    df = spark.createDataFrame([(g, float(i), i) for g in "ab" for i in range(600)], "g string, v double, n long")
    got = od.running_sum(df, ["g"], "v", {"c": "n"}, totals=True, following="nx").where("g = 'a'").orderBy("v").collect()
    total = 0
    for i, r in enumerate(got):
        total += i
        assert r.c == total and r.c_total == 599 * 300
        assert r.nx == (i + 1 if i < 599 else None)


def test_attach_small_falls_back_to_a_plain_join(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(9)], "k int, v int")
    s = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k int, t string")
    assert rows(od.attach_small(df, s, ["k"], max_rows=1)) == rows(od.attach_small(df, s, ["k"]))


def test_sample_rows_clips_to_size(spark):
    assert fr.sample_rows(spark.range(5).withColumnRenamed("id", "k"), ["k"], 9).count() == 5
    assert math.isclose(fr.sample_fraction(spark.range(20000).withColumnRenamed("id", "k"), ["k"], 0.05).count(), 1000, rel_tol=0.15)

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import mixture as mx
from cellweave.operators import ordered as od
from cellweave.operators import stats as st


def samples(spark, **named):
    return spark.createDataFrame([(k, float(v)) for k, vs in named.items() for v in vs], "s string, v double")


def test_histogram_closes_last_bin_and_keeps_empty_ones(spark):
    df = samples(spark, a=[0, 1, 2, 10])
    h = st.histogram(df, ["s"], "v", 5).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 1, 0, 0, 1]
    assert h[-1].cumulative == 1.0


def test_histogram_of_one_value(spark):
    h = st.histogram(samples(spark, a=[3, 3]), ["s"], "v", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 0, 0, 0]


def test_earth_mover_and_overlap_follow_the_shift(spark):
    rng = np.random.default_rng(0)
    base = rng.lognormal(1, 0.5, 1500)
    df = samples(spark, r=base, a=base + 0.2, b=base + 0.8, c=base + 3)
    emd = {r.s: r.emd for r in st.earth_mover(df, "s", "v", "r", ["a", "b", "c"]).collect()}
    assert np.isclose(emd["a"], 0.2) and np.isclose(emd["c"], 3.0)
    iou = {r.s: r.iou for r in st.histogram_overlap(df, "s", "v", "r", 50).collect()}
    assert iou["a"] > iou["b"] > iou["c"]


def brute_cvm(x, y):
    z = np.concatenate([x, y])
    order = np.sort(z)
    mid = lambda v: (np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2
    n, m = len(x), len(y)
    u = n * np.sum((mid(np.sort(x)) - np.arange(1, n + 1)) ** 2) + m * np.sum((mid(np.sort(y)) - np.arange(1, m + 1)) ** 2)
    return u / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m))


def test_cramer_von_mises(spark):
    rng = np.random.default_rng(2)
    x, y = np.round(rng.normal(size=300), 1), np.round(rng.normal(0.3, 1, 200), 1)
    r = st.cramer_von_mises(samples(spark, r=x, a=y), "s", "v", "r", ["a"]).first()
    assert np.isclose(r.statistic, brute_cvm(x, y))
    assert 0 < r.p_value < 0.2
    # limiting distribution: published 95 % and 99 % points are 0.46136 and 0.74346
    big = 10 ** 7
    assert abs(st.cvm_tail(0.46136, big, big) - 0.05) < 1e-4
    assert abs(st.cvm_tail(0.74346, big, big) - 0.01) < 1e-4


def test_match_distribution_like_interpolation(spark):
    rng = np.random.default_rng(3)
    src, ref = np.round(rng.normal(size=200), 1), np.round(rng.normal(5, 2, 300), 1)
    got = st.match_distribution(samples(spark, s=src, r=ref), "s", "v", "s", "r").collect()
    sv, sc = np.unique(src, return_counts=True)
    rv, rc = np.unique(ref, return_counts=True)
    want = dict(zip(sv, np.interp(np.cumsum(sc) / len(src), np.cumsum(rc) / len(ref), rv)))
    assert len(got) == 200
    assert all(np.isclose(r.matched, want[r.v]) for r in got)


def test_calibration_finds_equal_steps(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(3 * k, 0.25, 900 - 150 * k) for k in range(1, 6)])
    line = st.calibrate_counts(samples(spark, a=v), ["s"], "v", bin_size=0.25).first()
    assert line.peaks == 5
    assert np.isclose(line.slope, 1 / 3, atol=0.05)


def test_calibration_with_too_few_peaks_is_null(spark):
    line = st.calibrate_counts(samples(spark, a=[1.0, 1.1, 1.2]), ["s"], "v").collect()
    assert not line or line[0].slope is None


def test_mixture_recovers_components_and_gate(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, 3000), rng.normal(10, 1, 1000)])
    df = samples(spark, a=v)
    m = mx.fit_mixture(df, "v", 2)
    assert np.allclose(m.means, (0, 10), atol=0.2) and np.allclose(m.weights, (0.75, 0.25), atol=0.03)
    cut = mx.cutoff_values(m)
    assert len(cut) == 1 and 4 < cut[0] < 6
    both = mx.fit_mixtures(samples(spark, a=v, b=v + 100), ["s"], "v", 2)
    assert np.allclose(both["a",].means, m.means) and np.allclose(both["b",].means, np.add(m.means, 100), atol=1e-3)
    labels = df.select(m.component(F.col("v")).alias("c")).groupBy("c").count().collect()
    assert {r.c: r["count"] for r in labels}[1] == int((v > cut[0]).sum())
    windows = mx.channel_windows(samples(spark, a=np.exp(v) - 1), "s", "v", 2).collect()
    assert len(windows) == 1 and windows[0].low < windows[0].high
    gate = df.select(mx.auto_gate(m, 3.0, log_transform=False).alias("g")).first().g
    assert np.isclose(gate, m.means[1] - 3 * m.stds[1])


def test_change_points_across_buckets(spark):
    df = spark.range(2000).selectExpr("id", "cast(id div 700 as int) lab")
    got = st.change_points(df, [], "id", "lab").orderBy("id").collect()
    assert [(r.id, r.midpoint) for r in got] == [(699, 699.5), (1399, 1399.5)]


def test_local_maxima_plateau_and_ends(spark):
    v = [5, 1, 3, 3, 1, 0, 2, 0]
    df = spark.createDataFrame(list(enumerate(map(float, v))), "i int, v double")
    assert sorted(r.i for r in st.local_maxima(df, [], "i", "v").collect()) == [2, 6]


def test_smooth_repeats_ends(spark):
    df = spark.createDataFrame([(i, 2.0) for i in range(5)], "i int, v double")
    assert all(np.isclose(r.smoothed, 2.0) for r in st.smooth(df, [], "i", "v").collect())


def test_fold_rare_handles_null_and_excluded(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] + [("Ignore*",)] * 9 + [(None,)] * 6, "c string")
    got = {r.c: r["count"] for r in st.fold_rare(df, "c", 3).groupBy("c").count().collect()}
    assert got == {"a": 5, "Others": 16}


def test_mutual_information_of_equal_and_unrelated_images(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 10, 4000), rng.integers(0, 10, 4000)
    df = spark.createDataFrame([(float(x), float(x), float(y)) for x, y in zip(a, b)], "a double, same double, other double")
    assert np.isclose(st.mutual_information(df, "a", "same", bins=10).first().nmi, 2.0)
    assert st.mutual_information(df, "a", "other", bins=10).first().nmi < 1.02
    scores = spark.createDataFrame([(1, 1.0, 1.2), (2, 1.3, 1.2), (3, 1.9, 1.2)], "i int, s double, b double")
    assert st.first_improving(scores, [], "i", "s", "b").first().i == 2


@pytest.mark.parametrize("cut", [None, 0.0])
def test_empty_input_gives_empty_output(spark, cut):
    df = samples(spark, a=[1.0]).where("false")
    assert st.earth_mover(df, "s", "v", "a", ["b"], cut).count() == 0
    assert st.histogram(df, ["s"], "v", 4).count() == 0
    assert df.agg(F.count("*")).first()[0] == 0


def test_mixtures_end_on_values_that_are_no_numbers(spark):
    rng = np.random.default_rng(2)
    good = [("a", float(v)) for v in np.concatenate([rng.normal(0, 1, 60), rng.normal(9, 1, 40)])]
    odd = [("a", float("inf")), ("a", float("-inf")), ("a", float("nan")), ("a", None), ("b", float("inf")), ("c", 3.0)]
    schema = "g string, v double"
    clean = {(r.g, r.component): r for r in mx.mixture_table(spark.createDataFrame(good, schema), ["g"], "v", 2).collect()}
    got = {(r.g, r.component): r for r in mx.mixture_table(spark.createDataFrame(good + odd, schema), ["g"], "v", 2).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("c", 0), ("c", 1)}
    assert all(np.isclose(got[k]["mean"], clean[k]["mean"]) for k in clean)
    assert mx.mixture_table(spark.createDataFrame([], schema), ["g"], "v", 2).count() == 0
    with pytest.raises(ValueError):
        mx.fit_mixture(spark.createDataFrame(odd[:5], schema), "v")
    with pytest.raises(Exception, match="no number"):
        mx.mixture_table(spark.createDataFrame([("a", 1e200), ("a", -1e200)], schema), ["g"], "v", 2).collect()


def test_array_smoothing_and_peaks_equal_the_table_forms(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i, float(v)) for g, n in (("a", 60), ("b", 1), ("c", 9)) for i, v in enumerate(rng.integers(0, 9, n))]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    table = st.smooth(df, ["g"], "i", "v", 1.5)
    arrays = df.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("a"))
    got = arrays.withColumn("s", st.smooth_array(F.col("a"), 1.5)).withColumn("p", st.peaks_of_array(F.col("s"), 3)).collect()
    want = {(r.g, r.i): r.smoothed for r in table.collect()}
    assert all(np.isclose(v, want[r.g, i]) for r in got for i, v in enumerate(r.s)) and sum(len(r.s) for r in got) == len(want)
    peaks = {}
    for r in st.local_maxima(table, ["g"], "i", "smoothed", 3).collect():
        peaks.setdefault(r.g, []).append(r.i)
    assert {r.g: r.p for r in got if r.p} == {g: sorted(p) for g, p in peaks.items()}


def test_calibration_over_all_rows_and_with_clashing_names(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(3 * k, 0.25, 900 - 150 * k) for k in range(1, 6)])
    df = samples(spark, a=v)
    keyed, whole = st.calibrate_counts(df, ["s"], "v", bin_size=0.25).first(), st.calibrate_counts(df, [], "v", bin_size=0.25).first()
    assert np.isclose(keyed.slope, whole.slope) and np.isclose(keyed.intercept, whole.intercept)
    clash = df.withColumns({c: F.lit(1) for c in ("lo", "hi", "bins", "n", "_b")})
    assert np.isclose(st.calibrate_counts(clash, ["s"], "v", bin_size=0.25).first().slope, keyed.slope)
    assert st.calibrate_counts(df.limit(0), ["s"], "v").count() == 0


def test_large_groups_keep_a_key_named_like_the_helper(spark):
    counts = spark.range(1, 400).selectExpr("cast(0 as int) _all", "cast(id * id as double) v", "id % 5 + 1 n")
    probs = [0.1, 0.5, 0.9]
    few, many = (od.group_quantiles(counts, ["_all"], "v", probs, most).collect() for most in (1000, 10))
    assert [tuple(r) for r in few] == [tuple(r) for r in many]


def counted_rows(spark, pairs):
    """Rows ``(s, v)`` that count each time they are read."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.createDataFrame([(s, None if v is None else float(v)) for s, v in pairs], "s string, v double")
    return rows.mapInPandas(through, "s string, v double"), read


def test_anchors_read_the_rows_once(spark):
    rng = np.random.default_rng(4)
    pairs = [(s, v) for s in "ab" for v in rng.integers(0, 40, 300)] + [("a", None), ("b", float("nan"))]
    rows, read = counted_rows(spark, pairs)
    got = {(r.s, r.anchor): r.value for r in st.anchors(rows, ["s"], "v", {"t5": (0.05, 0.95)}).collect()}
    for s in "ab":
        v = np.array([v for g, v in pairs if g == s and v is not None and v == v], dtype=float)
        lo, hi = np.quantile(v, [0.05, 0.95])
        want = {"min": v.min(), "max": v.max(), "t5_low": v[v <= lo].mean(), "t5_high": v[v >= hi].mean()}
        assert all(np.isclose(got[s, k], w) for k, w in want.items())
    assert read.value == len(pairs)


def test_channel_windows_read_the_rows_once(spark):
    rng = np.random.default_rng(3)
    v = np.round(np.exp(np.concatenate([rng.normal(1, 0.2, 300), rng.normal(4, 0.3, 300)])), 1)
    pairs = [("a", x) for x in v] + [("b", x) for x in 2 * v] + [("a", None)]
    rows, read = counted_rows(spark, pairs)
    windows = mx.channel_windows(rows, "s", "v", 2).collect()
    assert {r.s for r in windows} == {"a", "b"}
    for r in windows:
        assert np.isclose(r.high, np.quantile((v if r.s == "a" else 2 * v)[(v if r.s == "a" else 2 * v) > r.low], 0.999))
    assert read.value == len(pairs)

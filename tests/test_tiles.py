import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import components as cp
from cellweave.operators import kernels as kn
from cellweave.operators import regions as rg
from cellweave.operators import tiles as tl


def image(spark, img):
    h, w = img.shape
    return spark.createDataFrame([(y, x, float(img[y, x])) for y in range(h) for x in range(w)], "y long, x long, value double")


def back(df, shape, value="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


@pytest.mark.parametrize("halo", [0, 3, 9])
def test_halo_blocks_equal_whole_image(spark, halo):
    rng = np.random.default_rng(halo)
    img = rng.integers(0, 50, (19, 13)).astype(float)
    tiles = tl.to_tiles(image(spark, img), 8)
    size = 2 * halo + 1
    got = back(tl.to_pixels(tl.map_tiles(tiles, 8, halo, lambda b: kn.rank_filter(b, [(a, c) for a in (-halo, 0, halo) for c in (-halo, 0, halo)], np.maximum)), 8), img.shape)
    big = np.pad(img, halo, mode="symmetric")
    want = np.max([big[a:a + 19, c:c + 13] for a in (0, halo, 2 * halo) for c in (0, halo, 2 * halo)], axis=0)
    assert size and np.array_equal(got, want)


def discs(shape=(40, 37)):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    lab = np.zeros(shape, int)
    for k, (y, x, r) in enumerate([(8, 8, 5), (8, 25, 6), (25, 12, 7), (32, 31, 4)], 1):
        lab[(yy - y) ** 2 + (xx - x) ** 2 <= r * r] = k
    return lab


def test_shape_table_equals_blocked_with_halo(spark):
    lab = discs()
    px = image(spark, lab).withColumn("label", F.col("value").cast("long"))
    whole = {r.label: r for r in rg.shape_table(px).collect()}
    halo = int(tl.needed_halo(px, 16).first().halo)
    pieces = tl.to_pixels(tl.to_tiles(px, 16), 16)
    spread = tl.halo_pieces(tl.to_tiles(px, 16), 16, halo)
    blocks = spread.select("tile_row", "tile_col", "dr", "dc", "py", "px", "pw", F.posexplode("pixels").alias("i", "v")).select(
        "tile_row", "tile_col", ((F.col("tile_row") - F.col("dr")) * 16 + F.col("py") + F.floor(F.col("i") / F.col("pw"))).alias("y"),
        ((F.col("tile_col") - F.col("dc")) * 16 + F.col("px") + F.col("i") % F.col("pw")).alias("x"), F.col("v").cast("long").alias("label"))
    part = rg.shape_table(blocks, ["tile_row", "tile_col"])
    merged = {r.label: r for r in rg.keep_largest(part.drop("tile_row", "tile_col"), ["label"]).collect()}
    assert pieces.count() == lab.size and set(merged) == set(whole) == {1, 2, 3, 4}
    for k, r in whole.items():
        assert r.area == merged[k].area and np.isclose(r.eccentricity, merged[k].eccentricity, atol=1e-6)
        assert np.isclose(r.area, (lab == k).sum())


def test_shape_of_a_line_and_a_pixel(spark):
    df = spark.createDataFrame([(0, x, 1) for x in range(5)] + [(9, 9, 2), (5, 5, 0)], "y int, x int, label int")
    got = {r.label: r for r in rg.shape_table(df).collect()}
    assert set(got) == {1, 2}
    assert np.isclose(got[1].axis_major_length, 4 * np.sqrt(2 + 1 / 12)) and np.isclose(got[1].extent, 1)
    assert np.isclose(got[2].eccentricity, 0)


def test_solidity_of_a_corner(spark):
    df = spark.createDataFrame([(y, x, 1) for y in range(4) for x in range(4) if y == 0 or x == 0], "y int, x int, label int")
    r = rg.solidity(df).first()
    assert r.area == 7 and np.isclose(r.hull_area, 7 + 4.5)


def test_intensity_stats_without_values_above(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 9.0), (2, float("nan"))], "label int, v double")
    got = {r.label: r for r in rg.intensity_stats(df.where(~F.isnan("v")), ["label"], "v", 5.0).collect()}
    assert (got[1].count_above, got[1].mean_above, got[1].median_above) == (0, None, None)
    assert (got[2].count_above, got[2].mean_above) == (1, 9.0) and got[1].std == 1.0


def flood(mask, eight):
    lab = np.zeros(mask.shape, int)
    k = 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or abs(a) + abs(b) == 1)]
    for start in zip(*np.nonzero(mask)):
        if lab[start]:
            continue
        k += 1
        todo = [start]
        lab[start] = k
        while todo:
            y, x = todo.pop()
            for a, b in steps:
                p = (y + a, x + b)
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not lab[p]:
                    lab[p] = k
                    todo.append(p)
    return lab


@pytest.mark.parametrize("eight", [False, True])
def test_components_across_tiles(spark, eight):
    rng = np.random.default_rng(11)
    mask = rng.random((33, 29)) < 0.55
    mask[16] = True  # one object runs through a whole row of tiles
    tiles = tl.to_tiles(image(spark, mask.astype(float)), 8)
    got = back(cp.label_components(tiles, 8, 4, eight), mask.shape, "label")
    want = flood(mask, eight)
    pairs = {(got[p], want[p]) for p in zip(*np.nonzero(mask))}
    assert len(pairs) == want.max() == len({a for a, _ in pairs})
    assert np.all(np.isnan(got[~mask]))


@pytest.mark.parametrize("eight", [False, True])
@pytest.mark.parametrize("fan", [2, 3, 8])
def test_components_of_images_merge_level_by_level(spark, monkeypatch, eight, fan):
    monkeypatch.setattr(cp, "FAN", fan)
    rng = np.random.default_rng(fan)
    masks = {"a": rng.random((43, 50)) < 0.52, "b": rng.random((20, 64)) < 0.6, "c": np.ones((9, 9), bool), "d": np.zeros((6, 6), bool)}
    masks["a"][20] = True
    rows = [(s, y, x, float(v)) for s, m in masks.items() for (y, x), v in np.ndenumerate(m)]
    tiles = tl.to_tiles(spark.createDataFrame(rows, "slide string, y long, x long, value double"), 5, ["slide"])
    got = cp.label_components(tiles, 5, 13, eight, ["slide"]).toPandas()
    for s, m in masks.items():
        own = got[got.slide == s]
        want = flood(m, eight)
        assert len(own) == m.sum()
        pairs = {(a, want[y, x]) for y, x, a in zip(own.y, own.x, own.label)}
        assert len(pairs) == want.max() == len({a for a, _ in pairs})
        for label, group in own.groupby("label"):
            assert label == min(1 + ((y // 5) * 13 + x // 5) * 25 + (y % 5) * min(5, m.shape[1] - x // 5 * 5) + x % 5 for y, x in zip(group.y, group.x))
    assert cp.label_components(tiles.limit(0), 5, 13, eight, ["slide"]).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id src", "id + 1 dst")
    assert {r.component for r in cp.connected_components(edges).collect()} == {0}


def test_spacing_equals_greedy(spark):
    rng = np.random.default_rng(4)
    xy = rng.integers(0, 60, (300, 2)).astype(float)
    xy[:80] = (30, 30)  # many at one place
    s = np.round(rng.random(300), 2)
    df = spark.createDataFrame([(i, float(s[i]), float(xy[i, 0]), float(xy[i, 1])) for i in range(300)], "id long, s double, x double, y double")
    got = {r.id for r in cp.spaced_peaks(df, "id", "s", 6.0).collect()}
    kept = []
    for i in sorted(range(300), key=lambda k: (-s[k], k)):
        if all(np.max(np.abs(xy[i] - xy[j])) > 6.0 for j in kept):
            kept.append(i)
    assert got == set(kept)
    assert cp.peaks_with_relaxed_spacing(df, "id", "s", 20, 14).count() == 20


def test_spots_found_where_they_are(spark):
    yy, xx = np.mgrid[:48, :48]
    where = [(10, 12), (15, 16), (30, 31), (40, 8)]  # one next to tile borders
    img = sum(100 * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / 4) for y, x in where)
    tiles = tl.to_tiles(image(spark, img), 16)
    got = {(r.Y, r.X) for r in kn.detect_spots(tiles, 16, 1.5, halo=12).collect()}
    assert set(where) <= got
    top = kn.detect_spots(tiles, 16, 1.5, halo=12).agg(F.max("LoG_intensity")).first()[0]
    assert top == 65535


def test_background_subtraction_flattens_and_stays_positive(spark):
    rng = np.random.default_rng(42)
    yy, xx = np.mgrid[:64, :64]
    img = 100 + yy + rng.poisson(2, (64, 64))
    img[30:33, 30:33] += 200
    out = back(tl.to_pixels(kn.subtract_background(tl.to_tiles(image(spark, img), 32), 32, 8.0), 32), img.shape)
    assert out.min() >= 0 and out[31, 31] > 150 and np.median(out) < 15 and xx.size == out.size
    with pytest.raises(ValueError):
        kn.subtract_background(tl.to_tiles(image(spark, img), 32), 32, 16.0)


def test_expand_labels_ties_take_the_smaller(spark):
    img = np.zeros((3, 7))
    img[1, 1], img[1, 5] = 9, 4
    got = back(tl.to_pixels(kn.expand_labels(tl.to_tiles(image(spark, img), 4), 4, 2), 4), img.shape)
    assert got[1, 3] == 4 and got[1, 2] == 9 and got[0, 0] == 9 and got[0, 3] == 0


def test_phase_shift_recovers_a_roll():
    rng = np.random.default_rng(0)
    a = rng.random((32, 32))
    dy, dx, err = kn.phase_shift(np.roll(a, (3, -5), (0, 1)), a)
    assert (dy, dx) == (3.0, -5.0) and err < 1e-6


def test_tissue_mask_keeps_the_textured_part(spark):
    rng = np.random.default_rng(1)
    img = np.zeros((40, 40))
    img[4:30, 4:30] = rng.integers(50, 1000, (26, 26))
    m = back(kn.tissue_mask(tl.to_tiles(image(spark, img), 20), 20, dilation=1, k=3).withColumn("t", F.col("tissue").cast("int")), img.shape, "t")
    assert m[12:24, 12:24].all() and not m[36:, 36:].any()


def test_tissue_masks_of_slides_are_those_of_single_images(spark):
    """Two channels a slide; one slide of a single value, which has no tissue and keeps its pixels."""
    rng = np.random.default_rng(4)
    slides = {s: [np.zeros((24, 20)) for _ in range(2)] for s in ("a", "b", "flat")}
    slides["a"][0][2:14, 2:14] = rng.integers(50, 900, (12, 12))
    slides["a"][1][2:14, 10:18] = rng.integers(50, 900, (12, 8))
    slides["b"][1][8:22, 3:19] = rng.integers(5, 90, (14, 16))
    rows = [(s, c, y, x, float(v)) for s, chans in slides.items() for c, img in enumerate(chans) for (y, x), v in np.ndenumerate(img)]
    px = spark.createDataFrame(rows, "slide string, c int, y long, x long, value double")
    got = kn.tissue_mask(tl.to_tiles(px, 10, ["slide", "c"]), 10, dilation=1, k=3, keys=["slide"], channel="c").toPandas()
    assert len(got) == 3 * 24 * 20
    for s, chans in slides.items():
        top = np.maximum(*chans)
        mine = got[got.slide == s].sort_values(["y", "x"])
        assert np.allclose(mine.value.to_numpy().reshape(top.shape), np.log1p(top))
        one = back(kn.tissue_mask(tl.to_tiles(image(spark, top), 10), 10, dilation=1, k=3).withColumn("t", F.col("tissue").cast("int")), top.shape, "t")
        assert np.array_equal(mine.tissue.to_numpy().astype(int).reshape(top.shape), one)
        assert one.any() == (s != "flat") and not one.all()


def test_channel_maximum_skips_nan_and_absent_channels(spark):
    tiles = spark.createDataFrame(
        [(0, 0, 1, 3, [1.0, float("nan"), None]), (0, 0, 1, 3, [0.0, 4.0, float("nan")]), (0, 1, 2, 1, [7.0, -2.0]), (5, 5, 0, 0, [])],
        "tile_row long, tile_col long, h int, w int, pixels array<double>")
    got = {(r.tile_row, r.tile_col): (r.h, r.w, r.pixels) for r in kn.channel_maximum(tiles).collect()}
    assert got == {(0, 0): (1, 3, [1.0, 4.0, 0.0]), (0, 1): (2, 1, [7.0, -2.0])}
    assert kn.channel_maximum(tiles.limit(0)).count() == 0


def test_cut_and_place_round_trip(spark):
    rng = np.random.default_rng(9)
    img = rng.integers(0, 99, (21, 17)).astype(float)
    cut = tl.cut_tiles(image(spark, img), 8, 0.25)
    placed = tl.place_tiles(cut.withColumns({"dy": F.col("tile_row") * 6, "dx": F.col("tile_col") * 6, "o": F.col("tile_row") * 100 + F.col("tile_col")}), "o")
    assert np.array_equal(back(placed, img.shape), img)


def test_pooling_borders(spark):
    img = np.arange(15, dtype=float).reshape(3, 5)
    assert tl.pool(image(spark, img), 2, "min").count() == 2
    mean = back(tl.pool(image(spark, img), 2), (2, 3))
    assert mean[1, 2] == 14 / 4 and mean[0, 0] == (0 + 1 + 5 + 6) / 4


def plain_spots(resp):
    """First pixels of the straight parts of plateaus without a higher neighbour, the first row and column left out."""
    h, w = resp.shape
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    inside = lambda p: 0 <= p[0] < h and 0 <= p[1] < w

    def spread(start, steps):
        seen, todo = {start}, [start]
        while todo:
            y, x = todo.pop()
            for a, b in steps:
                q = (y + a, x + b)
                if inside(q) and q not in seen and resp[q] == resp[start]:
                    seen.add(q)
                    todo.append(q)
        return seen

    out = set()
    for p in ((y, x) for y in range(h) for x in range(w)):
        edge = [(y + a, x + b) for y, x in spread(p, around) for a, b in around]
        values = {resp[q] for q in edge if inside(q)}
        if max(values) <= resp[p] and min(values) < resp[p] and p == min(spread(p, [s for s in around if 0 in s])):
            out.add(p)
    return {p for p in out if p[0] and p[1]}


@pytest.mark.parametrize("sigma", [0.0, 0.7])
def test_spots_on_plateaus_across_tiles(spark, sigma):
    rng = np.random.default_rng(8)
    img = rng.integers(0, 3, (22, 19)).astype(float)
    img[3:20, 3:17] = 1
    img[9, 2:18] = 5  # a ridge through several tiles, ended by a higher pixel
    img[9, 17] = 6
    img[13, 4:15], img[14:18, 4], img[14:18, 14] = 4, 4, 4  # a U
    tiles = tl.to_tiles(image(spark, img), 6)
    got = [(r.Y, r.X) for r in kn.spot_candidates(tiles, 6, sigma).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_spots(kn.log_response(img, sigma))
    assert kn.spot_candidates(tl.to_tiles(image(spark, np.ones((7, 7))), 3), 3, sigma).count() == 0
    with pytest.raises(ValueError, match="halo"):
        kn.spot_candidates(tiles, 6, 3.0, halo=4)


def test_relaxed_spacing_per_key(spark):
    df = spark.createDataFrame([(k, i, float(-i), float(i * (1 + k)), 0.0) for k in range(2) for i in range(6)], "k int, id int, s double, x double, y double")
    got = cp.peaks_with_relaxed_spacing(df, "id", "s", 2, 5, keys=["k"]).collect()  # 4 is the first spacing that gives both keys two
    assert {k: sorted(r.id for r in got if r.k == k) for k in range(2)} == {0: [0, 5], 1: [0, 3]}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_spacing_leaves_out_what_has_no_place(spark, keys):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 5.0, 0.0, 0.0, "a"), (2, 9.0, None, 0.0, "a"), (3, 9.0, nan, 0.0, "a"), (4, 9.0, 0.0, inf, "a"), (None, 9.0, 50.0, 50.0, "a"),
            (5, None, 70.0, 70.0, "a"), (6, nan, 90.0, 90.0, "a"), (7, 1.0, 1.0, 1.0, "a"), (8, 2.0, 30.0, 0.0, "a"), (8, 2.0, 30.0, 0.0, "a")]
    rows += [(9, 9.0, 200.0, 0.0, None)] if keys else []
    df = spark.createDataFrame(rows, "id long, s double, x double, y double, k string")
    assert sorted(r.id for r in cp.spaced_peaks(df, "id", "s", 6.0, keys=keys).collect()) == [1, 8]
    assert cp.peaks_with_relaxed_spacing(df, "id", "s", 2, 20.0, keys=keys).count() == 2
    assert cp.spaced_peaks(df.limit(0), "id", "s", 6.0, keys=keys).count() == 0
    with pytest.raises(ValueError):
        cp.spaced_peaks(df, "id", "s", 0.0)


def greedy(rows, spacing):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(max(abs(r[2] - q[2]), abs(r[3] - q[3])) > spacing for q in kept):
            kept.append(r)
    return {r[0] for r in kept}


@pytest.mark.parametrize("most", [40, 200_000])
def test_spacing_by_tiles_equals_greedy(spark, monkeypatch, most):
    monkeypatch.setattr(cp, "TILE_POINTS", most)
    monkeypatch.setattr(cp, "WINNER_ROUNDS", 0)
    rng = np.random.default_rng(most)
    rows = []
    for key in ("a", "b"):
        xy = np.concatenate([rng.integers(-40, 40, (150, 2)) * 1.0, rng.random((100, 2)) * 60, np.full((60, 2), 7.0)])
        xy = np.concatenate([xy, np.column_stack([np.arange(90) * 2.5, np.arange(90) * 0.5])])
        s = np.concatenate([np.round(rng.random(310), 1), 1 - np.arange(90) / 90])
        rows += [(k, float(s[k]), float(xy[k, 0]), float(xy[k, 1]), key) for k in range(400)]
    got = cp.spaced_peaks(spark.createDataFrame(rows, "id long, s double, x double, y double, k string"), "id", "s", 3.0, keys=["k"]).collect()
    for key in ("a", "b"):
        assert {r.id for r in got if r.k == key} == greedy([r for r in rows if r[4] == key], 3.0)


def test_a_long_ramp_takes_few_rounds(spark, monkeypatch):
    turns = []
    whole = cp.kept_in_tiles
    monkeypatch.setattr(cp, "kept_in_tiles", lambda *a: turns.append(1) or whole(*a))
    ramp = spark.range(100_000).selectExpr("id", "-id * 1.0D s", "id * 0.6D x", "0.0D y")
    got = cp.spaced_peaks(ramp, "id", "s", 1.0)
    assert got.agg(F.count("*"), F.sum("id")).first() == (50_000, 50_000 * 49_999) and got.where("id % 2 = 1").isEmpty()
    assert len(turns) <= 4


def disk_offsets(r):
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]


@pytest.mark.parametrize("radius", [0, 1, 2, 7, 30])
@pytest.mark.parametrize("how", [np.maximum, np.minimum])
def test_disk_filter_equals_all_offsets(radius, how):
    img = np.random.default_rng(radius).integers(0, 50, (33, 41)).astype(float)
    big = np.pad(img, radius, mode="symmetric")
    want = how.reduce([big[radius + a:radius + a + 33, radius + b:radius + b + 41] for a, b in disk_offsets(radius)])
    assert np.array_equal(kn.disk_filter(img, radius, how), want)


@pytest.mark.parametrize("distance", [1, 2, 5, 40])
@pytest.mark.parametrize("share", [0.0, 0.004, 0.05, 0.6])
def test_grown_labels_are_the_nearest_then_smallest(distance, share):
    rng = np.random.default_rng(3)
    img = np.where(rng.random((37, 29)) < share, rng.integers(1, 9, (37, 29)), 0).astype(float)
    at = np.argwhere(img > 0)
    want = img.copy()
    for y, x in np.argwhere(img == 0):
        near = sorted(((a - y) ** 2 + (b - x) ** 2, img[a, b]) for a, b in at)
        if near and near[0][0] <= distance * distance:
            want[y, x] = near[0][1]
    assert np.array_equal(kn.grow_labels(img, distance), want)


@pytest.mark.parametrize(("k", "cells"), [(1, 1 << 24), (3, 1 << 24), (5, 40), (9, 1000)])
def test_moving_histograms_give_the_entropy_of_each_window(k, cells):
    rng = np.random.default_rng(k)
    img = rng.integers(0, 6, (14, 17)).astype(float)
    img[:, :2] = np.nan
    img[3, 5] = np.nan
    got = kn.window_entropy(img, k, cells)
    big = np.pad(img, k // 2, constant_values=np.nan)
    for y in range(14):
        for x in range(17):
            v = big[y:y + k, x:x + k].ravel()
            c = np.unique(v[~np.isnan(v)], return_counts=True)[1]
            assert np.isclose(got[y, x], -(c / c.sum() * np.log2(c / c.sum())).sum() if len(c) else 0.0, atol=1e-9)


@pytest.mark.parametrize("pad", [((2, 0), (0, 3)), ((9, 9), (9, 9)), ((0, 0), (0, 0))])
def test_absent_borders_are_mirrored_like_padding(pad):
    img = np.random.default_rng(2).normal(size=(4, 5))
    there = np.pad(np.ones(img.shape, bool), pad)
    assert np.array_equal(tl.mirror_absent(np.pad(img, pad), there), np.pad(img, pad, mode="symmetric"))


def test_absent_tiles_are_mirrored_for_every_tile(spark):
    """Tiles of 4 x 4, the last row holds one of three: no absent pixel counts as zero."""
    img = np.random.default_rng(3).integers(5, 90, (8, 12)).astype(float)
    rows = [(r, c, 4, 4, img[4 * r:4 * r + 4, 4 * c:4 * c + 4].ravel().tolist()) for r, c in ((0, 0), (0, 1), (0, 2), (1, 0))]
    t = spark.createDataFrame(rows, "tile_row long, tile_col long, h int, w int, pixels array<double>")
    there = np.ones(img.shape, bool)
    there[4:, 4:] = False
    least = {(r.y, r.x): r.value for r in tl.to_pixels(tl.map_tiles(t, 4, 1, lambda b: kn.rank_filter(b, kn.AROUND, np.minimum)), 4).collect()}
    assert len(least) == there.sum() and min(least.values()) >= 5
    at = lambda y, x, own: img[y, x] if 0 <= y < 8 and 0 <= x < 12 and there[y, x] else own
    want = {(y, x): 4 * img[y, x] - sum(at(y + a, x + b, img[y, x]) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) for y, x in zip(*np.nonzero(there))}
    got = {(r.Y, r.X): r._LoG_intensity for r in kn.spot_candidates(t, 4, 0.0).collect()}
    peaks = {(y, x) for y, x in want if y and x and all(want.get((y + a, x + b), -np.inf) < want[y, x] for a, b in kn.AROUND)}
    assert peaks <= set(got) and all(got[p] == want[p] for p in got)

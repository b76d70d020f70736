import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import affine as af
from cellweave.functions import geometry as geo
from cellweave.operators import covering as cv
from cellweave.operators import neighbourhood as nb
from cellweave.operators import permutation as pm
from cellweave.operators import spatial as sp
from cellweave.plans import shapes as sh


def frame(spark, xy, cls=None):
    data = [(i, float(x), float(y), (cls[i] if cls else "a")) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(data, "id long, x double, y double, c string")


def brute_knn(a, b, k, exclude):
    out = set()
    for i, p in enumerate(a):
        d = sorted((float((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), j) for j, q in enumerate(b) if not (exclude and i == j))
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(d[:k])}
    return out


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    tight = rng.normal(0, 1e-3, (n // 2, 2))
    wide = rng.uniform(-50, 50, (n // 4, 2))
    copies = np.repeat([[7.0, 7.0]], n // 4, axis=0)
    return np.concatenate([tight, wide, copies])


@pytest.mark.parametrize("chunk", [20_000, 5])
def test_knn_on_clusters_and_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(sp, "CHUNK", chunk)
    xy = clustered(3, 240)
    got = sp.nearest_neighbours(frame(spark, xy), frame(spark, xy), 4, "id", "id", exclude_self=True)
    assert {(r.src, r.dst, r["rank"]) for r in got.collect()} == brute_knn(xy, xy, 4, True)


def test_knn_between_sets_far_apart_and_too_few_targets(spark):
    a, b = clustered(1, 80), clustered(2, 40) + 1000
    got = sp.nearest_neighbours(frame(spark, a), frame(spark, b), 3, "id", "id")
    assert {(r.src, r.dst, r["rank"]) for r in got.collect()} == brute_knn(a, b, 3, False)
    few = sp.nearest_neighbours(frame(spark, a[:5]), frame(spark, b[:2]), 3, "id", "id")
    assert few.count() == 10
    none = sp.nearest_neighbours(frame(spark, a[:5]), frame(spark, b).where("false"), 3, "id", "id")
    assert none.count() == 0


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_radius_neighbours(spark, monkeypatch, chunk):
    monkeypatch.setattr(sp, "CHUNK", chunk)
    xy = clustered(5, 120)
    got = {(r.src, r.dst) for r in sp.radius_neighbours(frame(spark, xy), 2.0, "id").collect()}
    want = {(i, j) for i in range(len(xy)) for j in range(len(xy)) if i != j and np.hypot(*(xy[i] - xy[j])) <= 2.0}
    assert got == want


def test_composition_keeps_lonely_cells(spark):
    pts = frame(spark, [(0, 0), (0, 0), (0.5, 0), (9, 9)], ["a", "b", "a", "b"])
    got = {r.id: r for r in nb.composition(pts, 1.0, "id", "c", ["a", "b"]).collect()}
    assert (got[0].n_a, got[0].n_b, got[0].f_a) == (1, 1, 0.5)
    assert (got[3].n_a, got[3].n_b, got[3].f_a) == (0, 0, None)


def test_permutations_are_one_to_one_and_differ():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        seen = [tuple(pm.permuted(np.arange(n), n, 3, p)) for p in range(1, 6)]
        assert all(sorted(s) == list(range(n)) for s in seen)
        assert n < 64 or len(set(seen)) == 5


def brute_enrichment(xy, cls, radius, perms, seed):
    order = sorted(range(len(xy)), key=lambda k: (xy[k][0], xy[k][1], k))
    names = sorted(cls)
    labels = [list(cls)]
    for p in range(1, perms + 1):
        to = pm.permuted(np.arange(len(xy)), len(xy), seed, p)
        labels.append([None] * len(xy))
        for rank, k in enumerate(order):
            labels[p][k] = names[to[rank]]
    counts = {}
    for i in range(len(xy)):
        for j in range(len(xy)):
            if i != j and np.hypot(*(xy[i] - xy[j])) <= radius:
                for p in range(perms + 1):
                    row = counts.setdefault((labels[p][i], labels[p][j]), np.zeros(perms + 1))
                    row[p] += 1
    return {k: (v[0], v[1:].mean(), v[1:].std()) for k, v in counts.items()}


@pytest.mark.parametrize(("crowd", "pairs"), [(4096, 20_000), (3, 7)])
def test_enrichment_equals_brute_force_by_slide(spark, monkeypatch, crowd, pairs):
    monkeypatch.setattr(pm, "CROWD", crowd)
    monkeypatch.setattr(pm, "PAIRS", pairs)
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 4, (90, 2))
    xy[30:45] = xy[0]
    cls = [str(v) for v in rng.integers(0, 3, 90)]
    pts = frame(spark, xy, cls).withColumn("slide", (F.col("id") >= 60).cast("string"))
    odd = spark.createDataFrame([(200, None, 0.0, "a", "false"), (201, float("nan"), 0.0, "a", "false"), (202, 1.0, 1.0, None, "false"), (203, 1.0, 1.0, "a", None)],
                                "id long, x double, y double, c string, slide string")
    got = pm.enrichment(pts.unionByName(odd).repartition(5), 1.0, "c", perms=12, seed=4, by=["slide"]).collect()
    for slide, a, b in (("false", 0, 60), ("true", 60, 90)):
        want = brute_enrichment(xy[a:b], cls[a:b], 1.0, 12, 4)
        mine = {(r.class_src, r.class_dst): r for r in got if r.slide == slide}
        assert set(mine) == set(want)
        for k, (n, mean, std) in want.items():
            assert mine[k].n == n and np.isclose(mine[k]["mean"], mean) and np.isclose(mine[k]["std"], std, atol=1e-9)
            assert std == 0 or np.isclose(mine[k].z, (n - mean) / std)
    assert pm.enrichment(pts.limit(0), 1.0, "c", perms=3).count() == 0


def test_permuted_counts_agree_with_their_expectation(spark):
    rng = np.random.default_rng(1)
    xy, cls = rng.uniform(0, 10, (400, 2)), ["a"] * 280 + ["b"] * 120
    got = {(r.class_src, r.class_dst): r for r in pm.enrichment(frame(spark, xy, cls), 1.0, "c", perms=200, seed=9).collect()}
    pairs = sum(r.n for r in got.values())
    for (c, d), r in got.items():
        n = {"a": 280, "b": 120}
        expected = pairs * n[c] * (n[d] - (c == d)) / (400 * 399)
        assert abs(r["mean"] - expected) < 5 * r["std"] / np.sqrt(200)


SHAPES = [
    (1, "p", "in", "Polygon", "0,0 10,0 10,10 5,5 0,10", None, None, -1.0, -1.0, None, None),
    (2, "r", "exclude me", "Rectangle", None, 2.0, 2.0, -1.0, -1.0, 3.0, 3.0),
    (3, "e", "in", "Ellipse", None, 20.0, 20.0, 4.0, 2.0, None, None),
    (4, "t", "in", "Point", None, 1.0, 1.0, -1.0, -1.0, None, None),
]


def shapes(spark):
    return sp.normalise_rois(spark.createDataFrame(
        SHAPES, "Id long, Name string, Text string, type string, all_points string, X double, Y double, RadiusX double, RadiusY double, Width double, Height double"))


def test_points_in_shapes(spark):
    pts = frame(spark, [(1, 1), (3, 3), (5, 8), (20, 21.9), (24.1, 20), (0, 0), (10, 5)])
    got = {(r.id, r.roi_id) for r in sp.points_in_shapes(pts, shapes(spark), 3.0).collect()}
    # the lower left corner belongs to the polygon, the right border does not
    assert got == {(0, 1), (1, 1), (1, 2), (3, 3), (5, 1)}
    hits = sp.points_in_shapes(pts, shapes(spark), 3.0)
    sel = sp.include_exclude(pts, hits, "id", F.col("roi_text").contains("exclude"))
    assert {r.id for r in sel.where("selected").collect()} == {0, 3, 5}


def test_point_strings(spark):
    df = spark.createDataFrame([("1,2 -3.5,4",), ("",), (None,)], "t string")
    got = [r.p for r in df.select(geo.parse_points(F.col("t")).alias("p")).collect()]
    assert [(p.x, p.y) for p in got[0]] == [(1.0, 2.0), (-3.5, 4.0)]
    assert not got[1]
    legacy = df.select(geo.parse_points(F.col("t"), strict_legacy=True).alias("p")).first().p
    assert len(legacy) == 0  # single digits are lost there


def test_affine_round_trip_and_associativity(spark):
    rng = np.random.default_rng(7)
    mats = [af.affine(*rng.normal(size=6)) for _ in range(3)]
    a, b, c = mats
    left, right = af.compose(af.compose(a, b), c), af.compose(a, af.compose(b, c))
    df = spark.createDataFrame([(1.5, -2.0), (0.0, 0.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    r = df.select(
        x, y, af.apply_x(left, x, y).alias("l"), af.apply_x(right, x, y).alias("r"),
        af.apply_x(af.compose(af.inverse(a), a), x, y).alias("bx"), af.apply_y(af.compose(af.inverse(a), a), x, y).alias("by")).collect()
    for v in r:
        assert np.isclose(v.l, v.r) and np.isclose(v.bx, v.x) and np.isclose(v.by, v.y)


def test_flip_and_rotation_keep_the_image_frame(spark):
    df = spark.createDataFrame([(0.0, 0.0), (30.0, 20.0)], "x double, y double")
    for k in range(4):
        m = af.rotate90(20.0, 30.0, k)
        pts = df.select(af.apply_x(m, F.col("x"), F.col("y")).alias("x"), af.apply_y(m, F.col("x"), F.col("y")).alias("y")).collect()
        assert {v for p in pts for v in p} <= {0.0, 20.0, 30.0}
    four = af.chain([af.rotate90(20.0, 30.0, 1), af.rotate90(30.0, 20.0, 3)])
    p = df.select(af.apply_x(four, F.col("x"), F.col("y")).alias("x"), af.apply_y(four, F.col("x"), F.col("y")).alias("y")).collect()
    assert [(v.x, v.y) for v in p] == [(0.0, 0.0), (30.0, 20.0)]


def test_ellipse_angle_keeps_sign(spark):
    pt = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    e = spark.range(1).select(geo.ellipse_from_axes(F.array(pt(0, 0), pt(4, -4), pt(1, -3), pt(3, -1))).alias("e")).first().e
    assert (e.cx, e.cy) == (2.0, -2.0) and np.isclose(e.angle, -45.0)


@pytest.mark.parametrize("far", [64, 0])
def test_knn_by_descent_equals_brute_force(spark, monkeypatch, far):
    monkeypatch.setattr(sp, "FAR", far)
    a, b = clustered(5, 80), clustered(6, 400) + 1000
    got = sp.nearest_neighbours(frame(spark, a), frame(spark, b), 2, "id", "id")
    assert {(r.src, r.dst, r["rank"]) for r in got.collect()} == brute_knn(a, b, 2, False)
    mixed = sp.nearest_neighbours(frame(spark, b), frame(spark, b), 3, "id", "id", exclude_self=True)
    assert {(r.src, r.dst, r["rank"]) for r in mixed.collect()} == brute_knn(b, b, 3, True)


def test_knn_between_far_sets_hands_on_few_targets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a = rng.uniform(0, 900, (60, 2)).round(1)
    b = np.stack([1e6 + rng.uniform(0, 500, 3000).round(), rng.uniform(0, 20_000, 3000).round()], axis=1)
    b[:40] = [1e6, 400]  # a pile of copies among the nearest
    handed, descent = [], sp._descent

    def counted(*args):
        handed.append(descent(*args))
        return handed[-1]

    monkeypatch.setattr(sp, "_descent", counted)
    got = sp.nearest_neighbours(frame(spark, a), frame(spark, b), 3, "id", "id")
    assert {(r.src, r.dst, r["rank"]) for r in got.collect()} == brute_knn(a, b, 3, False)
    assert handed[0].count() <= 60 * 3 * 3  # before, each source asked for the cells of a band along all targets
    b = np.stack([1e6 + 0 * b[:, 0], 10 * (b[:, 1] // 10)], axis=1)  # equal distances on both sides
    a[:, 1] = 10_000 + 5 * (a[:, 1] // 5)
    got = sp.nearest_neighbours(frame(spark, a), frame(spark, b), 3, "id", "id")
    assert {(r.src, r.dst, r["rank"]) for r in got.collect()} == brute_knn(a, b, 3, False)


def test_shapes_and_distances_stay_on_their_slide(spark):
    pts = frame(spark, [(1, 1), (1, 1), (3, 3)], ["a", "b", "a"]).withColumn("slide", F.col("id") % 2)
    rois = spark.createDataFrame([(*s, 1) for s in SHAPES], "Id long, Name string, Text string, type string, all_points string, X double, Y double, "
                                 "RadiusX double, RadiusY double, Width double, Height double, slide long")
    hits = sp.points_in_shapes(pts, sp.normalise_rois(rois, ["slide"]), 3.0, by=["slide"])
    assert [(r.id, r.roi_id) for r in hits.collect()] == [(1, 1)]
    got = {(r.id, r.to_class): r.dist for r in nb.class_distances(pts, "id", "c", ["a", "b"], by=["slide"]).collect()}
    assert got == {(0, "a"): np.sqrt(8), (0, "b"): None, (1, "a"): None, (1, "b"): None, (2, "a"): np.sqrt(8), (2, "b"): None}


def star(n, cx, cy, far, close):
    turn = np.linspace(0, 2 * np.pi, 2 * n, endpoint=False)
    r = np.where(np.arange(2 * n) % 2, close, far)
    return cx + r * np.cos(turn), cy + r * np.sin(turn)


def inside(kind, box, ring, px, py):
    x0, y0, x1, y1 = box
    within = (px >= x0) & (px <= x1) & (py >= y0) & (py <= y1)
    if kind == "rectangle":
        return within
    if kind == "ellipse":
        return ((px - (x0 + x1) / 2) / ((x1 - x0) / 2)) ** 2 + ((py - (y0 + y1) / 2) / ((y1 - y0) / 2)) ** 2 <= 1
    odd = np.zeros(len(px), dtype=bool)
    for ax, ay, bx, by in zip(*ring, np.roll(ring[0], -1), np.roll(ring[1], -1)):
        if ay != by:
            odd ^= ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    return within & odd


@pytest.mark.parametrize("kind", ["polygon", "bow", "rectangle", "ellipse", "sliver"])
@pytest.mark.parametrize("cell", [0.01, 1.0, 300.0])
def test_covering_is_exact_and_small(kind, cell):
    rng = np.random.default_rng(4)
    ring = {"polygon": star(9, -3.0, 11.0, 90.0, 30.0), "bow": (np.array([0.0, 50, 0, 50]), np.array([0.0, 50, 50, 0])),
            "sliver": (np.array([0.0, 80, 80.001]), np.array([0.0, 80, 80]))}.get(kind)
    box = [ring[0].min(), ring[1].min(), ring[0].max(), ring[1].max()] if ring else [-20.0, -7.5, 44.0, 13.0]
    cells = cv.cover(kind, box, ring, cell)
    assert sum(len(cx) for _, cx, _, _ in cells) <= 4000
    px, py = rng.uniform(box[0] - 9, box[2] + 9, 6000), rng.uniform(box[1] - 9, box[3] + 9, 6000)
    want = inside(kind, box, ring, px, py)
    hit, sure = np.zeros(6000, dtype=int), np.zeros(6000, dtype=bool)
    for level, cx, cy, inner in cells:
        side = cell * 2.0 ** level
        at = {(a, b): s for a, b, s in zip(cx, cy, inner, strict=True)}
        for k, c in enumerate(zip(np.floor(px / side).astype(int), np.floor(py / side).astype(int), strict=True)):
            if c in at:
                hit[k] += 1
                sure[k] |= at[c]
    assert hit.max() <= 1 and not (want & (hit == 0)).any() and not (sure & ~want).any()
    if cell < 1 and kind != "sliver":
        assert sure.sum() > 0.5 * want.sum()


def test_a_shape_of_many_cells_against_many_points(spark):
    """100,000 cells a side, points in copies, two slides; nothing is made for the cells without points."""
    ring = star(40, 5e4, 5e4, 5e4, 2e4)
    text = " ".join(f"{a:.3f},{b:.3f}" for a, b in zip(*ring, strict=True))
    ring = tuple(np.array([float(p.split(",")[k]) for p in text.split()]) for k in (0, 1))
    rois = spark.createDataFrame([(1, "s", "in", "Polygon", text, None, None, -1.0, -1.0, None, None, 1)], "Id long, Name string, Text string, type string, "
                                 "all_points string, X double, Y double, RadiusX double, RadiusY double, Width double, Height double, slide long")
    pts = spark.range(100_000).selectExpr("id", "id % 3 as slide", "(id * 7919 % 100003) * 1D as x", "(id div 5 * 104729 % 99991) * 1D as y")
    pts = pts.unionByName(spark.createDataFrame([(-1, 1, None, 1.0), (-2, 1, float("nan"), 1.0), (-3, 1, 5e4, 5e4), (-4, None, 5e4, 5e4)], "id long, slide long, x double, y double"))
    got = {r.id for r in sp.points_in_shapes(pts, sp.normalise_rois(rois, ["slide"]), 1.0, by=["slide"]).select("id").collect()}
    pdf = pts.where("slide = 1 and x is not null and not isnan(x)").toPandas()
    want = inside("polygon", [ring[0].min(), ring[1].min(), ring[0].max(), ring[1].max()], ring, pdf["x"].to_numpy(), pdf["y"].to_numpy())
    assert got == set(pdf["id"][want]) and len(got) > 5000


@pytest.mark.parametrize("most", [4_000_000, 10])
def test_shapes_are_moved_once_for_a_pair_of_images(spark, monkeypatch, most):
    monkeypatch.setattr(sh, "MOST", most)
    manifest = spark.createDataFrame([(i, i % 2, 7 if i < 9 else 8) for i in range(12)] + [(99, 5, 7)], "row_num long, image_id_1 long, image_id_2 long")
    move = spark.createDataFrame([(0, 7), (1, 7), (5, 7)], "image_id_1 long, image_id_2 long").withColumn("m", af.scale(2.0))
    p = F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")))
    marks = spark.range(30).select((F.col("id") % 3).alias("image_id"), F.col("id").alias("shape"), p.alias("pts"), af.translate(1.0, 0.0).alias("own"))
    mapped, status = sh.map_shapes(manifest, move, marks)
    got = sorted((r.row_num, r.image_id_2, r["shape"], r.pts[0].x, r.pts[0].y) for r in mapped.collect())
    assert got == sorted((i, 7, k, 2.0 * (k + 1), 2.0) for i in range(9) for k in range(30) if k % 3 == i % 2)
    assert {(r.row_num, r.success, r.shapes) for r in status.collect()} == {(i, i < 9, 10 if i < 9 else 0) for i in range(12)} | {(99, True, 0)}


def test_status_of_many_rows_and_shapes_of_one_image(spark):
    """400 million mapped rows, of which the status needs none."""
    manifest = spark.range(20_000).selectExpr("id row_num", "1 image_id_1", "2 image_id_2")
    move = spark.range(1).selectExpr("1 image_id_1", "2 image_id_2").withColumn("m", af.identity())
    p = F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")))
    _, status = sh.map_shapes(manifest, move, spark.range(20_000).select(F.lit(1).alias("image_id"), p.alias("pts")))
    assert "pts" not in status._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in status.groupBy("success", "shapes").count().collect()] == [(True, 20_000, 20_000)]


@pytest.mark.parametrize("small", [100_000, 0])
@pytest.mark.parametrize("cell", [0.25, 3.0])
def test_copies_of_a_shape_are_searched_once(spark, monkeypatch, small, cell):
    monkeypatch.setattr(sp, "SMALL", small)
    rng = np.random.default_rng(8)
    pts = frame(spark, rng.uniform(-1, 26, (400, 2)))
    one = shapes(spark)
    many = one.unionByName(one.withColumn("Id", F.col("Id") + 100)).unionByName(one.withColumns({"Id": F.col("Id") + 200, "Text": F.lit("exclude")}).where("Id = 203"))
    distinct, members = sp.outlines(many)
    assert distinct.count() == one.count() and members.count() == many.count()
    got = {(r.id, r.roi_id) for r in sp.points_in_shapes(pts, many, cell).collect()}
    alone = {(r.id, r.roi_id) for r in sp.points_in_shapes(pts, one, cell).collect()}
    assert alone and got == alone | {(i, k + 100) for i, k in alone} | {(i, 203) for i, k in alone if k == 3}
    hits = sp.points_in_shapes(pts, many, cell)
    want = sp.include_exclude(pts, hits, "id", F.col("roi_text").contains("exclude")).select("id", "selected").collect()
    picked = sp.select_by_shapes(pts, many, cell, "id", F.col("Text").contains("exclude")).select("id", "selected").collect()
    assert sorted(picked) == sorted(want) and {r.selected for r in picked} == {True, False}


def crowd(spark, n=150, points=20_000):
    """Shapes of different outline that lie over each other, points at different places, three slides."""
    c = lambda k: f"round(id * 0.17D + {k}, 4)"
    rois = spark.range(n).selectExpr(
        "id Id", "if(id % 4 = 0, null, concat('n', id)) Name", "if(id % 5 = 0, 'exclude', 'include') Text", "element_at(array('Polygon', 'Rectangle', 'Ellipse'), cast(id % 3 + 1 as int)) type",
        f"concat({c(0)}, ',', {c(0)}, ' ', {c(9)}, ',', {c(1)}, ' ', {c(4)}, ',', {c(8)}) all_points", f"{c(0)} X", f"{c(0)} / 2 Y", "if(id % 3 = 2, 5.0D, -1.0D) RadiusX",
        "if(id % 3 = 2, 3.0D, -1.0D) RadiusY", "6.0D Width", "4.0D Height", "id % 3 slide")
    pts = spark.range(points).selectExpr("id", "id % 3 slide", "(id * 7919 % 100003) * 35 / 100003D x", "(id * 104729 % 99991) * 30 / 99991D y")
    return pts, rois


def crowd_hits(pts, rois, slides=False):
    p, out = pts.toPandas(), set()
    for r in sp.normalise_rois(rois, ["slide"]).toPandas().to_dict("records"):
        ring = None if r["kind"] in ("ellipse", "rectangle") else tuple(np.array([q[c] for q in r["pts"]]) for c in "xy")
        hit = inside(r["kind"], [r[c] for c in ("x0", "y0", "x1", "y1")], ring, p["x"].to_numpy(), p["y"].to_numpy())
        out |= {(i, r["Id"]) for i in p["id"][hit & ((p["slide"] == r["slide"]).to_numpy() | (not slides))]}
    return out


def test_coarse_cells_leave_few_points_to_test(spark):
    pts, rois = crowd(spark)
    want = crowd_hits(pts, rois)
    distinct, _ = sp.outlines(sp.normalise_rois(rois))
    placed, near = sp.near_outlines(pts, distinct, 4.0, "x", "y", [])
    assert placed.join(near.where("not inner"), ["_gx", "_gy"]).count() < 0.6 * len(want)  # before, each hit and some more
    got = {(r.id) for r in sp.select_by_shapes(pts, sp.normalise_rois(rois), 4.0, "id", F.col("Text") == "exclude").where("selected").collect()}
    out = {i for i, k in want if k % 5 == 0}
    assert got and got == {i for i, k in want} - out


@pytest.mark.parametrize("small", [100_000, 0])
@pytest.mark.parametrize("corners", [16, 2])
def test_triangles_are_tested_without_a_loop(spark, monkeypatch, corners, small):
    monkeypatch.setattr(sp, "CORNERS", corners)
    monkeypatch.setattr(sp, "SMALL", small)
    monkeypatch.setattr(sp, "MADE", 1_000 if small == 0 else 40_000_000)
    pts, rois = crowd(spark, points=3_000)
    hits = sp.points_in_shapes(pts, sp.normalise_rois(rois), 4.0)
    assert ("aggregate(" in hits._jdf.queryExecution().optimizedPlan().toString()) == (corners == 2)  # before, in any case
    rows = hits.collect()
    assert sorted((r.id, r.roi_id) for r in rows) == sorted(crowd_hits(pts, rois))
    assert all(r.roi_name == (None if r.roi_id % 4 == 0 else f"n{r.roi_id}") and r.roi_text == ("exclude" if r.roi_id % 5 == 0 else "include") for r in rows)


def test_selection_moves_points_once(spark):
    pts, rois = crowd(spark, points=3_000)
    odd = spark.createDataFrame([(0, 0, 34.0, 1.0), (0, 0, 34.0, 1.0), (None, 0, 5.0, 4.0), (4, None, 5.0, 4.0), (6, 0, float("nan"), 1.0), (9, 0, None, None)], "id long, slide long, x double, y double")
    pts, shapes = pts.unionByName(odd), sp.normalise_rois(rois, ["slide"])
    picked = sp.select_by_shapes(pts, shapes, 4.0, ["slide", "id"], F.col("Text") == "exclude", by=["slide"])
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join LeftOuter, .*\bid#", plan) and "Window" in plan  # before, points were sorted and joined with a list of keys
    hits = sp.points_in_shapes(pts, shapes, 4.0, by=["slide"])
    per = hits.groupBy("slide", "id").agg(F.bool_or(F.col("roi_text") != "exclude").alias("i"), F.bool_or(F.col("roi_text") == "exclude").alias("e"))
    want = pts.join(per, ["slide", "id"], "left").selectExpr("slide", "id", "x", "y", "coalesce(i and not e, false) selected")
    text = lambda df: sorted(map(str, df.select("slide", "id", "x", "y", "selected").collect()))
    assert text(picked) == text(want) and picked.where("selected").count() > 100
    sel = sp.include_exclude(pts, hits, ["slide", "id"], F.col("roi_text") == "exclude")
    assert text(sel) == text(want)


def test_columns_of_shapes_are_made_once_for_a_pair_of_images(spark):
    manifest = spark.range(50).selectExpr("id row_num", "1 image_id_1", "2 image_id_2")
    move = spark.range(1).selectExpr("1 image_id_1", "2 image_id_2").withColumn("m", af.scale(2.0))
    p = F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y")))
    marks = spark.range(30).select(F.lit(1).alias("image_id"), F.col("id").alias("shape"), p.alias("pts"))
    mapped, _ = sh.map_shapes(manifest, move, marks, made=["shape", F.round(F.col("pts")[0].x, 1).alias("x0")])
    assert "round(" not in mapped._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.row_num, r["shape"], r.x0) for r in mapped.select("row_num", "shape", "x0").collect()) == [(i, k, 2.0 * k) for i in range(50) for k in range(30)]


def test_the_plan_maps_whole_shapes_without_rounding_each_row(spark, tmp_path):
    from bindings import plans_q

    spark.range(40).selectExpr("id c_custkey", "cast(id % 3 as int) c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(9).selectExpr("id s_suppkey", "cast(id % 3 as int) s_nationkey", "id / 7D s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    mapped = plans_q.plan_shapes(spark, str(tmp_path))
    assert mapped.count() == 3 * sum(i % 7 != 3 for i in range(40))
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan  # before, each mapped row was rounded


@pytest.mark.parametrize("copies", [1, 3])
def test_locations_ask_few_cells(spark, monkeypatch, copies):
    """Rows that move for edges: four cells a location and its copies for the chunks of its own cell, not nine cells times chunks."""
    monkeypatch.setattr(sp, "PAIRED", 40)
    rng = np.random.default_rng(5)
    xy = np.repeat(rng.normal(0, 0.125, (400, 2)), copies, axis=0)
    moved, spread = [], sp.spread_by_number
    monkeypatch.setattr(sp, "spread_by_number", lambda df, keys: moved.append(df) or spread(df, keys))
    far = frame(spark, [(np.inf, 0), (np.inf, 0), (0, -np.inf), (1e300, 0)]).withColumn("id", F.col("id") + 9_000)  # in no disc
    edges = sp.radius_neighbours(frame(spark, xy).unionByName(far), 0.05, "id")
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 0.05)) if i != j}
    assert {(r.src, r.dst) for r in edges.collect()} == want and edges.count() == len(want)
    assert sum(df.count() for df in moved) < 8 * 400  # before, 9 asked cells alone


def test_lists_of_cells_are_stored_and_not_of_points(spark, monkeypatch):
    stored, keep = [], sp.durable
    monkeypatch.setattr(sp, "CELLS", 256)
    monkeypatch.setattr(sp, "durable", lambda df: stored.append(keep(df)) or stored[-1])
    pts, rois = crowd(spark)
    want = crowd_hits(pts, rois)
    hits = sp.points_in_shapes(pts, sp.normalise_rois(rois), 0.002)
    assert sorted((r.id, r.roi_id) for r in hits.select("id", "roi_id").collect()) == sorted(want)
    assert max(df.count() for df in stored) < 0.1 * len(want)  # before, a row for each point and outline near it


@pytest.mark.parametrize("small", [100_000, 0])
def test_hits_are_not_moved_for_their_names(spark, monkeypatch, small):
    monkeypatch.setattr(sp, "SMALL", small)
    pts, rois = crowd(spark, points=3_000)
    copies = rois.unionByName(rois.withColumn("Id", F.col("Id") + 300))
    hits = sp.points_in_shapes(pts, sp.normalise_rois(copies, ["slide"]), 4.0, by=["slide"])
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # before, names were joined to the hits
    want = crowd_hits(pts, rois, True)
    assert sorted((r.id, r.roi_id) for r in hits.collect()) == sorted(want | {(i, k + 300) for i, k in want})

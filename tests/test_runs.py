"""Masks as runs against the pixel forms."""

import numpy as np
import pandas as pd
import pytest

from cellweave.operators import joins as jn
from cellweave.operators import runs as rn
from cellweave.operators import stats as st
from cellweave.operators import tiles as tl
from pyspark.sql import functions as F


def images(seed, shape=(23, 41), slides=2):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(slides):
        img = np.zeros(shape, dtype=int)
        for k in range(1, 9):
            y, x = rng.integers(0, shape[0]), rng.integers(0, shape[1])
            img[y:y + rng.integers(1, 12), x:x + rng.integers(1, 25)] = rng.integers(1, 6) if k % 2 else 0
        out.append(img)
    return out


def frame(spark, imgs, foreground=True):
    rows = [(f"s{s}", y, x, int(v)) for s, img in enumerate(imgs) for (y, x), v in np.ndenumerate(img) if v or not foreground]
    return spark.createDataFrame(rows, "slide string, y long, x long, label long")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_round_trip(spark, block):
    px = frame(spark, images(1), foreground=False)
    runs = rn.pixels_to_runs(px.unionByName(px.where("label > 2")), ["slide"], block=block).cache()
    assert rows(rn.runs_to_pixels(runs, ["slide"])) == rows(px.where("label > 0"))
    assert runs.where(F.floor(F.col("x0") / block) != F.floor(F.col("x1") / block)).count() == 0
    whole = rn.pixels_to_runs(px, ["slide"])
    assert rows(rn.cut_runs(whole, block)) == rows(runs)
    tiles = tl.to_tiles(px, 8, ["slide"], value="label")
    assert rows(rn.runs_to_pixels(rn.tiles_to_runs(tiles, 8, ["slide"]), ["slide"])) == rows(px.where("label > 0"))
    assert rn.pixels_to_runs(px.limit(0), ["slide"]).count() == 0


@pytest.mark.parametrize("block", [5, 1024])
def test_gather_and_recolour(spark, block):
    px = frame(spark, images(2))
    runs = rn.pixels_to_runs(px, ["slide"])
    rng = np.random.default_rng(3)
    pts = spark.createDataFrame([(k, f"s{k % 3}", int(rng.integers(-2, 25)), int(rng.integers(-2, 44))) for k in range(400)] + [(900, None, 1, 1), (901, "s0", None, 1)],
                                "id long, slide string, y long, x long")
    assert rows(rn.gather_runs(pts, runs, ["slide"], block=block).na.fill("", ["slide"]).na.fill(-9)) == rows(
        jn.gather(pts, px, ["slide", "y", "x"]).select("id", "slide", "y", "x", "mask_id").na.fill("", ["slide"]).na.fill(-9))
    values = spark.createDataFrame([("s0", 1, 7.0), ("s0", 3, 9.0), ("s1", 2, 4.0)], "slide string, label long, v double")
    got = rn.runs_to_pixels(rn.recolour_runs(runs, values, "v", keys=["slide"], missing=-1), ["slide"], "value")
    assert rows(got) == rows(jn.recolour(px, values, "v", keys=["slide"], missing=-1).select("slide", "y", "x", "value"))


@pytest.mark.parametrize("block", [None, 6])
def test_difference_equals_the_pixel_form(spark, block):
    a, b = frame(spark, images(4)), frame(spark, images(5))
    ra, rb = (rn.pixels_to_runs(p, ["slide"]) for p in (a, b))
    got = rn.runs_to_pixels(rn.difference_runs(ra, rb, ["slide"], block), ["slide"])
    assert rows(got) == rows(jn.mask_difference(a, b, ["slide", "y", "x"], block=block))
    assert rn.difference_runs(ra, ra, ["slide"], block).count() == 0


def test_agreement_equals_the_pixel_form(spark):
    x, y = images(6), images(7)
    both = spark.createDataFrame(pd.concat([pd.DataFrame({"slide": f"s{s}", "a": p.ravel(), "b": q.ravel()}) for s, (p, q) in enumerate(zip(x, y, strict=True))]))
    runs = [rn.pixels_to_runs(frame(spark, i), ["slide"]) for i in (x, y)]
    got = {r.slide: r for r in rn.agreement_runs(*runs, area=23 * 41, by=["slide"], block=9).collect()}
    for r in st.mask_agreement(both, "a", "b", ["slide"]).collect():
        assert all(np.isclose(r[c], got[r.slide][c]) for c in ("iou", "fraction_a", "fraction_b", "differ", "differ_2", "differ_3"))
    empty = rn.agreement_runs(*(r.limit(0) for r in runs), area=10).first()
    assert (empty.iou, empty.fraction_a, empty.differ) == (None, 0.0, 0)


def test_long_runs_stay_few(spark):
    runs = spark.createDataFrame([(0, 0, 10**7, 1), (0, 10**7 + 1, 2 * 10**7, 2)], "y long, x0 long, x1 long, label long")
    other = spark.createDataFrame([(0, 5 * 10**6, 15 * 10**6, 2)], "y long, x0 long, x1 long, label long")
    merged = rn.merged_runs(runs, other, block=1 << 22)
    assert merged.count() < 15
    assert rn.agreement_runs(runs, other, 2 * 10**7 + 1, block=1 << 22).first().differ == 15_000_001 - 5 * 10**6 + 5 * 10**6

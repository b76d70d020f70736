"""Tile kernels on stacks of tiles give what they give tile by tile, in few groups."""

import numpy as np
import pytest

from cellweave.operators import components as cp
from cellweave.operators import kernels as kn
from cellweave.operators import tiles as tl

SCHEMA = "slide string, tile_row bigint, tile_col bigint, h int, w int, pixels array<double>"


def ragged(spark):
    rng = np.random.default_rng(0)
    rows = []
    for slide in ("a", None):
        for r in range(5):
            for c in range(5):
                h, w = 3 if r == 4 else 8, 5 if c == 4 else 8
                if rng.random() > 0.2:
                    rows.append((slide, r, c, h, w, np.floor(rng.normal(0, 4, h * w)).tolist()))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("op", [
    lambda t: kn.expand_labels(t, 8, 2, keys=["slide"]), lambda t: kn.subtract_background(t, 8, 3.0, keys=["slide"]),
    lambda t: kn.outline(t, 8, keys=["slide"]), lambda t: kn.spot_candidates(t, 8, 1.0, keys=["slide"]),
    lambda t: cp.label_components(t, 8, 5, keys=["slide"])], ids=["expand", "background", "outline", "spots", "components"])
def test_many_tiles_in_a_group_give_the_rows_of_one(spark, monkeypatch, op):
    rows = lambda: sorted((repr(r) for r in op(ragged(spark)).collect()))
    many = rows()
    monkeypatch.setattr(tl, "BUNCH", 8)
    assert many == rows() and many


def test_a_kernel_is_called_for_many_tiles_at_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def kernel(stack):
        calls.add(1)
        return stack

    got = tl.map_tiles(ragged(spark), 8, 1, kernel, ["slide"], stacked=True)
    assert got.count() == ragged(spark).count() and calls.value <= 8  # two slides, four shapes


def test_pixels_must_fill_the_tile(spark):
    with pytest.raises(Exception, match="h x w"):
        tl.map_tiles(spark.createDataFrame([("a", 0, 0, 2, 2, [1.0])], SCHEMA), 8, 0, np.abs).collect()

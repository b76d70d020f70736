"""Spatial joins: points in shapes, radius neighbours, nearest neighbours.

Points of equal position are one *location* in every search; ids return by an equi join afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import geometry as geo
from cellweave.operators.covering import DEPTH, coverings, first_level, margin_of
from cellweave.operators.ordered import small_table
from cellweave.session import durable

SMALL = 100_000
CHUNK = 20_000
PAIRED = 8_000  # rows of a cell, two radii long, that are not cut into chunks
IDS = 256  # of one place in a row
CUTS = 7  # finest cells along an outline, as a power of two
CELLS = 16_384  # occupied finest cells are not counted against points up to this number
SHARED = 128  # points of an occupied finest cell beyond that number
CORNERS = 16  # of an outline that is tested without a loop
MADE = 40_000_000  # pairs of points and outlines of one task
LISTED = 200_000  # outlines of cells of one task
TASKS = 20_000
FAR = 64  # a cell with more target locations than this for each one wanted is searched by descent


# --- J9, J10 -----------------------------------------------------------------------------------

def normalise_rois(rois: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROI rows to ``(Id, kind, pts, cx, cy, rx, ry, x0, y0, x1, y1)``.

    Rectangles become four corners, polylines count as closed; points and lines never contain anything
    and are dropped. A radius of -1 means absent. ``by`` names columns to keep, such as the slide.
    """
    kind = F.lower("type")
    pts = F.when(kind == "rectangle", geo.rectangle_corners(F.col("X"), F.col("Y"), F.col("Width"), F.col("Height"))).otherwise(
        geo.parse_points(F.col("all_points")))
    r = rois.select(*by, "Id", "Name", "Text", kind.alias("kind"), pts.alias("pts"),
                    F.col("X").alias("cx"), F.col("Y").alias("cy"),
                    F.when(F.col("RadiusX") > 0, F.col("RadiusX")).alias("rx"),
                    F.when(F.col("RadiusY") > 0, F.col("RadiusY")).alias("ry"))
    r = r.where(F.col("kind").isin("polygon", "rectangle", "polyline", "ellipse"))
    b, ell = geo.bbox(F.col("pts")), F.col("kind") == "ellipse"
    box = {
        "x0": F.when(ell, F.col("cx") - F.col("rx")).otherwise(b.x0),
        "y0": F.when(ell, F.col("cy") - F.col("ry")).otherwise(b.y0),
        "x1": F.when(ell, F.col("cx") + F.col("rx")).otherwise(b.x1),
        "y1": F.when(ell, F.col("cy") + F.col("ry")).otherwise(b.y1),
    }
    return r.withColumns(box).where(F.col("x0").isNotNull())


OUTLINE = ("kind", "pts", "cx", "cy", "rx", "ry", "x0", "y0", "x1", "y1")


def outlines(rois: DataFrame, by: Sequence[str] = (), marks: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Distinct outlines ``(by, marks, _sid, outline)`` and the shapes that have them ``(rois, _sid)``: copies of a shape are searched once."""
    same = [*by, *marks]
    shapes = durable(rois.withColumn("_key", F.sha2(F.to_json(F.struct(*same, *OUTLINE)), 256)))
    one = shapes.groupBy("_key").agg(*[F.first(c).alias(c) for c in (*same, *OUTLINE)])
    one = durable(one.withColumn("_sid", F.monotonically_increasing_id()))
    return one.drop("_key"), shapes.join(one.select("_key", "_sid"), "_key").drop("_key")


def finest_side(points: DataFrame, distinct: DataFrame, cell: float, x: str, y: str, by: Sequence[str]) -> float:
    """``cell`` times a power of two: some ``2 ** CUTS`` of it make the length of all but the shortest outlines, fewer where outlines are many.
    Longer where an occupied cell would else hold less than ``SHARED`` points, as what a cell knows must be worth more than a test of its points."""
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    some = distinct.where((span > 0) & (span < F.lit(float("inf")))).agg(F.count(F.lit(1)), F.percentile_approx(span, 0.05)).first()
    if not some[0]:
        return cell
    cuts = min(CUTS, max(CUTS - 2, round(CUTS - math.log2(some[0] / 4_000) / 2)))
    first = math.floor(math.log2(some[1] / cell)) - cuts
    sides = [cell * 2.0 ** (first + 2 * i) for i in range(9)]
    at = lambda c, side: F.floor(F.col(c).cast("double") / side)
    used = points.where(finite(x, y)).agg(F.count(F.lit(1)), *[F.approx_count_distinct(F.xxhash64(*by, at(x, s), at(y, s))) for s in sides]).first()
    return next((s for s, n in zip(sides, used[1:], strict=True) if n <= max(CELLS, used[0] / SHARED)), sides[-1])


def finite(x: str, y: str) -> Column:
    """NaN is larger than infinity here."""
    return (F.abs(F.col(x).cast("double")) < F.lit(float("inf"))) & (F.abs(F.col(y).cast("double")) < F.lit(float("inf")))


def near_outlines(
    points: DataFrame, distinct: DataFrame, cell: float, x: str, y: str, by: Sequence[str], marks: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Points with the finest cell ``_gx, _gy`` they lie in (null without a finite place), and ``(by, _gx, _gy, _n, _sid, inner, marks)`` of the outlines that
    meet each occupied cell of ``_n`` points. Cells of the coverings go by the occupied ones as they are made; none is stored."""
    side = finest_side(points, distinct, float(cell), x, y, by)
    there = finite(x, y)
    placed = points.withColumns({f"_g{n}": F.when(there, F.floor(F.col(c).cast("double") / side)) for n, c in (("x", x), ("y", y))})
    held = durable(placed.where(there).groupBy(*by, "_gx", "_gy").agg(F.count(F.lit(1)).alias("_n")))
    corners = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = distinct.where(F.greatest(*[F.abs(c) for c in corners]) < F.lit(float("inf"))).agg(F.min(span), F.max(span), F.max(F.greatest(*[F.abs(c) for c in corners]))).first()
    if box[0] is None:
        low = high = 0
    else:
        low, high = (first_level((0.0, 0.0, v, 0.0), side, margin_of((0.0, box[2]))) for v in box[:2])
    levels = range(max(0, low - DEPTH), high + 1)
    occupied = held.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    occupied = occupied.withColumns({"cx": up("_gx"), "cy": up("_gy")})
    bounded = held.count() * len(levels) <= 4 * SMALL
    cells = coverings(distinct.repartition(task_count(distinct)), side, by, marks)
    near = cells.join(F.broadcast(occupied) if bounded else occupied.hint("merge"), [*by, "level", "cx", "cy"])
    return placed, near.select(*by, "_gx", "_gy", "_n", "_sid", "inner", *marks)


def task_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def meet(many: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join with a stored table that is broadcast up to ``SMALL`` rows, sorted and merged beyond: compressed bytes tell little of the memory it takes."""
    held, bounded = small_table(few, SMALL)
    return many.join(F.broadcast(held) if bounded else few.hint("merge"), list(on))


def hashable(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def meet_by_cell(placed: DataFrame, leaves: DataFrame, told: DataFrame, few: bool, at: Sequence[str], weight: float = 1.0) -> DataFrame:
    """Points with the rows of ``told`` (by ``_sid``, ``few`` if these may be broadcast) of the outlines their cell lists.

    ``leaves`` has ``(at, _n, _sure, _ask)``, a row for a cell: its points, outlines it lies in and outlines to test. What a cell needs of its outlines is brought
    to it first, then cells and points move once; cells of many pairs are cut into chunks. ``weight`` is the number of rows that a pair makes.
    """
    size = (F.size("_sure") + F.size("_ask")).cast("double")
    made = F.col("_n") * size * weight / MADE
    entries, tasks = leaves.agg(F.coalesce(F.sum(size), F.lit(0.0)), F.coalesce(F.sum(made), F.lit(0.0))).first()
    listed = leaves.select(*at, F.explode("_sure").alias("_sid"), F.lit(True).alias("inner")).unionByName(
        leaves.select(*at, F.explode("_ask").alias("_sid"), F.lit(False).alias("inner")))
    near = listed.join(F.broadcast(told) if few else told.hint("merge"), "_sid")
    near = near.withColumns({f"_{c}": F.when(~F.col("inner"), F.col(f"_{c}")) for c in (*OUTLINE, "edges") if f"_{c}" in near.columns})
    if entries <= SMALL and few:
        return placed.join(F.broadcast(near), list(at))
    hot = leaves.where(made > 1).select(*at, F.ceil(F.sqrt(made)).alias("_s"))
    asked, answers, on = spread_hot(placed.where("_gx is not null"), near, at, hot, hashable(placed), ["_sid"])
    tasks = min(max(task_count(placed), math.ceil(tasks), math.ceil(entries / LISTED)), TASKS)  # by rows made; bytes read would merge them
    return asked.repartition(tasks, *on).join(answers.repartition(tasks, *on).hint("shuffle_hash"), on)


def outline_rows(distinct: DataFrame, *keep: str) -> tuple[DataFrame, int]:
    """``(_sid, keep, outline columns with a leading underscore, _edges)`` and the most corners. Edges are four numbers each in one array."""
    most = distinct.agg(F.max(F.when(F.col("kind").isin("ellipse", "rectangle"), F.lit(0)).otherwise(F.size("pts")))).first()[0] or 0
    flat = F.flatten(F.transform(geo.edges(F.col("pts")), lambda e: F.array(e.x1, e.y1, e.x2, e.y2)))
    edges = F.when(~F.col("kind").isin("ellipse", "rectangle"), flat).alias("_edges")
    columns = [c for c in OUTLINE if c != "pts" or most > CORNERS]
    return distinct.select("_sid", *keep, *[F.col(c).alias(f"_{c}") for c in columns], edges), most


def lies_in(x: str, y: str, most: int) -> Column:
    """The exact test of a point against the columns of :func:`outline_rows`. Up to ``CORNERS`` corners it is compiled without a loop."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    if most > CORNERS:
        ring = geo.in_polygon(px, py, F.col("_pts"))
    else:
        ring = F.lit(False)
        for k in range(most):
            x1, y1, x2, y2 = (F.get("_edges", F.lit(4 * k + i)) for i in range(4))
            ring = ring != F.coalesce(((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1), F.lit(False))
    inside = F.when(F.col("_kind") == "ellipse", geo.in_ellipse(px, py, F.col("_cx"), F.col("_cy"), F.col("_rx"), F.col("_ry"))).when(
        F.col("_kind") == "rectangle", F.lit(True)).otherwise(ring)
    return px.between(F.col("_x0"), F.col("_x1")) & py.between(F.col("_y0"), F.col("_y1")) & inside


def points_in_shapes(
    points: DataFrame, rois: DataFrame, cell: float, x: str = "x", y: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """Each point row with ``roi_id, roi_name, roi_text`` of every shape (of its slide, if ``by`` names one) that contains it.

    Shapes of one outline are one until the end. Outlines are covered by quadtree cells of sides ``cell`` times powers of two (:func:`finest_side`), inner or at the
    border (``covering.py``). The *occupied* finest cells, one row each however many points they hold, look up the cells above them and list their outlines; points
    then meet the list of their finest cell. In inner cells that is all, at the border the exact test decides. Nothing is made for empty cells,
    and rows of the result are made where points and lists meet: what is stored or moved grows with points and lists, not with the result.
    Points without a finite place are in no shape; a null slide is no slide.
    """
    by = list(by)
    distinct, members = outlines(rois, by)
    placed, near = near_outlines(points, distinct, cell, x, y, by)
    at = [*by, "_gx", "_gy"]
    sure, ask = (F.collect_list(F.when(test, F.col("_sid"))).alias(n) for n, test in (("_sure", F.col("inner")), ("_ask", ~F.col("inner"))))
    leaves = durable(near.groupBy(*at).agg(F.first("_n").alias("_n"), sure, ask))
    piece = F.floor((F.row_number().over(Window.partitionBy("_sid").orderBy("Id")) - 1) / IDS).alias("_p")
    names = {"roi_id": "Id", "roi_name": "Name", "roi_text": "Text"}
    # A list for each column, so that those nobody asks for are not moved; a struct keeps nulls in their place.
    lists = members.select("_sid", *names.values(), piece).groupBy("_sid", "_p").agg(*[F.collect_list(F.struct(c)).alias(f"_{n}") for n, c in names.items()]).drop("_p")
    outline, most = outline_rows(distinct)
    counts = distinct.count(), members.count()
    met = meet_by_cell(placed, leaves, outline.join(lists, "_sid"), max(counts) <= SMALL, at, max(1.0, counts[1] / max(1, counts[0])))
    hits = met.where(F.col("inner") | lies_in(x, y, most))
    out = hits.select(*points.columns, F.posexplode("_roi_id").alias("_p", "_one"), "_roi_name", "_roi_text")
    return out.select(*points.columns, F.col("_one.Id").alias("roi_id"), F.get("_roi_name", "_p")["Name"].alias("roi_name"), F.get("_roi_text", "_p")["Text"].alias("roi_text"))


def select_by_shapes(
    points: DataFrame, rois: DataFrame, cell: float, key: str | Sequence[str], excluded: Column, x: str = "x", y: str = "y",
    by: Sequence[str] = (), out: str = "selected",
) -> DataFrame:
    """J10 without the list of hits: the same as :func:`include_exclude` on them; ``excluded`` is told from the columns of ``rois``.

    Shapes of one outline and kind are one. Points of a cell that lies inside an excluding shape need no test, those of a cell inside an
    including one are tested against excluding shapes alone. What cells decide is told to their points without a shuffle; points move once, to their key.
    """
    by = list(by)
    distinct, _ = outlines(rois.withColumn("_exc", excluded).where("_exc is not null"), by, ["_exc"])
    placed, near = near_outlines(points, distinct, cell, x, y, by, ["_exc"])
    at = [*by, "_gx", "_gy"]
    exc, inner = F.col("_exc"), F.col("inner")
    listed = [F.collect_list(F.when(test & ~inner, F.col("_sid"))).alias(n) for n, test in (("_e", exc), ("_i", ~exc))]
    decided = near.groupBy(*at).agg(F.first("_n").alias("_n"), F.bool_or(exc & inner).alias("_no"), F.bool_or(~exc & inner).alias("_yes"), *listed)
    none = F.array().cast("array<bigint>")
    leaves = durable(decided.select(*at, "_n", "_no", "_yes", none.alias("_sure"), F.when(F.col("_no"), none).when(
        F.col("_yes"), F.col("_e")).otherwise(F.concat("_e", "_i")).alias("_ask")))
    outline, most = outline_rows(distinct, "_exc")
    met = meet_by_cell(placed, leaves.where(F.size("_ask") > 0).drop("_no", "_yes"), outline, distinct.count() <= SMALL, at)
    hits = met.where(lies_in(x, y, most))
    flags = leaves.where("_no or _yes").select(*at, "_no", "_yes")
    told = placed.join(F.broadcast(flags) if flags.count() <= 4 * SMALL else flags, at, "left").select(*points.columns, "_yes", "_no")
    return include_exclude(told, hits, key, exc, out, ("_yes", "_no"))


def include_exclude(
    points: DataFrame, hits: DataFrame, key: str | Sequence[str], excluded: Column, out: str = "selected", sure: Sequence[str] = ()
) -> DataFrame:
    """A point is selected when some including and no excluding shape contains it. ``key`` may be several columns (slide and id).

    ``sure`` may name two columns of ``points``, whether the row is known to lie in some including and in some excluding shape. They are dropped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kinds = dict(points.dtypes)
    columns = [c for c in points.columns if c not in sure]
    known = [F.coalesce(F.col(c), F.lit(False)) for c in sure] or [F.lit(False)] * 2
    per = hits.groupBy(*keys).agg(F.bool_or(~excluded).alias("_inc"), F.bool_or(excluded).alias("_exc"))
    rows = points.select(*columns, known[0].alias("_inc"), known[1].alias("_exc"), F.lit(True).alias("_own")).unionByName(per.select(
        *[(F.col(c) if c in keys else F.lit(None)).cast(kinds[c]).alias(c) for c in columns], "_inc", "_exc", F.lit(False).alias("_own")))
    absent = F.greatest(*[F.col(c).isNull() for c in keys], F.lit(False))
    alone = F.when(absent, F.pmod(F.xxhash64(*[c for c in hashable(points) if c not in sure]), F.lit(4096)))  # rows without key are not one task
    w = Window.partitionBy(*keys, "_alone")
    some = lambda c: F.coalesce(F.bool_or(c).over(w), F.lit(False))
    flag = ~absent & some("_inc") & ~some("_exc")
    return rows.withColumn("_alone", alone).withColumn(out, flag).where("_own").select(*columns, out)


# --- shared ------------------------------------------------------------------------------------

def spread_hot(
    asking: DataFrame, answering: DataFrame, keys: Sequence[str], hot: DataFrame, id_ask: Sequence[str], id_ans: Sequence[str]
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cut crowded join keys into chunks on both sides.

    ``hot`` lists ``(keys, _s)`` with the number of chunks per side. Each asking row belongs to one of its
    key's chunks ``_a`` and visits all chunks ``_b``; answering rows the other way round. No task then
    compares more than one chunk with one chunk. Without hot keys nothing changes.
    """
    rows = hot.limit(SMALL + 1).collect()
    if not rows:
        return asking, answering, list(keys)
    table = hot if len(rows) > SMALL else F.broadcast(hot.sparkSession.createDataFrame(rows, hot.schema))

    def side(df, ids, own, other):
        s = F.coalesce(F.col("_s"), F.lit(1)).cast("int")
        df = df.join(table, list(keys), "left")
        df = df.withColumn(own, F.pmod(F.xxhash64(*ids), s).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), s - 1))).drop("_s")

    return side(asking, id_ask, "_a", "_b"), side(answering, id_ans, "_b", "_a"), [*keys, "_a", "_b"]


def locations(points: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct positions with their multiplicity ``n``."""
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x)) & ~F.isnan(F.col(y))).groupBy(
        *by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))


# --- J11 ---------------------------------------------------------------------------------------

def location_pairs(
    asking: DataFrame, answering: DataFrame, radius: float, by: Sequence[str] = (), chunk: int = CHUNK
) -> DataFrame:
    """Pairs of locations at most ``radius`` apart: columns of ``asking`` as they are, of ``answering``
    with the prefix ``t_``, and ``dist``. Both need ``(by, x, y)``; a location pairs with itself. Cells of more than ``chunk`` rows are cut."""
    side = float(radius)
    at = lambda c: F.floor(F.col(c) / side)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    ask = asking.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumns(
        {"_cx": at("x") + F.col("_dx"), "_cy": at("y") + F.col("_dy")}).drop("_dx", "_dy")
    ans = answering.withColumns({"_cx": at("x"), "_cy": at("y")})
    cells = [*by, "_cx", "_cy"]
    hot = ans.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk).select(
        *cells, F.ceil(F.col("_n") / chunk).alias("_s"))
    ask, ans, keys = spread_hot(ask, ans, cells, hot, ["x", "y"], ["x", "y"])
    own = [c for c in answering.columns if c not in by]
    ans = ans.withColumnsRenamed({c: f"t_{c}" for c in own})
    d2 = F.pow(F.col("x") - F.col("t_x"), 2) + F.pow(F.col("y") - F.col("t_y"), 2)
    met = spread_by_number(ask, keys).join(ans, keys).where(d2 <= side * side)
    return met.withColumn("dist", F.sqrt(d2)).drop("_cx", "_cy", "_a", "_b")


def spread_by_number(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shuffle partitions of the session by number: pairs cost far more than the bytes of the rows that make them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def radius_neighbours(
    points: DataFrame, radius: float, idc: str, x: str = "x", y: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """Edges ``(src, dst, dist)`` with ``0 <= dist <= radius`` and no self edge.

    Locations carry their ids, at most ``IDS`` a row, so pairs of locations become edges where they are met and no list of pairs is
    shuffled. Cells are two radii long: a location asks the cells its disc may touch, four on average, and of a crowded cell it goes to one chunk, while
    the locations in that cell go to all of its chunks. The edge list itself grows with the square of the points in a disc; the counting operators
    (composition, interaction, enrichment) never build it.
    """
    ids = points.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(idc).alias("_id"))
    ids = ids.where(finite("x", "y") & F.col("_id").isNotNull())  # a place at infinity is in no disc
    piece = F.floor((F.row_number().over(Window.partitionBy(*by, "x", "y").orderBy("_id")) - 1) / IDS).alias("_p")
    locs = durable(ids.select("*", piece).groupBy(*by, "x", "y", "_p").agg(F.collect_list("_id").alias("ids")).drop("_p"))
    alone = (locs.agg(F.max(F.size("ids"))).first()[0] or 1) == 1  # lists of one id are that id
    side, cells = 2.0 * radius, [*by, "_cx", "_cy"]
    at = lambda v: F.floor(v / side)
    slack = lambda c: F.lit(1e-9 * radius) + 4e-16 * F.abs(F.col(c))
    reach = lambda c: F.explode(F.sequence(at(F.col(c) - radius - slack(c)), at(F.col(c) + radius + slack(c))))
    locs = locs.withColumn("ids", F.get("ids", F.lit(0))) if alone else locs
    ask = locs.withColumn("_cx", reach("x")).withColumn("_cy", reach("y"))
    ans = locs.withColumns({"_cx": at(F.col("x")), "_cy": at(F.col("y"))})
    hot = ans.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PAIRED).select(*cells, F.ceil(F.col("_n") / PAIRED).cast("int").alias("_s"))
    keys, crowds = cells, hot.limit(SMALL + 1).collect()
    if crowds:
        crowded = hot if len(crowds) > SMALL else F.broadcast(hot.sparkSession.createDataFrame(crowds, hot.schema))
        ask, ans = (df.join(crowded, cells, "left").withColumn("_s", F.coalesce("_s", F.lit(1))) for df in (ask, ans))
        ask = ask.withColumn("_a", F.pmod(F.xxhash64("x", "y", "ids"), F.col("_s")).cast("int")).drop("_s")
        ans = ans.withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
        keys = [*cells, "_a"]
    dx, dy = F.col("x") - F.col("t_x"), F.col("y") - F.col("t_y")
    d2 = dx * dx + dy * dy
    ans = ans.withColumnsRenamed({c: f"t_{c}" for c in ("x", "y", "ids")})
    met = spread_by_number(ans, keys).join(spread_by_number(ask, keys), keys).where(d2 <= radius * radius).withColumn("dist", F.sqrt(d2))
    if alone:
        return met.where(F.col("ids") != F.col("t_ids")).select(*by, F.col("ids").alias("src"), F.col("t_ids").alias("dst"), "dist")
    edges = met.select(*by, "t_ids", "dist", F.explode("ids").alias("src")).select(*by, "src", F.explode("t_ids").alias("dst"), "dist")
    return edges.where(F.col("src") != F.col("dst"))


# --- J12 ---------------------------------------------------------------------------------------

def nearest_neighbours(
    source: DataFrame, target: DataFrame, k: int, src_id: str, dst_id: str, x: str = "x", y: str = "y",
    exclude_self: bool = False, by: Sequence[str] = (),
) -> DataFrame:
    """``(by, src, dst, dist, rank)``, the ``k`` nearest targets of each source; ties by id.

    A pyramid of cell counts tells, for each source location, the finest cell around it that holds enough
    targets: small cells in dense regions, large ones in empty regions, no distance cut-off. The best of
    that cell bound the distance, and a second round searches only the cells that touch the disc of that
    radius. Sources whose cell would be a crowded one, as when the sets lie apart, descend from the whole area cell by cell
    instead and meet only targets that can be one of the nearest of some source in their cell. At one position only the first ``k`` (+1) ids can
    matter, which bounds a pile of copies.
    """
    want = k + 1 if exclude_self else k
    keep = list(by)
    ask = durable(locations(source, x, y, by).drop("n"))  # both location tables are read several times
    ranked = target.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(dst_id).alias("_id"))
    ranked = ranked.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    w = Window.partitionBy(*by, "x", "y").orderBy("_id")
    ans = durable(ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= want).groupBy(*by, "x", "y").agg(
        F.array_sort(F.collect_list("_id")).alias("ids")).withColumn("n", F.size("ids")))

    box = ask.select("x", "y").unionByName(ans.select("x", "y")).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    size = ans.count()
    found = _location_search(ask, ans, want, keep, box, size) if size else None
    src = source.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(src_id).alias("src"))
    if found is None:
        kind = dict(target.dtypes)[dst_id]
        return src.where(F.lit(False)).select(*by, "src", F.lit(None).cast(kind).alias("dst"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank"))
    joined = src.join(found, [*keep, "x", "y"])
    near = F.filter("near", lambda e: e._id != F.col("src")) if exclude_self else F.col("near")
    picked = joined.select(*by, "src", F.posexplode(F.slice(near, 1, k)).alias("_p", "e"))
    return picked.select(*by, "src", F.col("e._id").alias("dst"), F.sqrt("e.d2").alias("dist"), (F.col("_p") + 1).alias("rank"))


def _location_search(ask: DataFrame, ans: DataFrame, want: int, by: list[str], box, size: int) -> DataFrame:
    span = max(box.x1 - box.x0, box.y1 - box.y0) or 1.0
    span *= 1 + 1e-9
    depth = max(0, math.ceil(math.log2(max(size / (4 * want), 1)) / 2))

    def cells(df, level, names=("cx", "cy")):
        # level is a number or a column; the last cell of each axis is closed
        lv = level if isinstance(level, Column) else F.lit(level)
        k = F.pow(F.lit(2.0), lv)
        put = lambda c, o: F.least(F.floor((F.col(c) - F.lit(o)) / F.lit(span) * k), (k - 1).cast("long"))
        return df.withColumns({names[0]: put("x", box.x0), names[1]: put("y", box.y0)})

    while True:  # deepen until the fullest cell is small; only one number comes back per round
        base = durable(cells(ans, depth).groupBy(*by, "cx", "cy").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("locs")))
        full = base.agg(F.max("locs")).first()[0]
        if full <= 32 * want or depth >= 40:
            break
        depth = min(40, depth + max(1, math.ceil(math.log2(full / (8 * want)) / 2)))

    shift = lambda c, l: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(depth) - l)).cast("long")
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    up = base.withColumn("l", levels)
    pyramid = up.groupBy(*by, "l", shift("cx", F.col("l")).alias("cx"), shift("cy", F.col("l")).alias("cy")).agg(
        F.sum("n").alias("n"), F.sum("locs").alias("locs"))

    fine = cells(ask, depth, ("fx", "fy"))
    homes = fine.select(*by, "fx", "fy").distinct().withColumn("l", levels)
    homes = homes.withColumns({"cx": shift("fx", F.col("l")), "cy": shift("fy", F.col("l"))})
    enough = pyramid.where(F.col("n") >= want).select(*by, "l", "cx", "cy", "locs")
    level = homes.join(enough, [*by, "l", "cx", "cy"]).groupBy(*by, "fx", "fy").agg(
        F.max("l").alias("l"), F.max_by("locs", "l").alias("locs"))
    placed = durable(fine.join(level, [*by, "fx", "fy"], "left"))
    crowded = placed.where(F.col("locs") > FAR * want).drop("l", "locs")
    apart = not crowded.isEmpty()
    if apart:
        at = cells(ans, depth).select(*by, "cx", "cy", F.col("x").alias("t_x"), F.col("y").alias("t_y"), "ids")
        descended = _descent(crowded, durable(pyramid), at, want, by, box, span, depth)
        placed = placed.where(F.coalesce("locs", F.lit(0)) <= FAR * want)
    placed = placed.withColumn("known", F.col("l").isNotNull()).withColumn("l", F.coalesce("l", F.lit(0))).drop("fx", "fy", "locs")
    placed = cells(placed, F.col("l"))

    best = F.slice(F.array_sort(F.collect_list(F.struct("d2", "_id"))), 1, want)
    used = sorted(r.l for r in placed.select("l").distinct().collect())  # at most depth + 1 numbers
    if apart and not used:
        return descended.groupBy(*by, "x", "y").agg(best.alias("near"))
    told = cells(ans.withColumn("l", F.explode(F.array(*[F.lit(v) for v in used]))), F.col("l"))
    told = told.select(*by, "l", "cx", "cy", F.col("x").alias("t_x"), F.col("y").alias("t_y"), "ids")
    key, loc = [*by, "l", "cx", "cy"], [*by, "x", "y"]
    hot = pyramid.where(F.col("l").isin(used) & (F.col("locs") > CHUNK)).select(*key, F.ceil(F.col("locs") / CHUNK).alias("_s"))
    d2 = F.pow(F.col("x") - F.col("t_x"), 2) + F.pow(F.col("y") - F.col("t_y"), 2)

    def closest(asked):
        """The ``want`` nearest locations among those in the cells each location asks for."""
        a, t, on = spread_hot(asked, told, key, hot, ["x", "y"], ["t_x", "t_y"])
        met = a.join(t, on).withColumn("d2", d2).where(F.col("d2") <= F.col("r2")).select(*loc, "d2", "ids")
        first = Window.partitionBy(*loc).orderBy("d2", F.col("ids")[0])
        return met.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= want).drop("_r")

    # Round 1 looks into the own cell only; its farthest hit bounds the disc that round 2 has to search.
    own = placed.withColumn("r2", F.lit(float("inf")))
    bound = closest(own).groupBy(*loc).agg((F.max("d2") * (1 + 1e-12)).alias("_b"))
    step = F.lit(span) / F.pow(F.lit(2.0), F.col("l"))
    reach = F.array(*[F.lit(i) for i in range(-2, 3)])
    placed = placed.join(bound, loc, "left").withColumn("r2", F.when(F.col("known"), F.col("_b")).otherwise(F.lit(float("inf"))))
    asked = placed.withColumn("_dx", F.explode(reach)).withColumn("_dy", F.explode(reach)).withColumns(
        {"cx": F.col("cx") + F.col("_dx"), "cy": F.col("cy") + F.col("_dy")})
    gap = lambda c, o, i: F.greatest(F.lit(o) + F.col(i) * step - F.col(c), F.col(c) - F.lit(o) - (F.col(i) + 1) * step, F.lit(0.0))
    slack = F.lit(span * 1e-12)  # cell borders are rounded numbers
    near = F.pow(F.greatest(gap("x", box.x0, "cx") - slack, F.lit(0.0)), 2) + F.pow(F.greatest(gap("y", box.y0, "cy") - slack, F.lit(0.0)), 2) <= F.col("r2")
    asked = asked.where(near).select(*loc, "l", "cx", "cy", "r2")
    flat = closest(asked).select(*loc, "d2", F.explode("ids").alias("_id"))
    flat = flat.unionByName(descended) if apart else flat
    return flat.groupBy(*loc).agg(best.alias("near"))


def _descent(
    crowded: DataFrame, pyramid: DataFrame, at: DataFrame, want: int, by: list[str], box, span: float, depth: int
) -> DataFrame:
    """``(by, x, y, d2, _id)``: targets of each location, all of its ``want`` nearest among them.

    Source cells and target cells are halved together. Target cells, nearest far side first, that add up to ``want`` bound the
    distance; those that begin beyond it are left out. So a source cell keeps a band of cells along the near side of the
    targets, however many lie behind. Such a band is long where the targets are far away, as one cell is little of the distance;
    so of its targets only those go on that are not farther than each of ``want`` others from every place of the source cell.
    """
    half = lambda c, l: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(depth - l))).cast("long")
    slack = 1e-3  # of a cell: cell borders are rounded numbers

    def within(df, owner, begins, ends):
        """Rows whose cell begins before the bound of its ``owner``."""
        upto = Window.partitionBy(*owner).orderBy("_e", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0)
        bound = F.min(F.when(F.col("_cum") >= want, F.col("_e"))).over(Window.partitionBy(*owner))
        ranked = df.withColumns({"_b": begins, "_e": ends}).withColumn("_cum", F.sum("n").over(upto)).withColumn("r2", bound)
        return ranked.where(F.col("r2").isNull() | (F.col("_b") <= F.col("r2"))).drop("_b", "_e", "_cum")

    homes = durable(crowded.select(*by, "fx", "fy").distinct())
    zero = F.lit(0).cast("long")
    cur = homes.select(*by, *[zero.alias(c) for c in ("sx", "sy", "cx", "cy")]).distinct()
    for l in range(1, depth + 1):
        source = homes.select(*by, half("fx", l - 1).alias("sx"), half("fy", l - 1).alias("sy"), half("fx", l).alias("_sx"), half("fy", l).alias("_sy")).distinct()
        target = pyramid.where(F.col("l") == l).select(
            *by, F.floor(F.col("cx") / 2).alias("cx"), F.floor(F.col("cy") / 2).alias("cy"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "n")
        met = cur.join(source, [*by, "sx", "sy"]).join(target, [*by, "cx", "cy"]).select(
            *by, *[F.col(f"_{c}").alias(c) for c in ("sx", "sy", "cx", "cy")], "n")
        off = lambda a, b: F.abs(F.col(a) - F.col(b)).cast("double")
        begins = F.pow(F.greatest(off("sx", "cx") - (1 + slack), F.lit(0.0)), 2) + F.pow(F.greatest(off("sy", "cy") - (1 + slack), F.lit(0.0)), 2)
        ends = F.pow(off("sx", "cx") + (1 + slack), 2) + F.pow(off("sy", "cy") + (1 + slack), 2)
        cur = within(met, [*by, "sx", "sy"], begins, ends).drop("r2")
        if l % 2 == 0 or l == depth:
            cur = durable(cur)
        if l < depth:
            cur = cur.drop("n")
    if not depth:
        cur = cur.join(pyramid.select(*by, "cx", "cy", "n"), [*by, "cx", "cy"])
    step = span / 2 ** depth
    homes = durable(crowded.groupBy(*by, "fx", "fy").agg(  # the box that the locations of a source cell take up
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    home = [*by, "fx", "fy"]
    low = lambda o, i: F.lit(o) + F.col(i) * step
    begin = lambda c, o, i: F.greatest(low(o, i) - F.col(f"{c}1"), F.col(f"{c}0") - low(o, i) - step, F.lit(0.0))
    end = lambda c, o, i: F.greatest(F.abs(low(o, i) - F.col(f"{c}1")), F.abs(low(o, i) + step - F.col(f"{c}0")))
    begin_of = lambda c, o, i: F.pow(F.greatest(begin(c, o, i) - slack * step, F.lit(0.0)), 2)
    end_of = lambda c, o, i: F.pow(end(c, o, i) + slack * step, 2)
    band = within(homes.join(cur.withColumnsRenamed({"sx": "fx", "sy": "fy"}), home), home,
                  begin_of("x", box.x0, "cx") + begin_of("y", box.y0, "cy"), end_of("x", box.x0, "cx") + end_of("y", box.y0, "cy"))
    band = durable(band.select(*home, "x0", "x1", "y0", "y1", "cx", "cy"))
    met = band.join(at, [*by, "cx", "cy"]).drop("cx", "cy")

    # Reference targets, nearest to the middle of the box. That one of them is nearer than a target is a linear condition on the
    # place, so it holds all over the box if it holds in the corners; both axes can be looked at by themselves.
    middle = F.pow((F.col("x0") + F.col("x1")) / 2 - F.col("t_x"), 2) + F.pow((F.col("y0") + F.col("y1")) / 2 - F.col("t_y"), 2)
    first = F.row_number().over(Window.partitionBy(*home).orderBy(middle, "t_x", "t_y"))
    refs = met.withColumn("_r", first).where(F.col("_r") <= want).groupBy(*home).agg(F.collect_list(F.struct("t_x", "t_y")).alias("_refs"))

    def ahead(r, c):
        """The most that a target may be nearer than the reference ``r`` along one axis, as a difference of squares."""
        mine, other = F.col(f"t_{c}"), r[f"t_{c}"]
        return F.greatest(*[(mine - other) * (2 * F.col(f"{c}{i}") - other - mine) for i in (0, 1)])

    far = lambda c: F.pow(F.greatest(F.abs(F.col("t_" + c) - F.col(c + "0")), F.abs(F.col("t_" + c) - F.col(c + "1"))), 2)
    rounding = -1e-12 * (far("x") + far("y"))
    may = (F.size("_refs") < want) | F.exists("_refs", lambda r: ahead(r, "x") + ahead(r, "y") >= rounding)
    kept = durable(met.join(refs, home).where(may).select(*home, "t_x", "t_y", "ids"))
    d2 = F.pow(F.col("x") - F.col("t_x"), 2) + F.pow(F.col("y") - F.col("t_y"), 2)
    found = meet(crowded, kept, home).select(*by, "x", "y", d2.alias("d2"), "ids")
    nearest = F.row_number().over(Window.partitionBy(*by, "x", "y").orderBy("d2", F.col("ids")[0]))
    return found.withColumn("_r", nearest).where(F.col("_r") <= want).select(*by, "x", "y", "d2", F.explode("ids").alias("_id"))

"""P7, J9-J12, A27-A30, F6-F8 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import bind, table
from cellweave.functions import affine as af
from cellweave.functions import geometry as geo
from cellweave.operators import neighbourhood as nb
from cellweave.operators import permutation as pm
from cellweave.operators import spatial as sp

R = 0.05
PTS = "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"
# Copies of one position: prices and discounts repeat, so a location carries many rows.
GRID = "SELECT o_orderkey AS id, o_orderstatus AS cls, CAST(o_custkey % 97 AS DOUBLE) AS x, CAST(o_orderkey % 89 AS DOUBLE) AS y FROM orders"


def pts(spark, d):
    return table(spark, d, "embeddings").select(
        "vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def grid_pts(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey id", "o_orderstatus cls", "cast(o_custkey % 97 as double) x", "cast(o_orderkey % 89 as double) y")


def d2(a="a", b="b"):
    return f"(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


@bind("p7_parse_points", """SELECT o_orderkey, CAST(2 AS INTEGER) AS n, CAST(o_custkey AS DOUBLE) AS x0, o_totalprice AS y0, CAST(-o_orderkey AS DOUBLE) AS x1, CAST(5 AS DOUBLE) AS y1 FROM orders""")
def p7(spark, d):
    text = F.concat(F.col("o_custkey").cast("string"), F.lit(","), F.format_string("%.2f", "o_totalprice"), F.lit(" "),
                    (-F.col("o_orderkey")).cast("string"), F.lit(",5"))
    p = table(spark, d, "orders").select("o_orderkey", geo.parse_points(text).alias("p"))
    return p.select("o_orderkey", F.size("p").alias("n"), *[F.col("p")[i][c].cast("double").alias(f"{c}{i}") for i in (0, 1) for c in "xy"])


def rois(spark, d):
    """ROI rows derived from the supplier table: one shape per supplier, its type by nation."""
    s = table(spark, d, "supplier")
    c = "round(s_acctbal / 100.0D, 4)"
    return s.selectExpr(
        "s_suppkey Id", "s_name Name", "case when s_nationkey % 5 = 0 then 'exclude' else 'include' end Text",
        "element_at(array('Polygon', 'Rectangle', 'Ellipse', 'Point'), cast(s_nationkey % 4 + 1 as int)) type",
        f"concat(format_string('%.4f', {c}), ',', format_string('%.4f', {c}), ' ', format_string('%.4f', {c} + 9), ',', format_string('%.4f', {c} + 1), ' ', format_string('%.4f', {c} + 4), ',', format_string('%.4f', {c} + 8)) all_points",
        f"{c} X", f"{c} / 2 Y", "if(s_nationkey % 4 = 2, 5.0D, -1.0D) RadiusX", "if(s_nationkey % 4 = 2, 3.0D, -1.0D) RadiusY",
        "6.0D Width", "4.0D Height")


ROIS = """SELECT s_suppkey AS id, s_nationkey % 4 AS k, s_nationkey % 5 = 0 AS exc, round(s_acctbal / CAST(100 AS DOUBLE), 4) AS c,
round(s_acctbal / CAST(100 AS DOUBLE), 4) / 2 AS cy, round(s_acctbal / CAST(100 AS DOUBLE) + 9, 4) AS c9, round(s_acctbal / CAST(100 AS DOUBLE) + 1, 4) AS c1,
round(s_acctbal / CAST(100 AS DOUBLE) + 4, 4) AS c4, round(s_acctbal / CAST(100 AS DOUBLE) + 8, 4) AS c8 FROM supplier"""
POINTS9 = "SELECT o_orderkey, o_custkey % 113 / CAST(2 AS DOUBLE) + 0.137::DOUBLE AS px, o_totalprice / CAST(10000 AS DOUBLE) + 0.00001::DOUBLE AS py FROM orders"


def edge(x1, y1, x2, y2):
    return f"(CASE WHEN ({y1} > py) <> ({y2} > py) AND px < ({x2} - {x1}) * (py - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END)"


HITS = f"""WITH r AS ({ROIS}), p AS ({POINTS9}), h AS (SELECT o_orderkey, id, exc FROM p JOIN r ON
(k = 0 AND ({edge('c', 'c', 'c9', 'c1')} + {edge('c9', 'c1', 'c4', 'c8')} + {edge('c4', 'c8', 'c', 'c')}) % 2 = 1)
OR (k = 1 AND px BETWEEN c AND c + 6 AND py BETWEEN cy AND cy + 4)
OR (k = 2 AND ((px - c) / 5) * ((px - c) / 5) + ((py - cy) / 3) * ((py - cy) / 3) <= 1))"""


def points9(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_custkey % 113 / 2.0D + 0.137D x", "o_totalprice / 10000.0D + 0.00001D y")


@bind("j9_points_in_shapes", HITS + ' SELECT o_orderkey, id AS roi_id FROM h')
def j9(spark, d):
    return sp.points_in_shapes(points9(spark, d), sp.normalise_rois(rois(spark, d)), 4.0).select("o_orderkey", "roi_id")


@bind("j9_points_in_large_shapes", HITS + ' SELECT o_orderkey, id AS roi_id FROM h')
def j9c(spark, d):
    """Shapes of some thousand cells a side."""
    return sp.points_in_shapes(points9(spark, d), sp.normalise_rois(rois(spark, d)), 0.002).select("o_orderkey", "roi_id")


@bind("j10_include_exclude", HITS + """, g AS (SELECT o_orderkey, bool_or(NOT exc) AS i, bool_or(exc) AS e FROM h GROUP BY 1)
SELECT p.o_orderkey, coalesce(i AND NOT e, FALSE) AS selected FROM p LEFT JOIN g USING (o_orderkey)""")
def j10(spark, d):
    p = points9(spark, d)
    picked = sp.select_by_shapes(p, sp.normalise_rois(rois(spark, d)), 4.0, "o_orderkey", F.col("Text").contains("exclude"))
    return picked.select("o_orderkey", "selected")


SLIDES = HITS.removesuffix(")").replace("JOIN r ON", "JOIN r ON o_orderkey % 3 = id % 3 AND (") + "))"


@bind("j9_points_by_slide", SLIDES + " SELECT o_orderkey, o_orderkey % 3 AS slide, id AS roi_id FROM h")
def j9b(spark, d):
    p = points9(spark, d).selectExpr("*", "o_orderkey % 3 slide")
    shapes = sp.normalise_rois(rois(spark, d).selectExpr("*", "Id % 3 slide"), ["slide"])
    return sp.points_in_shapes(p, shapes, 4.0, by=["slide"]).select("o_orderkey", "slide", "roi_id")


@bind("j10_selection_by_slide", SLIDES + """, g AS (SELECT o_orderkey, bool_or(NOT exc) AS i, bool_or(exc) AS e FROM h GROUP BY 1)
SELECT p.o_orderkey, p.o_orderkey % 3 AS slide, coalesce(i AND NOT e, FALSE) AS selected FROM p LEFT JOIN g USING (o_orderkey)""")
def j10b(spark, d):
    p = points9(spark, d).selectExpr("*", "o_orderkey % 3 slide")
    shapes = sp.normalise_rois(rois(spark, d).selectExpr("*", "Id % 3 slide"), ["slide"])
    picked = sp.select_by_shapes(p, shapes, 4.0, ["slide", "o_orderkey"], F.col("Text").contains("exclude"), by=["slide"])
    return picked.select("o_orderkey", "slide", "selected")


@bind("j11_radius_neighbours", f"""WITH p AS ({PTS}) SELECT a.vec_id AS src, b.vec_id AS dst, round(sqrt({d2()}), 8) AS dist
FROM p a JOIN p b ON a.vec_id <> b.vec_id AND {d2()} <= {R * R}""")
def j11(spark, d):
    e = sp.radius_neighbours(pts(spark, d), R, "vec_id")
    return e.withColumn("dist", F.round("dist", 8))


@bind("j12_nearest_neighbours", f"""WITH p AS ({PTS}), r AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt({d2()}) AS dist,
row_number() OVER (PARTITION BY a.vec_id ORDER BY {d2()}, b.vec_id) AS rk FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT src, dst, round(dist, 8) AS dist, CAST(rk AS INTEGER) AS "rank" FROM r WHERE rk <= 5""")
def j12(spark, d):
    n = sp.nearest_neighbours(pts(spark, d), pts(spark, d), 5, "vec_id", "vec_id", exclude_self=True)
    return n.withColumn("dist", F.round("dist", 8))


@bind("j12_nearest_two_sets", f"""WITH a AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey * 100 AS DOUBLE) AS y FROM customer),
b AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey * 100 AS DOUBLE) AS y FROM supplier),
r AS (SELECT a.id AS src, b.id AS dst, sqrt({d2()}) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {d2()}, b.id) AS rk FROM a, b)
SELECT src, dst, round(dist, 6) AS dist, CAST(rk AS INTEGER) AS "rank" FROM r WHERE rk <= 3""")
def j12b(spark, d):
    a = table(spark, d, "customer").selectExpr("c_custkey id", "c_acctbal x", "cast(c_nationkey * 100 as double) y")
    b = table(spark, d, "supplier").selectExpr("s_suppkey id", "s_acctbal x", "cast(s_nationkey * 100 as double) y")
    return sp.nearest_neighbours(a, b, 3, "id", "id").withColumn("dist", F.round("dist", 6))


@bind("j12_nearest_sets_apart", f"""WITH a AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey * 100 AS DOUBLE) AS y FROM customer),
b AS (SELECT o_orderkey AS id, o_totalprice + 10000000 AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders),
r AS (SELECT a.id AS src, b.id AS dst, sqrt({d2()}) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {d2()}, b.id) AS rk FROM a, b)
SELECT src, dst, round(dist, 4) AS dist, CAST(rk AS INTEGER) AS "rank" FROM r WHERE rk <= 3""")
def j12d(spark, d):
    a = table(spark, d, "customer").selectExpr("c_custkey id", "c_acctbal x", "cast(c_nationkey * 100 as double) y")
    b = table(spark, d, "orders").selectExpr("o_orderkey id", "o_totalprice + 10000000 x", "cast(o_custkey as double) y")
    return sp.nearest_neighbours(a, b, 3, "id", "id").withColumn("dist", F.round("dist", 4))


@bind("j12_nearest_with_copies", f"""WITH q AS (SELECT DISTINCT x, y FROM ({GRID})), t AS ({GRID}),
r AS (SELECT a.x, a.y, b.id, {d2('a', 'b')} AS d2, row_number() OVER (PARTITION BY a.x, a.y ORDER BY {d2('a', 'b')}, b.id) AS rk
FROM q a JOIN t b ON abs(a.x - b.x) <= 5 AND abs(a.y - b.y) <= 5)
SELECT g.id AS src, r.id AS dst, round(sqrt(d2), 8) AS dist, CAST(rk AS INTEGER) AS "rank" FROM ({GRID}) g JOIN r ON g.x = r.x AND g.y = r.y WHERE rk <= 3""")
def j12c(spark, d):
    g = grid_pts(spark, d)
    return sp.nearest_neighbours(g, g, 3, "id", "id").withColumn("dist", F.round("dist", 8))


CLASSES = list(range(10))


@bind("a27_composition", f"""WITH p AS ({PTS}), e AS (SELECT a.vec_id, b.label AS l FROM p a JOIN p b ON a.vec_id <> b.vec_id AND {d2()} <= {R * R}),
c AS (SELECT vec_id, count(*) AS t, {", ".join(f"count(*) FILTER (WHERE l = {c}) AS n_{c}" for c in CLASSES)} FROM e GROUP BY 1)
SELECT p.vec_id, p.label, {", ".join(f"coalesce(n_{c}, 0) AS n_{c}, round(n_{c} / CAST(t AS DOUBLE), 8) AS f_{c}" for c in CLASSES)} FROM p LEFT JOIN c USING (vec_id)""")
def a27(spark, d):
    c = nb.composition(pts(spark, d), R, "vec_id", "label", CLASSES)
    return c.withColumns({f"f_{k}": F.round(f"f_{k}", 8) for k in CLASSES})


@bind("a27_mean_composition", f"""WITH p AS ({GRID}), k AS (SELECT x, y, cls, count(*) AS n FROM p GROUP BY 1, 2, 3),
e AS (SELECT a.id, b.cls AS l, sum(b.n) - CASE WHEN any_value(a.cls) = b.cls THEN 1 ELSE 0 END AS n FROM p a JOIN k b ON {d2()} <= 2.25 GROUP BY a.id, b.cls)
SELECT p.cls, {", ".join(f"round(sum(CASE WHEN l = '{c}' THEN n ELSE 0 END) / CAST(count(DISTINCT p.id) AS DOUBLE), 6) AS n_{c}" for c in "FOP")} FROM p LEFT JOIN e USING (id) GROUP BY 1""")
def a27b(spark, d):
    c = nb.composition(grid_pts(spark, d), 1.5, "id", "cls", ["F", "O", "P"])
    m = nb.mean_composition(c, "cls", ["F", "O", "P"])
    return m.select("cls", *[F.round(f"n_{k}", 6).alias(f"n_{k}") for k in "FOP"])


@bind("a28_interaction_matrix", f"""WITH p AS ({GRID}), k AS (SELECT x, y, cls, count(*) AS n FROM p GROUP BY 1, 2, 3),
e AS (SELECT a.cls AS class_src, b.cls AS class_dst, CAST(sum(a.n * b.n - CASE WHEN a.x = b.x AND a.y = b.y AND a.cls = b.cls THEN a.n ELSE 0 END) AS BIGINT) AS n
FROM k a JOIN k b ON {d2()} <= 2.25 GROUP BY 1, 2)
SELECT class_src, class_dst, n, round(n / CAST(sum(n) OVER (PARTITION BY class_src) AS DOUBLE), 8) AS fraction FROM e""")
def a28(spark, d):
    m = nb.interaction_matrix(grid_pts(spark, d), 1.5, "cls")
    return m.withColumn("fraction", F.round("fraction", 8))


def enrichment_sql(cells: str, near: str, seed: int, perms: int) -> str:
    """Labels of every permutation written out: the network on ranks, walked until below the number of cells. ``cells``: (id, slide, cls, x, y)."""
    f = lambda v, k: (f"((((xor(({v} * 1103515245 + {k}) % 2147483648, (({v} * 1103515245 + {k}) % 2147483648) >> 15)) * 48271 + {k}) % 2147483647) >> 8) & ((1 << b) - 1)")
    key = lambda k: f"(({seed} * 7919 + perm * 104729 + {k} * 1299709 + 12345) % 2147483647)"
    step = "SELECT id, slide, perm, n, b, v >> b AS r0, v & ((1 << b) - 1) AS r1 FROM {}"
    for k in range(4):
        step = f"SELECT id, slide, perm, n, b, r1 AS r0, xor(r0, {f('r1', key(k))}) AS r1 FROM ({step})"
    step = f"SELECT id, slide, perm, n, b, (r0 << b) | r1 AS v FROM ({step})"
    return f"""WITH RECURSIVE p AS ({cells}),
k AS (SELECT id, slide, row_number() OVER (PARTITION BY slide ORDER BY x, y, id) - 1 AS v, count(*) OVER (PARTITION BY slide) AS n FROM p),
s AS (SELECT id, slide, perm, n, greatest(1, CAST(ceil(ceil(log2(n)) / 2) AS BIGINT)) AS b, v FROM k, (SELECT unnest(range(1, {perms + 1})) AS perm)),
w AS ({step.format('s')} UNION ALL {step.format('(SELECT * FROM w WHERE v >= n)')}),
c AS (SELECT slide, cls, sum(count(*)) OVER (PARTITION BY slide ORDER BY cls) - count(*) AS lo, sum(count(*)) OVER (PARTITION BY slide ORDER BY cls) AS hi FROM p GROUP BY 1, 2),
l AS (SELECT w.id, perm, cls FROM w JOIN c ON c.slide = w.slide AND v >= lo AND v < hi WHERE v < n UNION ALL SELECT id, 0, cls FROM p),
e AS (SELECT a.slide, a.id AS i, b.id AS j FROM p a JOIN p b ON a.slide = b.slide AND a.id <> b.id AND {near}),
m AS (SELECT slide, a.perm, a.cls AS class_src, b.cls AS class_dst, count(*) AS n FROM e JOIN l a ON a.id = i JOIN l b ON b.id = j AND b.perm = a.perm GROUP BY 1, 2, 3, 4),
z AS (SELECT slide, class_src, class_dst, coalesce(max(n) FILTER (perm = 0), 0) AS n, coalesce(sum(n) FILTER (perm > 0), 0) / CAST({perms} AS DOUBLE) AS mean,
      coalesce(sum(n * n) FILTER (perm > 0), 0) / CAST({perms} AS DOUBLE) AS sq FROM m GROUP BY 1, 2, 3)
SELECT slide, class_src, class_dst, n, round(mean, 6) AS mean, round(sqrt(greatest(sq - mean * mean, 0)), 6) AS std,
       CASE WHEN sq - mean * mean > 0 THEN round((n - mean) / sqrt(sq - mean * mean), 6) END AS z FROM z"""


def rounded_scores(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", "z")})


@bind("a29_enrichment", enrichment_sql(f"SELECT vec_id AS id, 0 AS slide, label AS cls, x, y FROM ({PTS})", f"{d2()} <= {R * R}", 11, 20).replace("SELECT slide, class_src, class_dst, n, round", "SELECT class_src, class_dst, n, round"))
def a29(spark, d):
    return rounded_scores(pm.enrichment(pts(spark, d), R, "label", perms=20, seed=11))


@bind("a29_enrichment_by_slide", enrichment_sql(f"SELECT id, id % 3 AS slide, cls, x, y FROM ({GRID})", f"{d2()} <= 1", 5, 8))
def a29b(spark, d):
    return rounded_scores(pm.enrichment(grid_pts(spark, d).selectExpr("*", "id % 3 slide"), 1.0, "cls", perms=8, seed=5, by=["slide"]))


@bind("a30_class_distances", f"""WITH p AS ({PTS}), c AS (SELECT DISTINCT label AS to_class FROM p),
r AS (SELECT a.vec_id, b.label AS to_class, sqrt({d2()}) AS dist, row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY {d2()}, b.vec_id) AS rk
FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT p.vec_id, p.label, c.to_class, round(avg(dist), 8) AS dist FROM p CROSS JOIN c LEFT JOIN r ON r.vec_id = p.vec_id AND r.to_class = c.to_class AND rk <= 2 GROUP BY 1, 2, 3""")
def a30(spark, d):
    c = nb.class_distances(pts(spark, d), "vec_id", "label", CLASSES, 2)
    return c.withColumn("dist", F.round("dist", 8))


@bind("a30_class_distances_by_slide", f"""WITH p AS (SELECT *, vec_id % 2 AS slide FROM ({PTS})), c AS (SELECT DISTINCT label AS to_class FROM p),
r AS (SELECT a.vec_id, b.label AS to_class, min(sqrt({d2()})) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id AND a.slide = b.slide GROUP BY 1, 2)
SELECT p.slide, p.vec_id, p.label, c.to_class, round(dist, 8) AS dist FROM p CROSS JOIN c LEFT JOIN r ON r.vec_id = p.vec_id AND r.to_class = c.to_class""")
def a30c(spark, d):
    c = nb.class_distances(pts(spark, d).selectExpr("*", "vec_id % 2 slide"), "vec_id", "label", CLASSES, 1, by=["slide"])
    return c.withColumn("dist", F.round("dist", 8))


@bind("a30_mean_class_distances", f"""WITH p AS ({PTS}),
r AS (SELECT a.label, b.label AS to_class, a.vec_id, min(sqrt({d2()})) AS dist FROM p a JOIN p b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3)
SELECT label, to_class, round(avg(dist), 8) AS dist FROM r GROUP BY 1, 2""")
def a30b(spark, d):
    m = nb.mean_class_distances(nb.class_distances(pts(spark, d), "vec_id", "label", CLASSES, 1), "label")
    return m.withColumn("dist", F.round("dist", 8))


@bind("f6_apply_affine", """SELECT o_orderkey, round(1.5 * o_custkey - 0.5 * o_orderkey + 10, 6) AS x, round(0.25 * o_custkey + 2 * o_orderkey - 3, 6) AS y,
CAST(o_custkey AS DOUBLE) AS bx, CAST(o_orderkey AS DOUBLE) AS by FROM orders""")
def f6(spark, d):
    m = af.affine(1.5, -0.5, 10, 0.25, 2, -3)
    x, y = F.col("o_custkey").cast("double"), F.col("o_orderkey").cast("double")
    moved = table(spark, d, "orders").select("o_orderkey", af.apply_x(m, x, y).alias("x"), af.apply_y(m, x, y).alias("y"))
    back = af.inverse(m)
    return moved.select("o_orderkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
                        F.round(af.apply_x(back, F.col("x"), F.col("y")), 4).alias("bx"),
                        F.round(af.apply_y(back, F.col("x"), F.col("y")), 4).alias("by"))


@bind("f7_compose_affines", """SELECT p_partkey, round(3 * (p_retailprice - 2) , 6) AS x, round(100 - 3 * (CAST(p_size AS DOUBLE) + 5), 6) AS y FROM part""")
def f7(spark, d):
    m = af.chain([af.translate(-2, 5), af.scale(3), af.flip(100, 50, vertical=True)])
    p = table(spark, d, "part").withColumn("m", m)
    x, y = F.col("p_retailprice"), F.col("p_size").cast("double")
    return p.select("p_partkey", F.round(af.apply_x(F.col("m"), x, y), 6).alias("x"), F.round(af.apply_y(F.col("m"), x, y), 6).alias("y"))


@bind("f8_shape_geometry", """WITH c AS (SELECT s_suppkey, round(s_acctbal / CAST(100 AS DOUBLE), 4) AS c FROM supplier)
SELECT s_suppkey, round(c, 4) AS x0, round(c, 4) AS y0, round(c + 9, 4) AS x1, round(c + 8, 4) AS y1,
round(c + 13.0 / 3, 4) AS cx, round(c + 9.0 / 3, 4) AS cy, round(34.0, 3)::DOUBLE AS area FROM c""")
def f8(spark, d):
    r = table(spark, d, "supplier").selectExpr("s_suppkey", "round(s_acctbal / 100.0D, 4) c")
    p = lambda dx, dy: F.struct((F.col("c") + dx).alias("x"), (F.col("c") + dy).alias("y"))
    r = r.withColumn("p", F.array(p(0, 0), p(9, 1), p(4, 8)))
    b, c = geo.bbox(F.col("p")), geo.centroid(F.col("p"))
    cols = {"x0": b.x0, "y0": b.y0, "x1": b.x1, "y1": b.y1, "cx": c.x, "cy": c.y}
    return r.select("s_suppkey", *[F.round(v, 4).alias(n) for n, v in cols.items()], F.round(geo.signed_area(F.col("p")), 3).alias("area"))

"""A4-A10, T1-T12, W10, X1-X4 on the driver tables.

Each embedding is an 8 x 8 tile of one large image, 25 tiles wide; the image grows with the table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from bindings import bind, table
from cellweave.operators import components as cp
from cellweave.operators import kernels as kn
from cellweave.operators import regions as rg
from cellweave.operators import stats as st
from cellweave.operators import tiles as tl

N = 25
PX = f"""SELECT (vec_id // {N}) * 8 + p // 8 AS y, (vec_id % {N}) * 8 + p % 8 AS x, label AS cls,
floor(CAST(embedding[p + 1] AS DOUBLE) * 100) AS value FROM embeddings, (SELECT unnest(range(64)) AS p)"""
# Objects: fixed 5 x 3 blocks of pixels, holes where the value is low; label 1 + block number.
LAB = f"SELECT y, x, cls, value, CASE WHEN value > -5 THEN 1 + (y // 5) * 1000 + x // 3 ELSE 0 END AS label FROM ({PX})"


def tiles(spark, d):
    return table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / N).alias("tile_row"), (F.col("vec_id") % N).alias("tile_col"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.transform("embedding", lambda v: F.floor(v.cast("double") * 100).cast("double")).alias("pixels"))


def px(spark, d):
    return tl.to_pixels(tiles(spark, d), 8)


def lab(spark, d):
    label = F.when(F.col("value") > -5, 1 + F.floor(F.col("y") / 5) * 1000 + F.floor(F.col("x") / 3)).otherwise(F.lit(0))
    return px(spark, d).withColumn("label", label.cast("long"))


def lab_tiles(spark, d, size=8):
    return tl.to_tiles(lab(spark, d), size, value="label")


def rounded(df, digits=6, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") and c not in skip else F.col(c) for c, t in df.dtypes])


def disk_sql(r):
    return f"(SELECT a, b FROM (SELECT unnest(range(-{r}, {r + 1})) AS a) s, (SELECT unnest(range(-{r}, {r + 1})) AS b) t WHERE a * a + b * b <= {r * r})"


SQUARE = "(SELECT a, b FROM (SELECT unnest(range(-2, 3)) AS a) s, (SELECT unnest(range(-2, 3)) AS b) t)"


def filt(how, r, src="p", offsets=None):
    return f"""SELECT q.y, q.x, {how}(p.label) AS v FROM (SELECT y, x, a, b, (SELECT max(y) FROM {src}) AS h FROM {src}, {offsets or disk_sql(r)}) q JOIN {src} p
ON p.y = (CASE WHEN q.y + a < 0 THEN -1 - (q.y + a) WHEN q.y + a > h THEN 2 * h + 1 - (q.y + a) ELSE q.y + a END)
AND p.x = (CASE WHEN q.x + b < 0 THEN -1 - (q.x + b) WHEN q.x + b > {N * 8 - 1} THEN {2 * N * 8 - 1} - (q.x + b) ELSE q.x + b END) GROUP BY 1, 2"""


@bind("a4_shape_table", f"""WITH g AS (SELECT label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1,
var_pop(y) + 1 / 12::DOUBLE AS a, var_pop(x) + 1 / 12::DOUBLE AS b, covar_pop(y, x) AS c FROM ({LAB}) WHERE label > 0 GROUP BY 1),
e AS (SELECT *, sqrt((a - b) / 2 * (a - b) / 2 + c * c) AS r FROM g), l AS (SELECT *, (a + b) / 2 + r AS l1, greatest((a + b) / 2 - r, 0) AS l2 FROM e)
SELECT label, area, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x, y0 AS bbox_y0, x0 AS bbox_x0, y1 AS bbox_y1, x1 AS bbox_x1,
round(area / CAST((y1 - y0) * (x1 - x0) AS DOUBLE), 6) AS extent, round(4 * sqrt(l1), 6) AS axis_major_length, round(4 * sqrt(l2), 5) AS axis_minor_length,
round(sqrt(greatest(1 - l2 / l1, 0)), 5) AS eccentricity FROM l""")
def a4(spark, d):
    s = rg.shape_table(lab(spark, d)).drop("orientation")
    return rounded(rounded(s, 6, ("axis_minor_length", "eccentricity")), 5, ("centroid_y", "centroid_x", "extent", "axis_major_length"))


@bind("a5_solidity", f"""WITH r AS (SELECT label, y, min(x) AS x0, max(x) AS x1, count(*) AS n FROM ({LAB}) WHERE label > 0 GROUP BY 1, 2),
a AS (SELECT label, CAST(sum(n) AS BIGINT) AS area FROM r GROUP BY 1),
c AS (SELECT DISTINCT label, y + d AS y, x0 - CAST(0.5 AS DOUBLE) AS x FROM r, (SELECT unnest([-0.5::DOUBLE, 0.5::DOUBLE]) AS d)
UNION SELECT DISTINCT label, y + d, x1 + CAST(0.5 AS DOUBLE) FROM r, (SELECT unnest([-0.5::DOUBLE, 0.5::DOUBLE]) AS d)),
h AS (SELECT p.label, p.x * q.y - q.x * p.y AS cr FROM c p JOIN c q ON p.label = q.label AND (p.x <> q.x OR p.y <> q.y) WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.label = p.label
AND ((q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) < 0 OR ((q.x - p.x) * (o.y - p.y) = (q.y - p.y) * (o.x - p.x)
AND ((q.x - p.x) * (o.x - p.x) + (q.y - p.y) * (o.y - p.y) < 0 OR (q.x - p.x) * (o.x - p.x) + (q.y - p.y) * (o.y - p.y) > (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)))))),
s AS (SELECT label, sum(cr) / 2 AS hull_area FROM h GROUP BY 1)
SELECT label, area, round(hull_area, 6) AS hull_area, round(area / hull_area, 6) AS solidity FROM a JOIN s USING (label)""")
def a5(spark, d):
    return rounded(rg.solidity(lab(spark, d)))


@bind("a6_intensity_stats", f"""SELECT label, count(*) AS "count", round(avg(value), 6) AS mean, median(value) AS median, round(stddev_pop(value), 6) AS std FROM ({LAB}) WHERE label > 0 GROUP BY 1""")
def a6(spark, d):
    return rounded(rg.intensity_stats(lab(spark, d).where("label > 0"), ["label"], "value"))


@bind("a7_stats_above_cutoff", f"""SELECT label, count(*) AS "count", round(avg(value), 6) AS mean, median(value) AS median, round(stddev_pop(value), 6) AS std,
count(*) FILTER (WHERE value > 8) AS count_above, round(avg(value) FILTER (WHERE value > 8), 6) AS mean_above, median(value) FILTER (WHERE value > 8) AS median_above,
round(stddev_pop(value) FILTER (WHERE value > 8), 6) AS std_above FROM ({LAB}) WHERE label > 0 GROUP BY 1""")
def a7(spark, d):
    return rounded(rg.intensity_stats(lab(spark, d).where("label > 0"), ["label"], "value", 8.0))


@bind("a8_quartiles", f"""SELECT label, cls, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM ({LAB}) WHERE label > 0 GROUP BY 1, 2""")
def a8(spark, d):
    p = lab(spark, d).where("label > 0")
    cls = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / N).alias("r"), (F.col("vec_id") % N).alias("c"), F.col("label").alias("cls"))
    p = p.withColumns({"r": F.floor(F.col("y") / 8), "c": F.floor(F.col("x") / 8)}).join(cls, ["r", "c"])
    return rg.intensity_quartiles(p, ["label", "cls"], "value")


@bind("a9_keep_largest", """SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def a9(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rg.keep_largest(li, ["l_orderkey"], "l_quantity")


@bind("a10_objects_per_file", """SELECT l_suppkey, count(DISTINCT CASE WHEN l_partkey % 3 > 0 THEN l_partkey END) AS n_objects FROM lineitem GROUP BY 1""")
def a10(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_suppkey", "if(l_partkey % 3 > 0, l_partkey, 0) label")
    return rg.objects_per_file(li, "l_suppkey")


@bind("t1_halo_ranges", f"""SELECT vec_id // {N} AS tile_row, vec_id % {N} AS tile_col, greatest((vec_id // {N}) * 8 - 3, 0) AS y0, least((vec_id // {N}) * 8 + 11, (SELECT (max(vec_id) // {N} + 1) * 8 FROM embeddings)) AS y1,
greatest((vec_id % {N}) * 8 - 3, 0) AS x0, least((vec_id % {N}) * 8 + 11, {N * 8}) AS x1 FROM embeddings""")
def t1(spark, d):
    from cellweave.operators.ordered import attach_one_row
    t = tiles(spark, d).select("tile_row", "tile_col")
    t = attach_one_row(t, t.agg(((F.max("tile_row") + 1) * 8).alias("_h")))
    return tl.halo_ranges(t, 8, 3, F.col("_h"), F.lit(N * 8).cast("long")).drop("_h")


@bind("t1_needed_halo", f"""WITH p AS (SELECT label, y // 8 AS r, x // 8 AS c, min(y) - (y // 8) * 8 AS t, max(y) - (y // 8) * 8 + 1 AS b, min(x) - (x // 8) * 8 AS l, max(x) - (x // 8) * 8 + 1 AS rt FROM ({LAB}) WHERE label > 0 GROUP BY label, y // 8, x // 8)
SELECT CAST(ceil(max(greatest(CASE WHEN t = 0 THEN b ELSE 0 END, CASE WHEN l = 0 THEN rt ELSE 0 END, CASE WHEN b = 8 THEN 8 - t ELSE 0 END, CASE WHEN rt = 8 THEN 8 - l ELSE 0 END)) / 4::DOUBLE) * 4 AS BIGINT) AS halo FROM p""")
def t1b(spark, d):
    return tl.needed_halo(lab(spark, d), 8, multiple=4)


@bind("t1_halo_exchange", f"""WITH p AS (SELECT y, x, value AS label FROM ({PX})), m AS ({filt('sum', 2, offsets=SQUARE)}) SELECT y, x, v AS value FROM m""")
def t1c(spark, d):
    square = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]
    import numpy as np
    box = tl.map_tiles(tiles(spark, d), 8, 2, lambda b: kn.rank_filter(b, square, np.add))
    return tl.to_pixels(box, 8)


@bind("t2_block_stats", f"""WITH b AS (SELECT y // 5 AS block_row, x // 5 AS block_col, value, count(*) AS n FROM ({PX}) GROUP BY 1, 2, 3)
SELECT block_row, block_col, round(sum(value * n) / 25, 6) AS mean, round(sum(value * value * n) / 25 - sum(value * n) / 25 * sum(value * n) / 25, 6) AS variance,
round(-sum(n / 25::DOUBLE * log2(n / 25::DOUBLE)), 6) AS entropy FROM b GROUP BY 1, 2 HAVING sum(n) = 25""")
def t2(spark, d):
    return rounded(tl.block_stats(px(spark, d), 5))


@bind("t3_focus_scores", f"""WITH p AS (SELECT vec_id, p // 8 AS y, p % 8 AS x, floor(CAST(embedding[p + 1] AS DOUBLE) * 100) AS v FROM embeddings, (SELECT unnest(range(64)) AS p)),
l AS (SELECT c.vec_id, a.v + b.v + e.v + f.v - 4 * c.v AS lap FROM p c JOIN p a ON a.vec_id = c.vec_id AND a.x = c.x AND a.y = abs(c.y - 1)
JOIN p b ON b.vec_id = c.vec_id AND b.x = c.x AND b.y = 7 - abs(7 - (c.y + 1)) JOIN p e ON e.vec_id = c.vec_id AND e.y = c.y AND e.x = abs(c.x - 1) JOIN p f ON f.vec_id = c.vec_id AND f.y = c.y AND f.x = 7 - abs(7 - (c.x + 1)))
SELECT vec_id // {N} AS tile_row, vec_id % {N} AS tile_col, round(var_pop(lap) + 3e-7::DOUBLE, 5) AS variance, round(sqrt(sum(lap * lap)), 5) AS norm FROM l GROUP BY vec_id""")
def t3(spark, d):
    # the shift keeps values off rounding ties
    return rounded(kn.focus_scores(tiles(spark, d)).withColumn("variance", F.col("variance") + 3e-7), 5)


@bind("t4_spot_candidates", f"""WITH RECURSIVE p AS ({PX}), l AS MATERIALIZED (SELECT c.y, c.x, c.y * {N * 8} + c.x AS id, c.value, 4 * c.value - coalesce(a.value, c.value) - coalesce(b.value, c.value) - coalesce(e.value, c.value) - coalesce(f.value, c.value) AS r
FROM p c LEFT JOIN p a ON a.y = c.y - 1 AND a.x = c.x LEFT JOIN p b ON b.y = c.y + 1 AND b.x = c.x LEFT JOIN p e ON e.y = c.y AND e.x = c.x - 1 LEFT JOIN p f ON f.y = c.y AND f.x = c.x + 1),
o AS (SELECT a, b FROM (SELECT unnest(range(-1, 2)) AS a) s, (SELECT unnest(range(-1, 2)) AS b) t WHERE a <> 0 OR b <> 0),
n AS MATERIALIZED (SELECT c.id AS s, d.id AS t, d.r - c.r AS step, abs(a) + abs(b) = 1 AS straight FROM (SELECT * FROM l, o) c JOIN l d ON d.y = c.y + a AND d.x = c.x + b),
w AS (SELECT s, s AS t FROM n WHERE step = 0 UNION SELECT w.s, n.t FROM w JOIN n ON n.s = w.t AND n.step = 0),
v AS (SELECT s, s AS t FROM n WHERE step = 0 AND straight UNION SELECT v.s, n.t FROM v JOIN n ON n.s = v.t AND n.step = 0 AND n.straight),
high AS (SELECT DISTINCT s FROM n WHERE step > 0), dead AS (SELECT s FROM high UNION SELECT w.s FROM w JOIN high ON w.t = high.s)
SELECT CAST(y AS INTEGER) AS "Y", CAST(x AS INTEGER) AS "X", r AS "_LoG_intensity", value AS channel_intensity FROM l
WHERE y > 0 AND x > 0 AND id NOT IN (SELECT s FROM dead) AND id NOT IN (SELECT s FROM v WHERE t < s)""")
def t4(spark, d):
    return kn.spot_candidates(tiles(spark, d), 8, 0.0)


@bind("t4_detect_spots")
def t4b(spark, d):
    return kn.detect_spots(tiles(spark, d), 8, 1.0)


@bind("t5_min_pool", f"""SELECT y // 3 AS y, x // 3 AS x, min(value) AS value FROM ({PX}) GROUP BY 1, 2 HAVING count(*) = 9""")
def t5(spark, d):
    return tl.pool(px(spark, d), 3, "min")


@bind("t5_pyramid", f"""WITH a AS (SELECT y, x, value FROM ({PX})), b AS (SELECT y // 2 AS y, x // 2 AS x, sum(value) / 4 AS value FROM a GROUP BY 1, 2), c AS (SELECT y // 2 AS y, x // 2 AS x, sum(value) / 4 AS value FROM b GROUP BY 1, 2)
SELECT y, x, round(value, 6) AS value, 0 AS level FROM a UNION ALL SELECT y, x, round(value, 6), 1 FROM b UNION ALL SELECT y, x, round(value, 6), 2 FROM c""")
def t5b(spark, d):
    return rounded(tl.pyramid(px(spark, d), 2))


@bind("t6_subtract_background")
def t6(spark, d):
    return tl.to_pixels(kn.subtract_background(tiles(spark, d), 8, 3.0), 8)


@bind("t7_outline", f"""WITH p AS ({LAB}), d AS ({filt('max', 1)}), e AS ({filt('min', 2)})
SELECT p.y, p.x, CAST(CASE WHEN d.v = e.v THEN 0 ELSE label END AS DOUBLE) AS label FROM p JOIN d ON p.y = d.y AND p.x = d.x JOIN e ON p.y = e.y AND p.x = e.x""")
def t7(spark, d):
    return tl.to_pixels(kn.outline(lab_tiles(spark, d), 8), 8, value="label")


@bind("t7_dilate", f"""WITH p AS ({LAB}), d AS ({filt('max', 2)}) SELECT y, x, CAST(v AS DOUBLE) AS label FROM d""")
def t7b(spark, d):
    return tl.to_pixels(kn.dilate(lab_tiles(spark, d), 8, 2), 8, value="label")


@bind("t7_expand_labels", f"""WITH p AS ({LAB}), n AS (SELECT q.y, q.x, p.label, (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) AS d2 FROM (SELECT y, x, a, b FROM p, {disk_sql(2)} WHERE label = 0) q JOIN p ON p.y = q.y + a AND p.x = q.x + b WHERE p.label > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY d2, label) AS rn FROM n)
SELECT p.y, p.x, CAST(CASE WHEN p.label > 0 THEN p.label ELSE coalesce(r.label, 0) END AS DOUBLE) AS label FROM p LEFT JOIN r ON p.y = r.y AND p.x = r.x AND rn = 1""")
def t7c(spark, d):
    return tl.to_pixels(kn.expand_labels(lab_tiles(spark, d), 8, 2), 8, value="label")


@bind("t7_to_binary", f"""WITH p AS ({LAB}), d AS ({filt('max', 1)}), e AS ({filt('min', 1)})
SELECT p.y, p.x, CAST(CASE WHEN d.v = e.v AND label > 0 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM p JOIN d ON p.y = d.y AND p.x = d.x JOIN e ON p.y = e.y AND p.x = e.x""")
def t7d(spark, d):
    return tl.to_pixels(kn.to_binary(lab_tiles(spark, d), 8), 8, value="label")


@bind("t8_label_components", f"""WITH RECURSIVE p AS (SELECT y, x, 1 + ((y // 8) * {N} + x // 8) * 64 + (y % 8) * 8 + x % 8 AS id FROM ({PX}) WHERE value > 8),
e AS (SELECT a.id AS s, b.id AS t FROM p a JOIN p b ON abs(a.y - b.y) + abs(a.x - b.x) = 1),
r AS (SELECT id, id AS root FROM p UNION SELECT e.t, r.root FROM r JOIN e ON e.s = r.id WHERE r.root < e.t)
SELECT p.y, p.x, min(root) AS label FROM r JOIN p ON p.id = r.id GROUP BY 1, 2""")
def t8(spark, d):
    mask = tiles(spark, d).withColumn("pixels", F.transform("pixels", lambda v: F.when(v > 8, 1.0).otherwise(0.0)))
    return cp.label_components(mask, 8, N)


@bind("t8_label_components_by_image", f"""WITH RECURSIVE p AS (SELECT y % {N // 2 * 8} AS y, x, y // {N // 2 * 8} AS image, value FROM ({PX}) WHERE value > 5),
q AS (SELECT image, y, x, 1 + ((y // 8) * {N} + x // 8) * 64 + (y % 8) * 8 + x % 8 AS id FROM p),
e AS (SELECT a.image, a.id AS s, b.id AS t FROM q a JOIN q b ON a.image = b.image AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.id <> b.id),
r AS (SELECT image, id, id AS root FROM q UNION SELECT r.image, e.t, r.root FROM r JOIN e ON e.image = r.image AND e.s = r.id WHERE r.root < e.t)
SELECT q.image, q.y, q.x, min(root) AS label FROM r JOIN q ON q.id = r.id AND q.image = r.image GROUP BY 1, 2, 3""")
def t8_image(spark, d):
    """Two images of half the height, touching corners connect."""
    mask = tiles(spark, d).withColumns({"pixels": F.transform("pixels", lambda v: F.when(v > 5, 1.0).otherwise(0.0)), "image": F.floor(F.col("tile_row") / (N // 2))})
    return cp.label_components(mask.withColumn("tile_row", F.col("tile_row") % (N // 2)), 8, N, eight=True, keys=["image"])


@bind("t8_connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a AS n, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.n WHERE r.root < u.b)
SELECT n AS node, min(root) AS component FROM r GROUP BY 1""")
def t8b(spark, d):
    e = table(spark, d, "lineitem").selectExpr("l_suppkey src", "l_partkey + 1000000 dst")
    return cp.connected_components(e)


@bind("t9_local_entropy", f"""WITH p AS ({PX}), w AS (SELECT q.y, q.x, p.value, count(*) AS n FROM (SELECT y, x, a, b FROM p, (SELECT unnest(range(-1, 2)) AS a) s, (SELECT unnest(range(-1, 2)) AS b) t) q JOIN p ON p.y = q.y + a AND p.x = q.x + b GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER (PARTITION BY y, x) AS s FROM w) SELECT y, x, round(-sum(n / s * log2(n / s)), 6) AS entropy FROM t GROUP BY 1, 2""")
def t9(spark, d):
    return rounded(tl.to_pixels(kn.local_entropy(tiles(spark, d), 8, 3), 8, value="entropy"))


def tissue_sql(src, k=5):
    """Tissue mask of images ``src (s, y, x, v)`` with ``v >= 0``: window side ``k``, dilation by the four neighbours."""
    r = k // 2
    return f"""WITH px AS (SELECT s, y, x, ln(1 + v) AS value FROM ({src})),
g AS (SELECT s, y, x, value, CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 1023) ELSE 0 END AS g FROM px JOIN (SELECT s, min(value) AS lo, max(value) AS hi FROM px GROUP BY s) USING (s)),
wn AS (SELECT g.s, g.y + a AS y, g.x + b AS x, g.g, count(*) AS c FROM g, (SELECT unnest(range(-{r}, {r + 1})) AS a) i, (SELECT unnest(range(-{r}, {r + 1})) AS b) j GROUP BY 1, 2, 3, 4),
en AS (SELECT s, y, x, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS e FROM wn GROUP BY 1, 2, 3),
p AS (SELECT s, y, x, value, e FROM px JOIN en USING (s, y, x)),
lim AS (SELECT s, min(e) AS lo, max(e) AS hi FROM p GROUP BY s),
h AS (SELECT s, bin, lo + (bin + 0.5) * (hi - lo) / 256 AS c, count(*) AS n FROM (SELECT s, lo, hi, CASE WHEN hi > lo THEN least(floor((e - lo) / (hi - lo) * 256), 255) ELSE 0 END AS bin FROM p JOIN lim USING (s)) GROUP BY ALL),
t AS (SELECT s, bin, c, sum(n) OVER w AS w1, sum(n * c) OVER w AS s1, sum(n) OVER (PARTITION BY s) AS w, sum(n * c) OVER (PARTITION BY s) AS st FROM h WINDOW w AS (PARTITION BY s ORDER BY bin)),
o AS (SELECT s, arg_max(c, w1 * (w - w1) * power(s1 / w1 - (st - s1) / (w - w1), 2)) AS t FROM t WHERE w1 < w GROUP BY s),
c AS (SELECT s, lo, hi, least(greatest(least(greatest(t, lo + 0.1 * (hi - lo)), hi - 0.1 * (hi - lo)) - 0.2 * (hi - lo), lo + 0.1 * (hi - lo)), hi - 0.1 * (hi - lo)) AS t FROM lim JOIN o USING (s)),
m AS (SELECT s, y, x, value, coalesce(e > t, false) AS inside FROM p LEFT JOIN c USING (s)),
q AS (SELECT s, quantile_cont(value, 0.25) AS b FROM m WHERE inside GROUP BY s),
z AS (SELECT s, y, x, value, inside OR coalesce(value >= b, false) AS seed FROM m LEFT JOIN q USING (s)),
d AS (SELECT DISTINCT s, y + a AS y, x + b AS x FROM z, {disk_sql(1)} WHERE seed),
u AS (SELECT z.s, z.y, z.x, value, d.s IS NOT NULL AS grown FROM z LEFT JOIN d ON z.s = d.s AND z.y = d.y AND z.x = d.x)
SELECT s, y, x, round(value, 9) AS value, grown OR avg(CAST(grown AS INTEGER)) OVER (PARTITION BY s) > 0.9 AS tissue FROM u"""


@bind("t9_tissue_mask", f"SELECT * EXCLUDE (s) FROM ({tissue_sql(f'SELECT 0 AS s, y, x, greatest(value, 0) AS v FROM ({PX})')})")
def t9b(spark, d):
    t = tiles(spark, d).withColumn("pixels", F.transform("pixels", lambda v: F.greatest(v, F.lit(0.0))))
    return kn.tissue_mask(t, 8, dilation=1, k=5).withColumn("value", F.round("value", 9))


SLIDES = f"""SELECT (vec_id // {N}) % 3 AS s, (vec_id // {N}) // 3 * 8 + p // 8 AS y, (vec_id % {N}) // 2 * 8 + p % 8 AS x,
greatest(max(floor(CAST(embedding[p + 1] AS DOUBLE) * 100)), 0) AS v FROM embeddings, (SELECT unnest(range(64)) AS p) GROUP BY 1, 2, 3"""


@bind("t9_tissue_mask_by_slide", f"SELECT s AS slide, * EXCLUDE (s) FROM ({tissue_sql(SLIDES)})")
def t9d(spark, d):
    """Three slides in one job, every second column of tiles a second channel of the place."""
    t = tiles(spark, d).select((F.col("tile_row") % 3).alias("slide"), (F.col("tile_col") % 2).alias("channel"), F.floor(F.col("tile_row") / 3).alias("tile_row"),
                               F.floor(F.col("tile_col") / 2).alias("tile_col"), "h", "w", F.transform("pixels", lambda v: F.greatest(v, F.lit(0.0))).alias("pixels"))
    return kn.tissue_mask(t, 8, dilation=1, k=5, keys=["slide"], channel="channel").withColumn("value", F.round("value", 9))


@bind("t9_apply_mask", f"""WITH m AS (SELECT y // 4 AS y, x // 4 AS x FROM ({PX}) GROUP BY 1, 2 HAVING avg(value) > 0)
SELECT p.y, p.x, CAST(CASE WHEN m.y IS NULL THEN 0 ELSE value END AS DOUBLE) AS value FROM ({PX}) p LEFT JOIN m ON p.y // 4 = m.y AND p.x // 4 = m.x""")
def t9c(spark, d):
    p = px(spark, d)
    mask = p.groupBy(F.floor(F.col("y") / 4).alias("y"), F.floor(F.col("x") / 4).alias("x")).agg((F.avg("value") > 0).alias("tissue"))
    return kn.apply_mask(p, mask, 4)


@bind("t10_kernel_density", """WITH g AS (SELECT CAST(floor(o_custkey / CAST(10 AS DOUBLE)) AS BIGINT) AS r, CAST(floor(o_totalprice / CAST(20000 AS DOUBLE)) AS BIGINT) AS c, count(*) AS n FROM orders GROUP BY 1, 2),
e AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, sum(n) AS t FROM g),
k AS (SELECT a, b, exp(-(a * a + b * b) / CAST(2 AS DOUBLE)) / (2 * pi()) AS k FROM (SELECT unnest(range(-4, 5)) AS a) s, (SELECT unnest(range(-4, 5)) AS b) u WHERE a * a + b * b <= 16)
SELECT r + a AS "row", c + b AS col, round(sum(n * k) / any_value(t), 9) AS density FROM g, k, e WHERE r + a BETWEEN r0 AND r1 AND c + b BETWEEN c0 AND c1 GROUP BY 1, 2""")
def t10(spark, d):
    pts = table(spark, d, "orders").selectExpr("o_totalprice / 20000D x", "o_custkey / 10D y")
    return rounded(tl.kernel_density(st.grid_counts(pts, "x", "y", 1)), 9)


@bind("t11_block_shifts", f"""WITH s AS (SELECT vec_id, vec_id % 8 AS a, vec_id // 8 % 8 AS b FROM embeddings)
SELECT vec_id // {N} AS tile_row, vec_id % {N} AS tile_col, CAST(CASE WHEN a > 4 THEN a - 8 ELSE a END AS DOUBLE) AS dy,
CAST(CASE WHEN b > 4 THEN b - 8 ELSE b END AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS error FROM s""")
def t11(spark, d):
    """Every tile is turned round by rows and columns of its own number, which the shift has to tell."""
    t = tiles(spark, d)
    k = F.col("tile_row") * N + F.col("tile_col")
    at = lambda i: F.pmod(F.floor(i / 8) - k % 8, F.lit(8)) * 8 + F.pmod(i % 8 - F.floor(k / 8) % 8, F.lit(8))
    moved = t.withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("pixels", at(i).cast("int"))))
    return rounded(kn.block_shifts(moved, t), 5)


@bind("t11_class_sums", f"""SELECT cls, y % 3 AS ch, round(sum(value * w), 4) AS weighted_sum, round(sum(CASE WHEN w > 0 THEN value ELSE 0 END), 4) AS support_sum FROM (SELECT *, ((y + x) % 4) / CAST(2 AS DOUBLE) - 0.5 AS w FROM ({PX})) WHERE w <> 0 GROUP BY 1, 2""")
def t11b(spark, d):
    p = px(spark, d).withColumn("ch", F.col("y") % 3)
    cls = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / N).alias("r"), (F.col("vec_id") % N).alias("c"), F.col("label").alias("cls"))
    maps = p.withColumns({"r": F.floor(F.col("y") / 8), "c": F.floor(F.col("x") / 8)}).join(cls, ["r", "c"]).select(
        "y", "x", "cls", ((F.col("y") + F.col("x")) % 4 / 2 - 0.5).alias("weight"))
    return rounded(tl.class_sums(p, maps, ["y", "x"], "ch", "cls"), 4)


POS = f"""SELECT vec_id, CAST(round_even(((vec_id // {N}) * 12.5::DOUBLE) / 2, 0) AS BIGINT) AS dy, CAST(round_even(((vec_id % {N}) * 19.0::DOUBLE) / 2, 0) AS BIGINT) AS dx FROM embeddings"""


@bind("t12_place_tiles", f"""WITH o AS ({POS}), p AS (SELECT vec_id, p // 8 AS y, p % 8 AS x, floor(CAST(embedding[p + 1] AS DOUBLE) * 100) AS value FROM embeddings, (SELECT unnest(range(64)) AS p)),
m AS (SELECT y + dy AS y, x + dx AS x, arg_max(value, vec_id) AS value FROM p JOIN o USING (vec_id) GROUP BY 1, 2), f AS (SELECT quantile_cont(floor(CAST(v AS DOUBLE) * 100), 0.9) AS f FROM (SELECT unnest(embedding) AS v FROM embeddings)),
g AS (SELECT y, unnest(range((SELECT max(x) + 1 FROM m))) AS x FROM (SELECT unnest(range((SELECT max(y) + 1 FROM m))) AS y))
SELECT g.y, g.x, coalesce(value, f) AS value FROM g CROSS JOIN f LEFT JOIN m ON g.y = m.y AND g.x = m.x""")
def t12(spark, d):
    from cellweave.operators.ordered import quantiles
    e = table(spark, d, "embeddings").select(
        "vec_id", (F.floor(F.col("vec_id") / N) * 12.5 + 40).alias("sy"), (F.col("vec_id") % N * 19.0 - 4).alias("sx"),
        F.transform("embedding", lambda v: F.floor(v.cast("double") * 100).cast("double")).alias("pixels"))
    at = tl.stage_offsets(e, "sx", "sy", 2.0)
    p = at.select("vec_id", "dy", "dx", F.posexplode("pixels").alias("i", "value")).withColumns(
        {"y": F.floor(F.col("i") / 8), "x": (F.col("i") % 8).cast("long")})
    fill = quantiles(p, [], "value", [0.9], wide=True).select(F.col("q")[0].alias("fill"))
    return tl.fill_gaps(tl.place_tiles(p, "vec_id"), fill)


@bind("t12_cut_tiles", f"""SELECT r AS tile_row, c AS tile_col, y - r * 6 AS y, x - c * 6 AS x, value FROM ({PX}) p,
(SELECT unnest(range(0, (SELECT max(y) // 6 + 1 FROM ({PX})))) AS r) a, (SELECT unnest(range(0, {N * 8 // 6 + 1})) AS c) b WHERE y >= r * 6 AND y < r * 6 + 8 AND x >= c * 6 AND x < c * 6 + 8""")
def t12b(spark, d):
    return tl.cut_tiles(px(spark, d), 8, 0.25)


@bind("w10_spaced_peaks")
def w10(spark, d):
    p = table(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice", "o_custkey % 997 x", "o_orderkey % 991 y")
    return cp.spaced_peaks(p, "o_orderkey", "o_totalprice", 25.0)


@bind("w10_relaxed_spacing")
def w10b(spark, d):
    p = table(spark, d, "orders").selectExpr("o_orderkey", "o_totalprice", "o_custkey % 997 x", "o_orderkey % 991 y")
    return cp.peaks_with_relaxed_spacing(p, "o_orderkey", "o_totalprice", 50, 120)


@bind("w10_relaxed_spacing_by_key")
def w10c(spark, d):
    p = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey % 997 x", "o_orderkey % 991 y")
    return cp.peaks_with_relaxed_spacing(p, "o_orderkey", "o_totalprice", 10, 120, keys=["o_orderstatus"])


@bind("x1_user_stats", f"""SELECT label, max(value) - min(value) AS spread, count(*) FILTER (WHERE value > 10) AS bright FROM ({LAB}) WHERE label > 0 GROUP BY 1""")
def x1(spark, d):
    return rg.user_stats(lab(spark, d).where("label > 0"), ["label"], {
        "spread": F.max("value") - F.min("value"), "bright": F.count_if(F.col("value") > 10)})


@bind("x2_user_block_function", f"""SELECT y // 8 AS tile_row, x // 8 AS tile_col, max(value) AS top FROM ({PX}) GROUP BY 1, 2""")
def x2(spark, d):
    def fn(block, own):
        return pd.DataFrame({"tile_row": [own.row], "tile_col": [own.col], "top": [float(tl.trim(block, own).max())]})

    return tl.apply_blocks(tiles(spark, d), 8, 2, fn, "tile_row bigint, tile_col bigint, top double")


@bind("x3_user_row_function", """SELECT c_custkey, length(c_name) AS name_len, round(c_acctbal * 2 + c_nationkey, 4) AS score FROM customer""")
def x3(spark, d):
    from cellweave.plans.extend import add_columns
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    out = add_columns(c, {"name_len": F.length("c_name").cast("long")}, rows=lambda pdf: pdf.assign(score=(pdf.c_acctbal * 2 + pdf.c_nationkey)), schema="score double")
    return out.select("c_custkey", "name_len", F.round("score", 4).alias("score"))


@bind("x4_functions_per_marker", """WITH v AS (SELECT l_returnflag AS sample, 'l_quantity' AS marker, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem),
f AS (SELECT sample, marker, 1 / (max(value) - min(value)) AS slope, -min(value) / (max(value) - min(value)) AS intercept FROM v GROUP BY 1, 2)
SELECT sample, marker, round(sum(value * slope + intercept), 3) AS total, count(*) AS n FROM v JOIN f USING (sample, marker) GROUP BY 1, 2""")
def x4(spark, d):
    from cellweave.plans.extend import apply_lines
    wide = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample"), "l_quantity", "l_tax")
    long = st.unpivot_markers(wide, ["sample"], ["l_quantity", "l_tax"])
    span = F.max("value") - F.min("value")
    lines = long.groupBy("sample", "marker").agg((1 / span).alias("slope"), (-F.min("value") / span).alias("intercept"))
    out = apply_lines(long, lines, ["sample", "marker"])
    return out.groupBy("sample", "marker").agg(F.round(F.sum("value"), 3).alias("total"), F.count(F.lit(1)).alias("n"))

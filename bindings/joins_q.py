"""J1-J8, J13-J16, A1, A2 and the flagship query on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import bind, table
from cellweave.operators import frames as fr
from cellweave.operators import joins as jn
from cellweave.operators import runs as rn
from cellweave.operators import regions as rg
from cellweave.plans import spots

SPOTS = "SELECT l_partkey AS mask_id, l_returnflag AS channel, l_extendedprice AS v FROM lineitem WHERE l_partkey > 0 AND l_extendedprice > 0"


def spot_rows(spark, d):
    li = table(spark, d, "lineitem")
    return li.selectExpr("l_partkey mask_id", "l_returnflag channel", "l_extendedprice channel_intensity")


def wide(cast=""):
    return ", ".join(
        f"round_even(coalesce(sum(v) FILTER (WHERE channel = '{c}'), 0), 2) AS sum_peak_int_{c}, "
        f"CAST(count(*) FILTER (WHERE channel = '{c}') AS DOUBLE) AS count_{c}" for c in "ANR")


@bind("entry_spot_counts", f"""WITH s AS ({SPOTS}), w AS (SELECT mask_id, {wide()} FROM s GROUP BY mask_id)
SELECT p_partkey, p_size, p_retailprice, {", ".join(f"coalesce(sum_peak_int_{c}, 0) AS sum_peak_int_{c}, coalesce(count_{c}, 0) AS count_{c}" for c in "ANR")}
FROM part LEFT JOIN w ON p_partkey = mask_id""")
def entry_spot_counts(spark, d):
    cells = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return spots.cell_table_with_spots(cells, spot_rows(spark, d), "p_partkey", ["A", "N", "R"])


@bind("a1_spots_per_cell", f"""SELECT mask_id, channel, round(sum(v), 2) AS sum_peak_int, count(*) AS "count" FROM ({SPOTS}) GROUP BY 1, 2""")
def a1(spark, d):
    out = rg.spots_per_object(spot_rows(spark, d), ["channel"])
    return out.withColumn("sum_peak_int", F.round("sum_peak_int", 2))


@bind("a2_log_spots_per_cell", f"""SELECT mask_id, channel, round(sum(log10(v)), 6) AS sum_log_int FROM ({SPOTS}) GROUP BY 1, 2""")
def a2(spark, d):
    out = rg.log_intensity_per_object(spot_rows(spark, d), ["channel"])
    return out.withColumn("sum_log_int", F.round("sum_log_int", 6))


@bind("j1_left_join", """SELECT c_custkey, n_name, c_acctbal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def j1(spark, d):
    n = table(spark, d, "nation").selectExpr("n_nationkey c_nationkey", "n_name")
    return jn.attach(table(spark, d, "customer"), n, ["c_nationkey"]).select("c_custkey", "n_name", "c_acctbal")


@bind("j2_outer_merge", f"""SELECT mask_id, {wide()} FROM ({SPOTS}) GROUP BY mask_id""")
def j2(spark, d):
    per = rg.spots_per_object(spot_rows(spark, d), ["channel"])
    frames = {c: per.where(F.col("channel") == c) for c in "ANR"}
    return fr.fill_and_round(jn.merge_long(frames, ["mask_id"], ["sum_peak_int", "count"]))


@bind("j3_inner_suffixed", """SELECT a.l_partkey, a.n AS n_x, b.n AS n_y FROM
(SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN
(SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.l_partkey = b.l_partkey""")
def j3(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda f: li.where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return jn.inner_suffixed(side("A"), side("R"), ["l_partkey"])


@bind("j4_shape_with_channels", """SELECT p_partkey, p_size, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS mean_A,
max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS top_A,
round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS mean_R, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS top_R
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_size""")
def j4(spark, d):
    shapes = table(spark, d, "part").select("p_partkey", "p_size")
    px = table(spark, d, "lineitem").selectExpr("l_partkey p_partkey", "l_returnflag ch", "l_quantity v")
    stats = {"mean": F.round(F.avg("v"), 6), "top": F.max("v")}
    return jn.shape_with_channels(shapes, px, ["p_partkey"], "ch", ["A", "R"], stats)


@bind("j5_strict_lookup", "SELECT o_orderkey, c_name AS owner FROM orders JOIN customer ON o_custkey = c_custkey")
def j5(spark, d):
    names = table(spark, d, "customer").selectExpr("c_custkey o_custkey", "c_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return jn.strict_lookup(o, names, "o_custkey", "c_name", "owner").select("o_orderkey", "owner")


@bind("j6_unmatched", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j6(spark, d):
    return jn.unmatched(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


MASK = """SELECT CAST(l_suppkey AS BIGINT) AS y, CAST(l_linenumber AS BIGINT) AS x, CAST(max(l_quantity) AS BIGINT) AS label
FROM lineitem GROUP BY 1, 2"""


def mask_pixels(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_suppkey y", "cast(l_linenumber as long) x", "l_quantity")
    return li.groupBy("y", "x").agg(F.max("l_quantity").cast("long").alias("label"))


@bind("j7_gather", f"""SELECT o_orderkey, coalesce(label, 0) AS mask_id FROM orders LEFT JOIN
(SELECT * FROM ({MASK}) WHERE label > 0) m ON o_custkey = m.y AND o_orderkey % 9 = m.x""")
def j7(spark, d):
    pts = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey y", "o_orderkey % 9 x")
    px = mask_pixels(spark, d).where(F.col("label") > 0)
    return jn.gather(pts, px, ["y", "x"]).select("o_orderkey", "mask_id")


@bind("j7_gather_runs", f"""SELECT o_orderkey, coalesce(label, 0) AS mask_id FROM orders LEFT JOIN
(SELECT * FROM ({MASK}) WHERE label > 0) m ON o_custkey = m.y AND o_orderkey % 9 = m.x""")
def j7c(spark, d):
    pts = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey y", "o_orderkey % 9 x")
    return rn.gather_runs(pts, rn.pixels_to_runs(mask_pixels(spark, d))).select("o_orderkey", "mask_id")


@bind("j7_gather_tiles", """SELECT o_orderkey, CAST(coalesce(trunc(CAST(embedding[(o_orderkey % 8) * 8 + (o_custkey % 8) + 1] AS DOUBLE) * 1000), 0) AS BIGINT) AS mask_id
FROM orders LEFT JOIN embeddings ON vec_id = o_orderkey // 8 AND o_custkey // 8 = 3""")
def j7b(spark, d):
    tiles = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("tile_row"), F.lit(3).cast("long").alias("tile_col"), F.lit(8).alias("w"),
        F.transform("embedding", lambda v: (v.cast("double") * 1000).cast("long")).alias("pixels"))
    pts = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey Y", "o_custkey X")
    return jn.gather_tiles(pts, tiles, 8).select("o_orderkey", "mask_id")


@bind("j8_recolour", f"""SELECT y, x, m.label, CAST(CASE WHEN m.label <= 45 THEN 0 ELSE coalesce(c.n, 1) END AS INTEGER) AS value
FROM (SELECT y, x, CASE WHEN label <= 45 THEN 0 ELSE label END AS label FROM ({MASK})) m LEFT JOIN
(SELECT p_size AS label, CAST(round_even(avg(p_retailprice), 0) AS INTEGER) + 1 AS n FROM part WHERE p_size <> 47 GROUP BY p_size) c ON m.label = c.label""")
def j8(spark, d):
    px = mask_pixels(spark, d).withColumn("label", F.when(F.col("label") <= 45, 0).otherwise(F.col("label")))
    per = table(spark, d, "part").where("p_size <> 47").groupBy(F.col("p_size").cast("long").alias("label")).agg(
        F.avg("p_retailprice").alias("n"))
    return jn.recolour(px, jn.counts_as_colours(per, "n"), "n", missing=1, background=0)


@bind("j8_recolour_runs", f"""SELECT y, x, CAST(coalesce(c.n, 1) AS INTEGER) AS value FROM ({MASK}) m LEFT JOIN
(SELECT p_size AS label, CAST(round_even(avg(p_retailprice), 0) AS INTEGER) + 1 AS n FROM part WHERE p_size <> 47 GROUP BY p_size) c ON m.label = c.label WHERE m.label > 0""")
def j8b(spark, d):
    per = table(spark, d, "part").where("p_size <> 47").groupBy(F.col("p_size").cast("long").alias("label")).agg(F.avg("p_retailprice").alias("n"))
    painted = rn.recolour_runs(rn.pixels_to_runs(mask_pixels(spark, d)), jn.counts_as_colours(per, "n"), "n", missing=1)
    return rn.runs_to_pixels(painted, value="value")


PATTERN = """SELECT user_id, bool_or(event_type = 'click') AS click, bool_or(event_type = 'purchase') AS purchase,
bool_or(event_type = 'error') AS error FROM events GROUP BY user_id"""


def patterns(spark, d):
    ev = table(spark, d, "events")
    return ev.groupBy("user_id").agg(*[F.bool_or(F.col("event_type") == t).alias(t) for t in ("click", "purchase", "error")])


@bind("j13_condition_map", f"""SELECT user_id, click, purchase, error, CASE WHEN click AND purchase AND error THEN 'all'
WHEN click AND NOT purchase AND NOT error THEN 'looker' WHEN NOT click AND NOT purchase AND error THEN 'broken' ELSE 'Others' END AS cell_type
FROM ({PATTERN})""")
def j13(spark, d):
    ask = [(True, True, True, "all"), (True, False, False, "looker"), (False, False, True, "broken")]
    cond = spark.createDataFrame(ask, "click boolean, purchase boolean, error boolean, cell_type string")
    return jn.type_by_pattern(patterns(spark, d), cond, ["click", "purchase", "error"])


@bind("j14_rank_pairs", """WITH a AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem WHERE l_returnflag = 'R')
SELECT a.v AS v1, b.v AS v2, count(*) AS pairs FROM a JOIN b ON a.r = b.r GROUP BY 1, 2""")
def j14(spark, d):
    return jn.rank_pairs(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "A", "R")


@bind("j14_rank_pairs_distinct", """WITH a AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r FROM lineitem WHERE l_returnflag = 'R')
SELECT a.v AS v1, b.v AS v2, count(*) AS pairs FROM a JOIN b ON a.r = b.r GROUP BY 1, 2""")
def j14b(spark, d):
    return jn.rank_pairs(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "A", "R")


def half_masks(flag):
    return f"""SELECT l_suppkey AS y, l_partkey AS x, max(CAST(l_quantity AS BIGINT)) AS label FROM lineitem
WHERE l_returnflag = '{flag}' GROUP BY 1, 2"""


@bind("j15_mask_difference", f"""WITH a AS ({half_masks('A')}), b AS ({half_masks('R')}),
j AS (SELECT coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, a.label AS la, b.label AS lb FROM a FULL JOIN b ON a.y = b.y AND a.x = b.x),
w AS (SELECT y // 10 AS r, x // 10 AS c, count(la) > count(lb) AS f FROM j GROUP BY 1, 2)
SELECT y, x, CASE WHEN f THEN coalesce(la, 0) ELSE coalesce(lb, 0) END AS label FROM j JOIN w ON y // 10 = r AND x // 10 = c
WHERE coalesce(la, 0) <> coalesce(lb, 0) AND CASE WHEN f THEN coalesce(la, 0) ELSE coalesce(lb, 0) END > 0""")
def j15(spark, d):
    li = table(spark, d, "lineitem")
    mask = lambda f: li.where(F.col("l_returnflag") == f).groupBy(F.col("l_suppkey").alias("y"), F.col("l_partkey").alias("x")).agg(
        F.max(F.col("l_quantity").cast("long")).alias("label"))
    return jn.mask_difference(mask("A"), mask("R"), block=10)


@bind("j15_mask_difference_runs", f"""WITH a AS ({half_masks('A')}), b AS ({half_masks('R')}),
j AS (SELECT coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, a.label AS la, b.label AS lb FROM a FULL JOIN b ON a.y = b.y AND a.x = b.x),
w AS (SELECT y // 10 AS r, x // 10 AS c, count(la) > count(lb) AS f FROM j GROUP BY 1, 2)
SELECT y, x, CASE WHEN f THEN coalesce(la, 0) ELSE coalesce(lb, 0) END AS label FROM j JOIN w ON y // 10 = r AND x // 10 = c
WHERE coalesce(la, 0) <> coalesce(lb, 0) AND CASE WHEN f THEN coalesce(la, 0) ELSE coalesce(lb, 0) END > 0""")
def j15b(spark, d):
    li = table(spark, d, "lineitem")
    mask = lambda f: rn.pixels_to_runs(li.where(F.col("l_returnflag") == f).select(
        F.col("l_suppkey").alias("y"), F.col("l_partkey").alias("x"), F.col("l_quantity").cast("long").alias("label")))
    return rn.runs_to_pixels(rn.difference_runs(mask("A"), mask("R"), block=10))


@bind("a31_mask_agreement_runs", f"""WITH a AS ({half_masks('A')}), b AS ({half_masks('R')}),
j AS (SELECT coalesce(a.label, 0) AS a, coalesce(b.label, 0) AS b FROM a FULL JOIN b ON a.y = b.y AND a.x = b.x)
SELECT round(count(*) FILTER (a > 0 AND b > 0) / CAST(count(*) AS DOUBLE), 8) AS iou, round(count(*) FILTER (a > 0) / CAST(1000000 AS DOUBLE), 8) AS fraction_a,
round(count(*) FILTER (b > 0) / CAST(1000000 AS DOUBLE), 8) AS fraction_b, count(*) FILTER (abs(a - b) > 0) AS differ,
count(*) FILTER (abs(a - b) >= 2) AS differ_2, count(*) FILTER (abs(a - b) >= 3) AS differ_3 FROM j""")
def a31_runs(spark, d):
    li = table(spark, d, "lineitem")
    mask = lambda f: rn.pixels_to_runs(li.where(F.col("l_returnflag") == f).select(
        F.col("l_suppkey").alias("y"), F.col("l_partkey").alias("x"), F.col("l_quantity").cast("long").alias("label")))
    return rn.agreement_runs(mask("A"), mask("R"), 1_000_000).withColumns({c: F.round(c, 8) for c in ("iou", "fraction_a", "fraction_b")})


@bind("j16_missing_combinations", """SELECT l_suppkey, l_shipmonth, l_returnflag, l_linestatus FROM
(SELECT DISTINCT l_suppkey FROM lineitem) a, (SELECT DISTINCT month(l_shipdate) * 100 + day(l_shipdate) AS l_shipmonth FROM lineitem) b,
(SELECT DISTINCT l_returnflag FROM lineitem) c, (SELECT DISTINCT l_linestatus FROM lineitem) e
EXCEPT SELECT l_suppkey, month(l_shipdate) * 100 + day(l_shipdate), l_returnflag, l_linestatus FROM lineitem""")
def j16(spark, d):
    li = table(spark, d, "lineitem").selectExpr("*", "cast(month(l_shipdate) * 100 + day(l_shipdate) as long) as l_shipmonth")
    return jn.missing_combinations(li, ["l_suppkey", "l_shipmonth", "l_returnflag", "l_linestatus"])

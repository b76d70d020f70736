"""A3, A11-A26, A31-A33, W6-W9 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import bind, table
from cellweave.operators import joins as jn
from cellweave.operators import mixture as mx
from cellweave.operators import regions as rg
from cellweave.operators import sketches as sk
from cellweave.operators import stats as st
from cellweave.operators.ordered import quantiles
from cellweave.session import fresh_path


def li(spark, d):
    return table(spark, d, "lineitem")


def hist_sql(by, value, bins, src="lineitem", lo=None, hi=None):
    """Histogram CTEs ``lim`` and ``hist(by, bin, "left", "right", n)``."""
    lo, hi = lo or f"min({value})", hi or f"max({value})"
    return f"""lim AS (SELECT {by}, {lo} AS lo, {hi} AS hi FROM {src} GROUP BY {by}),
got AS (SELECT s.{by}, CAST(least(floor(({value} - lo) / (hi - lo) * {bins}), {bins} - 1) AS INTEGER) AS bin, count(*) AS n
 FROM {src} s JOIN lim USING ({by}) WHERE {value} >= lo AND {value} <= hi GROUP BY 1, 2),
hist AS (SELECT g.{by}, g.bin, lo + g.bin * ((hi - lo) / {bins}) AS "left", lo + (g.bin + 1) * ((hi - lo) / {bins}) AS "right", coalesce(n, 0) AS n
 FROM (SELECT {by}, lo, hi, CAST(unnest(range({bins})) AS INTEGER) AS bin FROM lim) g LEFT JOIN got ON g.{by} = got.{by} AND g.bin = got.bin)"""


@bind("a11_histogram", f"""WITH {hist_sql('l_returnflag', 'l_extendedprice', 20)}
SELECT l_returnflag, bin, round("left", 4) AS "left", round("right", 4) AS "right", n,
round(n / sum(n) OVER (PARTITION BY l_returnflag) / ("right" - "left"), 12) AS density,
round(100 * n / sum(n) OVER (PARTITION BY l_returnflag), 8) AS percent,
round(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) / sum(n) OVER (PARTITION BY l_returnflag), 8) AS cumulative FROM hist""")
def a11(spark, d):
    h = st.histogram(li(spark, d), ["l_returnflag"], "l_extendedprice", 20)
    digits = {"left": 4, "right": 4, "density": 12, "percent": 8, "cumulative": 8}
    return h.withColumns({c: F.round(c, n) for c, n in digits.items()})


@bind("a12_grid_counts", """SELECT CAST(floor(l_discount * 100 / 2) AS BIGINT) AS "row", CAST(floor(l_quantity / 5) AS BIGINT) AS col,
count(*) FILTER (WHERE l_linenumber = 3 AND l_tax > CAST(0.02 AS DOUBLE)) AS n FROM lineitem GROUP BY 1, 2""")
def a12(spark, d):
    pts = li(spark, d).withColumn("d100", F.col("l_discount") * 100)
    return st.grid_counts(
        pts.withColumns({"gx": F.col("l_quantity") / 5, "gy": F.col("d100") / 2}), "gx", "gy", 1, "(l_linenumber == 3) & (l_tax > 0.02D)")


@bind("a12_grid_counts_rounded", """SELECT CAST(round_even(o_custkey / CAST(100 AS DOUBLE), 0) AS BIGINT) AS "row",
CAST(round_even(o_totalprice / CAST(50000 AS DOUBLE), 0) AS BIGINT) AS col, count(*) AS n FROM orders GROUP BY 1, 2""")
def a12b(spark, d):
    return st.grid_counts(
        table(spark, d, "orders").selectExpr("o_totalprice / 50000D gx", "o_custkey / 100D gy"), "gx", "gy", 1, None, "round")


@bind("a13_shared_cells", """SELECT CAST(floor(o_custkey / CAST(10 AS DOUBLE)) AS BIGINT) AS "row", CAST(floor(o_totalprice / CAST(10000 AS DOUBLE)) AS BIGINT) AS col,
count(DISTINCT o_orderstatus) AS classes FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1""")
def a13(spark, d):
    pts = table(spark, d, "orders").selectExpr("o_totalprice / 10000D x", "o_custkey / 10D y", "o_orderstatus")
    return st.shared_cells(pts, "x", "y", 1, "o_orderstatus")


@bind("a14_quantiles", """SELECT l_returnflag, unnest([0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0])::DOUBLE AS p,
round(unnest(quantile_cont(l_extendedprice, [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0])), 6) AS q FROM lineitem GROUP BY l_returnflag""")
def a14(spark, d):
    q = quantiles(li(spark, d), ["l_returnflag"], "l_extendedprice", [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0])
    return q.withColumn("q", F.round("q", 6))


QQ = [0.9 + 0.099 * i / 9 for i in range(10)]


@bind("a14_quantile_pairs", f"""WITH v AS (SELECT l_returnflag AS f, ln(1 + l_extendedprice) AS v FROM lineitem),
a AS (SELECT unnest({QQ})::DOUBLE AS p, unnest(quantile_cont(v, {QQ})) AS q1 FROM v WHERE f = 'A'),
b AS (SELECT unnest({QQ})::DOUBLE AS p, unnest(quantile_cont(v, {QQ})) AS q2 FROM v WHERE f = 'R')
SELECT round(a.p, 6) AS p, round(q1, 6) AS q1, round(q2, 6) AS q2 FROM a JOIN b ON a.p = b.p""")
def a14b(spark, d):
    src = li(spark, d).withColumn("v", F.log1p("l_extendedprice"))
    q = st.quantile_pairs(src, "l_returnflag", "v", "A", "R", QQ)
    return q.select(*[F.round(c, 6).alias(c) for c in ("p", "q1", "q2")])


@bind("a15_tail_means", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, round(avg(l_extendedprice) FILTER (WHERE l_extendedprice <= lo), 4) AS low_mean,
round(avg(l_extendedprice) FILTER (WHERE l_extendedprice >= hi), 4) AS high_mean FROM lineitem l JOIN q USING (l_returnflag) GROUP BY 1""")
def a15(spark, d):
    t = st.tail_means(li(spark, d), ["l_returnflag"], "l_extendedprice", 0.01, 0.99)
    return t.select("l_returnflag", F.round("low_mean", 4).alias("low_mean"), F.round("high_mean", 4).alias("high_mean"))


@bind("a16_anchors", """WITH v AS (SELECT l_returnflag AS sample, 'l_quantity' AS marker, ln(1 + l_quantity) AS value FROM lineitem
UNION ALL SELECT l_returnflag, 'l_extendedprice', ln(1 + l_extendedprice) FROM lineitem),
q AS (SELECT sample, marker, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM v GROUP BY 1, 2),
t AS (SELECT sample, marker, any_value(mn) AS mn, any_value(mx) AS mx, avg(value) FILTER (WHERE value <= lo) AS a, avg(value) FILTER (WHERE value >= hi) AS b FROM v JOIN q USING (sample, marker) GROUP BY 1, 2)
SELECT sample, marker, 'min' AS anchor, round(mn, 6) AS value FROM t UNION ALL SELECT sample, marker, 'max', round(mx, 6) FROM t
UNION ALL SELECT sample, marker, 't5_low', round(a, 6) FROM t UNION ALL SELECT sample, marker, 't5_high', round(b, 6) FROM t""")
def a16(spark, d):
    long = st.unpivot_markers(li(spark, d).select(F.col("l_returnflag").alias("sample"), "l_quantity", "l_extendedprice"),
                              ["sample"], ["l_quantity", "l_extendedprice"])
    a = st.anchors(long.withColumn("value", F.log1p("value")), ["sample", "marker"], "value", {"t5": (0.05, 0.95)})
    return a.withColumn("value", F.round("value", 6))


@bind("a16_mixture_peaks")
def a16b(spark, d):
    long = li(spark, d).select("l_returnflag", F.log1p("l_extendedprice").alias("v"))
    return mx.mixture_table(long, ["l_returnflag"], "v", 2)


@bind("a17_mixture_cutoffs")
def a17(spark, d):
    src = li(spark, d).select("l_orderkey", F.log1p("l_extendedprice").alias("v"))
    mix = mx.fit_mixture(src, "v", 2)
    cuts = F.array(*[F.lit(c) for c in mx.cutoff_values(mix)])
    return src.select("l_orderkey", mix.component(F.col("v")).alias("component"), F.size(F.filter(cuts, lambda c: c < F.col("v"))).alias("above"))


@bind("a18_auto_gate")
def a18(spark, d):
    src = li(spark, d).select("l_orderkey", "l_extendedprice", F.log1p("l_extendedprice").alias("v"))
    gate = mx.auto_gate(mx.fit_mixture(src, "v", 3), 1.0)
    return src.select("l_orderkey", (F.col("l_extendedprice") > gate).alias("positive"))


@bind("a19_channel_windows")
def a19(spark, d):
    return mx.channel_windows(li(spark, d), "l_returnflag", "l_extendedprice", 2)


@bind("a20_fit_lines", """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1""")
def a20(spark, d):
    f = st.fit_lines(li(spark, d), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return f.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@bind("a20_fit_ranked_pairs", """WITH a AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem WHERE l_returnflag = 'R')
SELECT round(regr_slope(b.v, a.v), 6) AS slope, round(regr_intercept(b.v, a.v), 6) AS intercept FROM a JOIN b ON a.r = b.r""")
def a20b(spark, d):
    pairs = jn.rank_pairs(li(spark, d), "l_returnflag", "l_quantity", "A", "R")
    f = st.fit_lines(pairs, [], "v1", "v2", "pairs")
    return f.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


CH = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@bind("a21_channel_correlation", "WITH t AS (SELECT l_suppkey, " + ", ".join(
    f"corr({a}, {b}) AS r_{i}_{j}" for i, a in enumerate(CH) for j, b in enumerate(CH)) + """ FROM lineitem GROUP BY 1)
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS channel_a, '{b}' AS channel_b, round(avg(r_{i}_{j}), 6) AS r FROM t" for i, a in enumerate(CH) for j, b in enumerate(CH)))
def a21(spark, d):
    return st.channel_correlation(li(spark, d), ["l_suppkey"], CH).withColumn("r", F.round("r", 6))


@bind("a22_histogram_overlap", """WITH l AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
h AS (SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM lineitem, l GROUP BY 1, 2),
p AS (SELECT l_returnflag, bin, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM h),
r AS (SELECT * FROM p WHERE l_returnflag = 'A'), o AS (SELECT DISTINCT l_returnflag FROM p WHERE l_returnflag <> 'A'),
g AS (SELECT o.l_returnflag, b.bin FROM o, (SELECT unnest(range(30)) AS bin) b)
SELECT g.l_returnflag, round(sum(least(coalesce(p.p, 0), coalesce(r.p, 0))) / sum(greatest(coalesce(p.p, 0), coalesce(r.p, 0))), 8) AS iou
FROM g LEFT JOIN p ON g.l_returnflag = p.l_returnflag AND g.bin = p.bin LEFT JOIN r ON g.bin = r.bin GROUP BY 1""")
def a22(spark, d):
    o = st.histogram_overlap(li(spark, d), "l_returnflag", "l_extendedprice", "A", 30)
    return o.withColumn("iou", F.round("iou", 8))


@bind("a22_histogram_overlap_tail", """WITH l AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
q AS (SELECT quantile_cont(l_extendedprice, 0.9) AS q FROM lineitem WHERE l_returnflag = 'A'),
h AS (SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 100), 99) AS INTEGER) AS bin, count(*) AS n FROM lineitem, l GROUP BY 1, 2),
p AS (SELECT l_returnflag, bin, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM h),
r AS (SELECT * FROM p WHERE l_returnflag = 'A'), o AS (SELECT DISTINCT l_returnflag FROM p WHERE l_returnflag <> 'A'),
g AS (SELECT o.l_returnflag, b.bin FROM o, (SELECT unnest(range(100)) AS bin) b, l, q WHERE lo + b.bin * ((hi - lo) / 100) > q)
SELECT g.l_returnflag, round(sum(least(coalesce(p.p, 0), coalesce(r.p, 0))) / sum(greatest(coalesce(p.p, 0), coalesce(r.p, 0))), 8) AS iou
FROM g LEFT JOIN p ON g.l_returnflag = p.l_returnflag AND g.bin = p.bin LEFT JOIN r ON g.bin = r.bin GROUP BY 1""")
def a22b(spark, d):
    o = st.histogram_overlap(li(spark, d), "l_returnflag", "l_extendedprice", "A", 100, cutoff_prob=0.9)
    return o.withColumn("iou", F.round("iou", 8))


POOL = """WITH v AS (SELECT l_returnflag AS f, l_extendedprice AS v FROM lineitem WHERE l_extendedprice > {cut}),
p AS (SELECT s.f, v.v, sum(CASE WHEN v.f = 'A' THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN v.f = 'A' THEN 0 ELSE 1 END) AS n1
 FROM (SELECT unnest(['N', 'R']) AS f) s JOIN v ON v.f = 'A' OR v.f = s.f GROUP BY 1, 2),
c AS (SELECT f, v, n0, n1, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1, sum(n0) OVER (PARTITION BY f) AS t0, sum(n1) OVER (PARTITION BY f) AS t1,
 lead(v) OVER (PARTITION BY f ORDER BY v) AS nx FROM p WINDOW w AS (PARTITION BY f ORDER BY v))
"""


@bind("a23_earth_mover", POOL.format(cut=20000) + """SELECT f AS l_returnflag, round(sum(abs(c0 / t0 - c1 / t1) * (coalesce(nx, v) - v)), 4) AS emd FROM c GROUP BY 1""")
def a23(spark, d):
    e = st.earth_mover(li(spark, d), "l_returnflag", "l_extendedprice", "A", ["N", "R"], 20000.0)
    return e.withColumn("emd", F.round("emd", 4))


@bind("a24_cramer_von_mises", """WITH v AS (SELECT l_returnflag AS f, l_quantity AS v FROM lineitem),
s AS (SELECT unnest(['N', 'R']) AS s),
p AS (SELECT s, f, v, row_number() OVER (PARTITION BY s, f ORDER BY v) AS i,
 (rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1) / CAST(2 AS DOUBLE)) AS r FROM s JOIN v ON f = 'A' OR f = s),
t AS (SELECT s, CAST(count(*) FILTER (WHERE f = 'A') AS DOUBLE) AS nx, CAST(count(*) FILTER (WHERE f <> 'A') AS DOUBLE) AS ny,
 sum((r - i) * (r - i)) FILTER (WHERE f = 'A') AS ux, sum((r - i) * (r - i)) FILTER (WHERE f <> 'A') AS uy FROM p GROUP BY 1)
SELECT s AS l_returnflag, CAST(nx AS BIGINT) AS n0, CAST(ny AS BIGINT) AS n1,
round((nx * ux + ny * uy) / (nx * ny * (nx + ny)) - (4 * nx * ny - 1) / (6 * (nx + ny)), 5) AS statistic FROM t""")
def a24(spark, d):
    c = st.cramer_von_mises(li(spark, d), "l_returnflag", "l_quantity", "A", ["N", "R"])
    return c.select("l_returnflag", "n0", "n1", F.round("statistic", 5).alias("statistic"))


@bind("a25_pattern_sizes", """WITH p AS (SELECT user_id, bool_or(event_type = 'click') AS click, bool_or(event_type = 'purchase') AS purchase,
bool_or(event_type = 'error') AS error FROM events GROUP BY user_id)
SELECT click, purchase, error, count(*) AS n, CAST(click AS INTEGER) + CAST(purchase AS INTEGER) + CAST(error AS INTEGER) AS degree
FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND CAST(click AS INTEGER) + CAST(purchase AS INTEGER) + CAST(error AS INTEGER) BETWEEN 1 AND 3""")
def a25(spark, d):
    from bindings.joins_q import patterns
    return st.pattern_sizes(patterns(spark, d), ["click", "purchase", "error"], 2, 1, 3)


@bind("a26_fold_rare", """WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN n >= 40 AND p_size <> 7 THEN CAST(p_size AS VARCHAR) ELSE 'Others' END AS cls FROM part JOIN c USING (p_size)""")
def a26(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("cls"))
    return st.fold_rare(p, "cls", 40, "7")


PAIRS = "SELECT l_returnflag, l_linenumber - 3 AS a, CAST(l_quantity AS INTEGER) // 10 - 1 AS b FROM lineitem"


@bind("a31_mask_agreement", f"""SELECT l_returnflag,
round(count(*) FILTER (WHERE a > 0 AND b > 0) / CAST(count(*) FILTER (WHERE a > 0 OR b > 0) AS DOUBLE), 8) AS iou,
round(count(*) FILTER (WHERE a > 0) / CAST(count(*) AS DOUBLE), 8) AS fraction_a, round(count(*) FILTER (WHERE b > 0) / CAST(count(*) AS DOUBLE), 8) AS fraction_b,
count(*) FILTER (WHERE abs(a - b) > 0) AS differ, count(*) FILTER (WHERE abs(a - b) >= 2) AS differ_2, count(*) FILTER (WHERE abs(a - b) >= 3) AS differ_3
FROM ({PAIRS}) GROUP BY 1""")
def a31(spark, d):
    px = li(spark, d).selectExpr("l_returnflag", "l_linenumber - 3 a", "cast(l_quantity as int) div 10 - 1 b")
    m = st.mask_agreement(px, "a", "b", ["l_returnflag"])
    return m.withColumns({c: F.round(c, 8) for c in ("iou", "fraction_a", "fraction_b")})


@bind("a32_mutual_information", """WITH l AS (SELECT l_returnflag, min(l_quantity) AS alo, max(l_quantity) AS ahi, min(l_extendedprice) AS blo, max(l_extendedprice) AS bhi FROM lineitem GROUP BY 1),
j AS (SELECT l_returnflag, least(floor((l_quantity - alo) / (ahi - alo) * 20), 19) AS i, least(floor((l_extendedprice - blo) / (bhi - blo) * 20), 19) AS j, count(*) AS n
 FROM lineitem JOIN l USING (l_returnflag) GROUP BY 1, 2, 3),
p AS (SELECT l_returnflag, i, j, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM j),
x AS (SELECT l_returnflag, -sum(p * ln(p)) AS h FROM (SELECT l_returnflag, i, sum(p) AS p FROM p GROUP BY 1, 2) GROUP BY 1),
y AS (SELECT l_returnflag, -sum(p * ln(p)) AS h FROM (SELECT l_returnflag, j, sum(p) AS p FROM p GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT l_returnflag, -sum(p * ln(p)) AS h FROM p GROUP BY 1)
SELECT x.l_returnflag, round((x.h + y.h) / z.h, 8) AS nmi FROM x JOIN y USING (l_returnflag) JOIN z USING (l_returnflag)""")
def a32(spark, d):
    m = st.mutual_information(li(spark, d), "l_quantity", "l_extendedprice", ["l_returnflag"], 20)
    return m.withColumn("nmi", F.round("nmi", 8))


@bind("a33_match_distribution", """WITH s AS (SELECT l_extendedprice AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
sq AS (SELECT v, sum(n) OVER (ORDER BY v) / CAST(sum(n) OVER () AS DOUBLE) AS q FROM s),
r AS (SELECT l_extendedprice AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
rq AS (SELECT v, sum(n) OVER (ORDER BY v) / CAST(sum(n) OVER () AS DOUBLE) AS q FROM r),
lo AS (SELECT sq.v, sq.q, rq.v AS v0, rq.q AS q0 FROM sq ASOF LEFT JOIN rq ON sq.q >= rq.q),
m AS (SELECT lo.v, lo.q, v0, q0, rq.v AS v1, rq.q AS q1 FROM lo ASOF LEFT JOIN rq ON lo.q <= rq.q)
SELECT l_orderkey, l_extendedprice, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR q0 = q1 THEN v0 ELSE v0 + (v1 - v0) * (q - q0) / (q1 - q0) END, 4) AS matched
FROM lineitem JOIN m ON l_extendedprice = m.v WHERE l_returnflag = 'A'""")
def a33(spark, d):
    m = st.match_distribution(li(spark, d), "l_returnflag", "l_extendedprice", "A", "R")
    return m.select("l_orderkey", "l_extendedprice", F.round("matched", 4).alias("matched"))


@bind("w6_change_points", """SELECT event_id, label_from, label_to, midpoint FROM (
SELECT event_id, event_type AS label_from, lead(event_type) OVER (ORDER BY event_id) AS label_to,
(event_id + lead(event_id) OVER (ORDER BY event_id)) / CAST(2 AS DOUBLE) AS midpoint FROM events) WHERE label_to <> label_from""")
def w6(spark, d):
    return st.change_points(table(spark, d, "events").select("event_id", "event_type"), [], "event_id", "event_type")


SMOOTH = f"""WITH {hist_sql('l_returnflag', 'l_extendedprice', 40)},
k AS (SELECT unnest(range(-4, 5)) AS k), wt AS (SELECT k, exp(-0.5 * k * k) / (SELECT sum(exp(-0.5 * k * k)) FROM k) AS w FROM k),
sm AS (SELECT a.l_returnflag, a.bin, a.n, sum(w * b.n) AS s FROM hist a, wt JOIN hist b ON b.l_returnflag = a.l_returnflag AND b.bin = least(greatest(a.bin + k, 0), 39) GROUP BY 1, 2, 3)"""


@bind("w7_smooth", SMOOTH + " SELECT l_returnflag, bin, n, round(s, 6) AS smoothed FROM sm")
def w7(spark, d):
    h = st.histogram(li(spark, d), ["l_returnflag"], "l_extendedprice", 40)
    return st.smooth(h, ["l_returnflag"], "bin", "n", 1.0).select("l_returnflag", "bin", "n", F.round("smoothed", 6).alias("smoothed"))


@bind("w8_local_maxima", SMOOTH + """, nb AS (SELECT l_returnflag, bin, round(s, 6) AS smoothed, lag(round(s, 6)) OVER w AS a, lead(round(s, 6)) OVER w AS b FROM sm WINDOW w AS (PARTITION BY l_returnflag ORDER BY bin))
SELECT l_returnflag, bin, smoothed FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY smoothed DESC, bin) AS rn FROM nb WHERE smoothed > a AND smoothed >= b) WHERE rn <= 5""")
def w8(spark, d):
    h = st.histogram(li(spark, d), ["l_returnflag"], "l_extendedprice", 40)
    s = st.smooth(h, ["l_returnflag"], "bin", "n", 1.0).select("l_returnflag", "bin", F.round("smoothed", 6).alias("smoothed"))
    return st.local_maxima(s, ["l_returnflag"], "bin", "smoothed", 5)


H256 = f"""WITH {hist_sql('l_returnflag', 'l_extendedprice', 256)}, c AS (SELECT l_returnflag, bin, n, ("left" + "right") / 2 AS c FROM hist)"""


@bind("w9_otsu", H256 + """, t AS (SELECT l_returnflag, bin, c, sum(n) OVER w AS w1, sum(n * c) OVER w AS s1, sum(n) OVER (PARTITION BY l_returnflag) AS w, sum(n * c) OVER (PARTITION BY l_returnflag) AS s
FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY bin)),
v AS (SELECT l_returnflag, bin, c, round(w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) * (s1 / w1 - (s - s1) / (w - w1)) / (w * w), 3) AS var FROM t WHERE w1 > 0 AND w > w1)
SELECT l_returnflag, round(c, 4) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY var DESC, bin) AS rn FROM v) WHERE rn = 1""")
def w9(spark, d):
    h = st.histogram(li(spark, d), ["l_returnflag"], "l_extendedprice", 256)
    return st.otsu_threshold(h, ["l_returnflag"]).withColumn("threshold", F.round("threshold", 4))


@bind("w9_triangle", H256 + """, g AS (SELECT l_returnflag, max(n) AS pk, min(bin) FILTER (WHERE n > 0) AS lo, max(bin) FILTER (WHERE n > 0) AS hi FROM c GROUP BY 1),
a AS (SELECT l_returnflag, min(bin) AS ap FROM c JOIN g USING (l_returnflag) WHERE n = pk GROUP BY 1),
f AS (SELECT *, ap - lo < hi - ap AS flip FROM g JOIN a USING (l_returnflag)),
m AS (SELECT l_returnflag, c, n, pk, CASE WHEN flip THEN 255 - bin ELSE bin END AS i, CASE WHEN flip THEN 255 - ap ELSE ap END AS p, CASE WHEN flip THEN 255 - hi ELSE lo END AS s FROM c JOIN f USING (l_returnflag)),
d AS (SELECT l_returnflag, c, i, round((pk * (i - s) - (p - s) * n) / sqrt(CAST(pk AS DOUBLE) * pk + (p - s) * (p - s)), 9) AS len FROM m WHERE i >= s AND i < p)
SELECT l_returnflag, round(c, 4) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY len DESC, i) AS rn FROM d) WHERE rn = 1""")
def w9b(spark, d):
    h = st.histogram(li(spark, d), ["l_returnflag"], "l_extendedprice", 256)
    return st.triangle_threshold(h, ["l_returnflag"]).withColumn("threshold", F.round("threshold", 4))


@bind("w9_threshold_levels", """WITH l AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_quantity) AS t FROM lineitem GROUP BY 1),
b AS (SELECT l_returnflag, lo, hi, lo + 0.1 * (hi - lo) AS l, hi - 0.1 * (hi - lo) AS h, t FROM l), c AS (SELECT l_returnflag, lo, hi, least(greatest(least(greatest(t, l), h) + -0.2 * (hi - lo), l), h) AS t FROM b)
SELECT l_returnflag, CAST(k - 2 AS INTEGER) AS level, round(CASE WHEN k < 3 THEN lo + (t - lo) * (k + 1) / 3 ELSE t + (hi - t) * (k - 2) / 3 END, 6) AS threshold FROM c, (SELECT unnest(range(5)) AS k)""")
def w9c(spark, d):
    lim = li(spark, d).groupBy("l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.avg("l_quantity").alias("threshold"))
    return st.threshold_levels(lim, centre=-0.2).withColumn("threshold", F.round("threshold", 6))


CAL = """WITH x AS (SELECT l_returnflag AS ch, l_partkey AS id, round(sum(log10(l_extendedprice)), 9) AS v FROM lineitem GROUP BY 1, 2),
lim AS (SELECT ch, min(v) AS lo, quantile_cont(v, 0.999) AS hi FROM x GROUP BY 1),
nb AS (SELECT *, greatest(CAST(floor((hi - lo) / CAST(4 AS DOUBLE)) AS INTEGER), 1) AS nb FROM lim),
got AS (SELECT ch, CAST(least(floor((v - lo) / (hi - lo) * nb), nb - 1) AS INTEGER) AS bin, count(*) AS n FROM x JOIN nb USING (ch) WHERE v >= lo AND v <= hi GROUP BY 1, 2),
g AS (SELECT ch, lo, hi, nb, unnest(range(nb)) AS bin FROM nb),
h AS (SELECT g.ch, g.bin, g.nb, (lo + g.bin * ((hi - lo) / nb) + lo + (g.bin + 1) * ((hi - lo) / nb)) / 2 AS c, coalesce(n, 0) AS n FROM g LEFT JOIN got ON g.ch = got.ch AND g.bin = got.bin),
k AS (SELECT unnest(range(-4, 5)) AS k), wt AS (SELECT k, exp(-0.5 * k * k) / (SELECT sum(exp(-0.5 * k * k)) FROM k) AS w FROM k),
sm AS (SELECT a.ch, a.bin, a.c, sum(w * b.n) AS s FROM h a, wt JOIN h b ON b.ch = a.ch AND b.bin = least(greatest(a.bin + k, 0), a.nb - 1) GROUP BY 1, 2, 3),
pk AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM sm WINDOW w AS (PARTITION BY ch ORDER BY bin)),
tp AS (SELECT ch, bin, c FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY s DESC, bin) AS rn FROM pk WHERE s > a AND s >= b) WHERE rn <= 5),
o AS (SELECT ch, c AS x, CAST(row_number() OVER (PARTITION BY ch ORDER BY bin) AS DOUBLE) AS y FROM tp),
f AS (SELECT ch, CASE WHEN count(*) > 1 THEN regr_slope(y, x) END AS slope, CASE WHEN count(*) > 1 THEN regr_intercept(y, x) END AS intercept FROM o GROUP BY 1)
SELECT ch, id, round(slope * v + intercept, 5) AS spot_count FROM x JOIN f USING (ch)"""


@bind("a3_intensity_to_count", CAL)
def a3(spark, d):
    x = li(spark, d).groupBy(F.col("l_returnflag").alias("ch"), F.col("l_partkey").alias("id")).agg(
        F.round(F.sum(F.log10("l_extendedprice")), 9).alias("v"))
    out = st.intensity_to_count(x, ["ch"], "v", bin_size=4.0)
    return out.select("ch", "id", F.round("spot_count", 5).alias("spot_count"))


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def phases(spark, d):
    """Sketches of two shipping phases, the second stored twice, as after a repeated job."""
    path = fresh_path(spark, "sketches")
    rows = li(spark, d).withColumn("late", F.col("l_shipdate") >= F.lit("1995-01-01").cast("date"))
    parts = {"early": rows.where(~F.col("late")), "late": rows.where("late")}
    for name in ("early", "late", "late"):
        sk.store_phase(sk.sketch(parts[name], ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_partkey"), path, name)
    return rows, sk.stored_phases(spark, path)


@bind("a14_merged_quantiles", f"""SELECT l_returnflag, p, n, lowest, highest, true AS within FROM (SELECT l_returnflag, count(l_extendedprice) AS n,
CAST(min(l_extendedprice) AS DOUBLE) AS lowest, CAST(max(l_extendedprice) AS DOUBLE) AS highest FROM lineitem GROUP BY 1), (SELECT unnest({PROBS})::DOUBLE AS p)""")
def a14c(spark, d):
    rows, kept = phases(spark, d)
    whole = sk.merge(kept, ["l_returnflag"])
    found = sk.sketched_quantiles(whole, ["l_returnflag"], PROBS)
    gaps = sk.rank_gaps(rows, ["l_returnflag"], "l_extendedprice", found)
    out = gaps.join(whole.select("l_returnflag", "lowest", "highest"), "l_returnflag")
    return out.select("l_returnflag", "p", "n", "lowest", "highest", (F.col("gap") <= 2 * sk.rank_error()).alias("within"))


@bind("a10_merged_objects", """SELECT l_linestatus, count(DISTINCT l_partkey) AS n_parts, true AS within FROM lineitem WHERE l_partkey > 0 GROUP BY 1""")
def a10b(spark, d):
    rows, kept = phases(spark, d)
    guess = sk.sketched_objects(sk.merge(kept, ["l_linestatus"]), ["l_linestatus"])
    exact = rg.objects_per_file(rows, "l_linestatus", "l_partkey").withColumnRenamed("n_objects", "n_parts")
    near = F.abs(F.col("n_objects") / F.col("n_parts") - 1) <= 4 * sk.distinct_error()
    return exact.join(guess, "l_linestatus").select("l_linestatus", "n_parts", near.alias("within"))

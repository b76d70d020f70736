"""F1-F5, F9-F13 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import bind, table
from cellweave.functions import nested as nj
from cellweave.functions import scalar as sc


@bind("f1_logs_and_clip", """SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + l_extendedprice), 8) AS lp, round(exp(l_tax) - 1, 8) AS em, round(log10(l_extendedprice), 8) AS lg,
least(greatest(l_quantity, 10), 40) AS cl, abs(l_quantity - 25) AS ab FROM lineitem""")
def f1(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.log1p("l_extendedprice"), 8).alias("lp"), F.round(F.expm1("l_tax"), 8).alias("em"),
        F.round(F.log10("l_extendedprice"), 8).alias("lg"), sc.clip(q, 10, 40).cast("double").alias("cl"), F.abs(q - 25).alias("ab"))


@bind("f2_rescale", """SELECT l_orderkey, l_partkey, l_linenumber, round((least(greatest(l_extendedprice, 10000), 80000) - 10000) / 70000 * 255, 6) AS v FROM lineitem""")
def f2(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round(sc.rescale(F.col("l_extendedprice"), 10000, 80000, 0, 255), 6).alias("v"))


@bind("f2_rescale_by_quantiles", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, l_orderkey, l_partkey, round((least(greatest(l_extendedprice, lo), hi) - lo) / (hi - lo), 8) AS l_extendedprice FROM lineitem JOIN q USING (l_returnflag)""")
def f2b(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_extendedprice")
    out = sc.rescale_by_quantiles(li, ["l_returnflag"], "l_extendedprice", 0.01, 0.99)
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 8))


@bind("f3_gamma", """SELECT o_orderkey, round(CAST(CAST(power((least(greatest(o_totalprice, 1000), 400000) - 1000) / 399000, CAST(0.5 AS DOUBLE)) AS FLOAT) AS DOUBLE), 4) AS v FROM orders""")
def f3(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(sc.gamma(F.col("o_totalprice"), 1000, 400000, 0.5).cast("double"), 4).alias("v"))


@bind("f4_snap_to_grid", """WITH p AS (SELECT c_custkey, c_nationkey * 101.5::DOUBLE AS y, (c_custkey // 25) * 203.25::DOUBLE AS x FROM customer),
s AS (SELECT min(y) FILTER (WHERE y > 60) AS sy, min(x) FILTER (WHERE x > 125) AS sx FROM p), t AS (SELECT *, CAST(round_even(sy / 16, 0) * 16 AS BIGINT) AS th, CAST(round_even(sx / 16, 0) * 16 AS BIGINT) AS tw FROM s)
SELECT c_custkey, CAST(round_even(y / sy, 0) AS BIGINT) * th AS grid_y, CAST(round_even(x / sx, 0) AS BIGINT) * tw AS grid_x, th AS tile_h, tw AS tile_w FROM p, t""")
def f4(spark, d):
    p = table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey * 101.5D y", "(c_custkey div 25) * 203.25D x")
    return sc.snap_to_grid(p, "y", "x", 120, 250).drop("y", "x")


@bind("f5_tile_row_col", """WITH t AS (SELECT vec_id, vec_id // 25 AS r, CASE WHEN (vec_id // 25) % 2 = 1 THEN 24 - vec_id % 25 ELSE vec_id % 25 END AS c FROM embeddings)
SELECT vec_id, r AS "row", c AS col, round(r * 8 * 0.9::DOUBLE, 4) AS y, round(c * 8 * 0.9::DOUBLE, 4) AS x FROM t""")
def f5(spark, d):
    r, c = sc.tile_row_col(F.col("vec_id"), 25, 40, snake=True)
    t = table(spark, d, "embeddings").select("vec_id", r.alias("row"), c.alias("col"))
    y, x = sc.tile_position(F.col("row"), F.col("col"), 8, 8, 0.1)
    return t.select("*", F.round(y, 4).alias("y"), F.round(x, 4).alias("x"))


@bind("f9_file_names", """SELECT page_id, split_part(url, '/', 3) AS host, substr(split_part(url, '/', 3), 1, 5) AS head, lpad(CAST(page_id AS VARCHAR), 6, '0') AS padded,
'slide' || page_id AS stem FROM pages""")
def f9(spark, d):
    p = table(spark, d, "pages")
    name = F.concat(F.lit("slide"), F.col("page_id"), F.when(F.col("page_id") % 2 == 0, ".OME.tif").otherwise(".csv"))
    url = F.col("url")
    return p.select("page_id", sc.name_part(url, "/", 2).alias("host"), sc.name_part(url, "/", 2, 5).alias("head"),
                    sc.padded(F.col("page_id"), 6).alias("padded"), sc.stem(name).alias("stem"))


@bind("f10_set_channel_windows", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS id, CAST(event_id AS DOUBLE) / 2 AS lo, CAST(100 AS DOUBLE) AS hi FROM events""")
def f10(spark, d):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"groups":[{"label":"g","channels":[{"id":'), k, F.lit(',"label":"c","color":"ff","min":0.1,"max":0.2}],"render":[{"id":'), k,
                    F.lit(',"label":"c","color":"ff","min":0.1,"max":0.2}]}]}'))
    ev = table(spark, d, "events").select("event_id", text.alias("t"), F.create_map(k.cast("int"), F.col("event_id") / 2).alias("lows"),
                                          F.create_map(k.cast("int"), F.lit(100.0)).alias("highs"))
    out = ev.select("event_id", F.from_json(nj.set_channel_windows(F.col("t"), F.col("lows"), F.col("highs")), nj.GROUPS).alias("g"))
    c = F.col("g.groups")[0].render[0]
    return out.select("event_id", c.id.alias("id"), c.min.alias("lo"), c.max.alias("hi"))


@bind("f10_settings_to_groups", """SELECT event_id, event_type AS label, CAST(1 AS INTEGER) AS id, 'DAPI' AS name, '00ff0a' AS color, round(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 65535, 8) AS lo FROM events""")
def f10b(spark, d):
    text = F.concat(F.lit('[{"name":"'), F.col("event_type"), F.lit('","channelSettings":{"1":{"color":"#00FF0A","window":{"start":'),
                    F.get_json_object("props", "$.k"), F.lit(',"end":500}}}}]'))
    names = F.array(F.lit("zero"), F.lit("DAPI"))
    g = table(spark, d, "events").select("event_id", F.from_json(nj.settings_to_groups(text, names, 0, 65535), nj.GROUPS).alias("g"))
    c = F.col("g.groups")[0].channels[0]
    return g.select("event_id", F.col("g.groups")[0].label.alias("label"), c.id.alias("id"), c.label.alias("name"), c.color.alias("color"), F.round(c.min, 8).alias("lo"))


@bind("f11_mask_pixels", """WITH b AS (SELECT o_orderkey, o_orderkey % 256 AS v, o_custkey % 256 AS w FROM orders), i AS (SELECT unnest(range(15)) AS i)
SELECT o_orderkey, CAST(i // 5 AS BIGINT) AS y, CAST(i % 5 AS BIGINT) AS x FROM b, i WHERE (CASE WHEN i < 8 THEN (v >> (7 - i)) ELSE (w >> (15 - i)) END) & 1 = 1""")
def f11(spark, d):
    byte = lambda c: F.unhex(F.lpad(F.hex(F.col(c) % 256), 2, "0"))
    o = table(spark, d, "orders").select("o_orderkey", F.base64(F.concat(byte("o_orderkey"), byte("o_custkey"))).alias("data"), F.lit(3).alias("h"), F.lit(5).alias("w"))
    return nj.mask_pixels(o, "data", "h", "w").select("o_orderkey", "y", "x")


@bind("f12_waypoints", """SELECT s_suppkey, s_name || ' | roi' AS "Name", CAST(4 AS DOUBLE) AS "Zoom", round(((s_acctbal / CAST(100 AS DOUBLE)) + 13.0 / 3) / 64, 6) AS pan_x, CAST(6 AS BIGINT) AS n FROM supplier WHERE s_nationkey <> 3""")
def f12(spark, d):
    from bindings.sources_q import contours
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("label"), "s_name", "s_nationkey")
    c = contours(spark, d).join(s, "label").select("label", F.when(F.col("s_nationkey") != 3, F.concat("s_name", F.lit(" | roi"))).otherwise(F.col("s_name")).alias("name"),
                                                   F.slice("contour", 1, 3).alias("pts"), F.lit(64.0).alias("height"))
    w = nj.waypoints(c, "label").select(F.col("label").alias("s_suppkey"), F.from_json("waypoint", "struct<Name:string,Zoom:double,Pan:array<double>,Polygon:string>").alias("w"))
    return w.select("s_suppkey", "w.Name", "w.Zoom", F.round(F.col("w.Pan")[0], 6).alias("pan_x"), F.size(F.split("w.Polygon", ",")).cast("long").alias("n"))


@bind("f13_cards", """SELECT c_custkey, CAST(CAST(DATE '2010-02-01' - CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS DATE) AS VARCHAR) AS day, lower(replace(c_name, '#', '-')) AS slug,
'title: ' || c_name || ' / ' || c_mktsegment AS card FROM customer""")
def f13(spark, d):
    c = sc.countdown(sc.numbered(table(spark, d, "customer"), "c_custkey"), F.lit("2010-02-01").cast("date"), "row_no")
    return c.select("c_custkey", F.col("date").cast("string").alias("day"), sc.slug(F.col("c_name")).alias("slug"),
                    sc.fill_template("title: {} / {}", F.col("c_name"), F.col("c_mktsegment")).alias("card"))

"""Tables written from the driver tables into the shared folder, then scanned."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import bind, table
from cellweave.functions.scalar import base_name
from cellweave.operators.tiles import task_count
from cellweave.session import fresh_path
from cellweave.sources import documents as doc
from cellweave.sources import manifest as mf
from cellweave.sources import series as se
from cellweave.sources import sinks as sk
from cellweave.sources import tables as tb

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@bind("s1_cell_csv_scan", "SELECT p_partkey, p_size, p_retailprice FROM part")
def s1(spark, d):
    path = fresh_path(spark, "cells")
    sk.write_table(table(spark, d, "part"), path, "csv")
    return tb.read_cells(spark, path, PART, ["p_partkey", "p_size", "p_retailprice"])


@bind("s2_parquet_scan", "SELECT l_partkey, l_extendedprice FROM lineitem WHERE l_quantity >= 45")
def s2(spark, d):
    return tb.read_spots(spark, f"{d}/lineitem.parquet").where("l_quantity >= 45").select("l_partkey", "l_extendedprice")


@bind("s3_tagged_scan", """SELECT CASE l_returnflag WHEN 'A' THEN 'CD3' WHEN 'N' THEN 'CD8' ELSE 'SOX10' END AS marker, l_returnflag AS channel,
count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1, 2""")
def s3(spark, d):
    path = fresh_path(spark, "spots")
    li = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("c"))
    sk.write_table(li, path, partition_by=["c"])
    df = tb.read_tagged(spark, f"{path}/c=*", r"/c=([^/]+)/", {"A": "CD3", "N": "CD8", "R": "SOX10"})
    return df.groupBy("marker", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("keys"))


@bind("s4_listed_scan", """SELECT 'customers' AS kind, c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_acctbal FROM supplier""")
def s4(spark, d):
    path = fresh_path(spark, "listed")
    sk.write_table(table(spark, d, "customer").selectExpr("c_custkey id", "c_acctbal bal"), f"{path}/customers", "csv")
    sk.write_table(table(spark, d, "supplier").selectExpr("s_suppkey id", "s_acctbal bal"), f"{path}/suppliers", "csv")
    spark.range(1).select(F.explode(F.array(F.lit(f"{path}/customers"), F.lit(f"{path}/suppliers"))).alias("v")).write.text(f"{path}/list")
    df = tb.read_listed(spark, f"{path}/list", "id long, bal double")
    return df.select(F.element_at(F.split(tb.file_path(), "/"), -2).alias("kind"), "id", "bal")


@bind("s5_roi_scan", """SELECT s_suppkey AS "Id", s_name AS "Name", CASE WHEN s_nationkey % 4 IN (0, 3) THEN 3 ELSE 4 END AS n FROM supplier WHERE s_nationkey % 4 <> 3 AND s_nationkey % 4 <> 2""")
def s5(spark, d):
    from bindings.spatial_q import rois
    from cellweave.operators.spatial import normalise_rois
    path = fresh_path(spark, "rois")
    full = rois(spark, d).withColumn("all_transforms", F.lit("1,0,0,0,1,0,0,0,1"))
    order = [f.split()[0] for f in tb.ROI_SCHEMA.split(", ")]
    sk.write_table(full.select(*order), path, "csv")
    r = normalise_rois(tb.read_rois(spark, path))
    return r.where("kind <> 'ellipse'").select("Id", "Name", F.size("pts").alias("n"))


@bind("s6_file_series", """SELECT c_custkey, 'Customer' AS well, c_custkey AS series FROM customer""")
def s6(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return se.parse_names(c, "c_name", "{well}#{series:9}").select("c_custkey", "well", "series")


@bind("s6_listing", """SELECT l_returnflag AS well, CAST(l_linenumber AS BIGINT) AS series FROM lineitem GROUP BY 1, 2""")
def s6b(spark, d):
    path = fresh_path(spark, "series")
    images = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    images.write.partitionBy("l_returnflag", "l_linenumber").parquet(path)
    files = se.list_series(spark, path, "l_returnflag={well}/l_linenumber={series}/{file}", parts=3)
    return files.select("well", "series").distinct()


def manifest_file(spark, d):
    path = fresh_path(spark, "manifest")
    o = table(spark, d, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 10 == 0, "x").otherwise(F.col("o_custkey").cast("string")),
                       F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise(""))
    head = spark.range(1).select(F.lit("image_id_1,image_id_2,channel,flag").alias("value"), F.lit(-1).cast("long").alias("k"))
    rows = o.select(line.alias("value"), F.col("o_orderkey").alias("k"))
    head.unionByName(rows).orderBy("k").select("value").write.text(path)
    return path


RULES = ({"image_id_1": "int", "image_id_2": "int"}, {"channel": ("string", "dna"), "flag": ("boolean", False), "level": ("int", 2)})


@bind("s7_manifest_good", """SELECT o_orderkey + 2 AS row_num, CAST(o_orderkey AS INTEGER) AS image_id_1, CAST(o_custkey AS INTEGER) AS image_id_2,
CASE WHEN o_orderstatus = 'F' THEN 'dna' ELSE o_orderstatus END AS channel, o_orderkey % 2 = 0 AS flag, CAST(2 AS INTEGER) AS level FROM orders WHERE o_custkey % 10 <> 0""")
def s7(spark, d):
    good, _ = mf.read_manifest(spark, manifest_file(spark, d), *RULES)
    return good.withColumn("row_num", F.col("row_num").cast("long"))


@bind("s7_manifest_rejected", "SELECT o_orderkey + 2 AS row_num, 'image_id_2 is not int: x' AS reason FROM orders WHERE o_custkey % 10 = 0")
def s7b(spark, d):
    _, bad = mf.read_manifest(spark, manifest_file(spark, d), *RULES)
    return bad.withColumn("row_num", F.col("row_num").cast("long"))


@bind("s8_name_list", """SELECT CAST(n_nationkey AS INTEGER) AS "position", n_name AS name FROM nation""")
def s8(spark, d):
    path = fresh_path(spark, "names")
    n = table(spark, d, "nation").orderBy("n_nationkey").select(F.concat(F.lit(" "), "n_name", F.lit("\r")).alias("value"))
    n.coalesce(1).write.text(path)
    return tb.read_names(spark, path).select("position", "name")


@bind("s8_name_lists", """WITH r AS (SELECT c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
b AS (SELECT *, min(CASE WHEN name <> '' THEN k END) OVER (PARTITION BY c_nationkey) AS lo, max(CASE WHEN name <> '' THEN k END) OVER (PARTITION BY c_nationkey) AS hi FROM r)
SELECT CAST(c_nationkey AS BIGINT) AS list, CAST(k - lo AS INTEGER) AS "position", name FROM b WHERE k BETWEEN lo AND hi""")
def s8b(spark, d):
    path = fresh_path(spark, "lists")
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    c = table(spark, d, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    c.select("c_nationkey", F.concat(F.lit(" "), name, F.lit(" \r")).alias("value")).write.partitionBy("c_nationkey").text(path)
    lists = tb.read_names(spark, path)
    return lists.select(F.regexp_extract("file", r"c_nationkey=(\d+)/", 1).cast("long").alias("list"), "position", "name")


@bind("s9_file_counts", "SELECT l_returnflag AS flag, count(*) AS n_rows, CAST(10 AS INTEGER) AS n_columns FROM lineitem GROUP BY 1")
def s9(spark, d):
    path = fresh_path(spark, "counts")
    li = table(spark, d, "lineitem")
    li.write.partitionBy("l_returnflag").option("header", True).csv(path)
    c = tb.file_counts(spark, path)
    return c.groupBy(F.regexp_extract("file", "l_returnflag=([^/]+)/", 1).alias("flag")).agg(
        F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"))


@bind("s10_parameters", """SELECT CAST(p_size AS VARCHAR) AS "case", CAST(p_size % 5 AS INTEGER) AS step, 'Price' AS "key", count(*) AS n, CAST(2 AS INTEGER) AS width FROM part GROUP BY 1, 2""")
def s10(spark, d):
    path = fresh_path(spark, "params")
    p = table(spark, d, "part").select("p_size", (F.col("p_size") % 5).alias("step"), F.explode(F.array(
        F.concat(F.lit("(Price "), F.col("p_retailprice").cast("string"), F.lit(' "a b")')), F.lit("// comment"))).alias("value"))
    p.write.partitionBy("p_size", "step").text(path)
    t = doc.read_parameters(spark, path, r"p_size=(\d+)/", r"step=(\d+)/")
    return t.groupBy("case", "step", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("values")).alias("width"))


def contours(spark, d):
    """One triangle per supplier, with a nucleus for most of them."""
    c = (F.col("s_acctbal") / 100).alias("c")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", c)
    p = lambda dx, dy: F.struct((F.col("c") + dx).alias("x"), (F.col("c") + dy).alias("y"))
    nuc = F.when(F.col("s_nationkey") != 3, F.array(p(1, 1), p(2, 1), p(2, 2), p(1, 1)))
    return s.select(F.col("s_suppkey").alias("label"), F.array(p(0, 0), p(9, 1), p(4, 8), p(0, 0)).alias("contour"), nuc.alias("nucleus"))


@bind("s12_feature_sink", """SELECT s_suppkey AS label, 'cell' AS kind, CAST(4 AS INTEGER) AS n, round(s_acctbal / CAST(100 AS DOUBLE) + 9, 6) AS x1 FROM supplier WHERE s_nationkey <> 3""")
def s12(spark, d):
    path = fresh_path(spark, "features")
    sk.write_features(sk.cell_features(contours(spark, d), nucleus="nucleus"), path)
    f = doc.read_features(spark, path, "cell", lines=True)
    ring = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")[0]
    return f.select(F.get_json_object("f.properties.measurements", "$.label").cast("long").alias("label"),
                    F.col("f.properties.objectType").alias("kind"), F.size(ring).alias("n"), F.round(ring[1][0], 6).alias("x1"))


def feature_docs(spark, d):
    """Feature collections of at most a hundred suppliers, one JSON document a line."""
    s = table(spark, d, "supplier").withColumn("c", F.col("s_acctbal") / 100)
    xy = lambda dx, dy: F.array(F.col("c") + dx, F.col("c") + dy)
    outer = F.array(xy(0, 0), xy(8, 0), xy(8, 6), xy(0, 6), xy(0, 0))
    hole = F.array(xy(2, 2), xy(3, 2), xy(3, 3), xy(2, 2))
    rings = F.when(F.col("s_nationkey") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    feat = F.struct(
        F.lit("Feature").alias("type"), F.col("s_name").alias("id"),
        F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"), (F.col("s_nationkey") % 3 == 0).alias("isEllipse")).alias("geometry"),
        F.struct(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"),
                 F.when(F.col("s_suppkey") % 5 != 0, F.struct(F.lit("Tumor").alias("name"))).alias("classification"),
                 F.when(F.col("s_suppkey") % 4 == 0, "detection").otherwise("annotation").alias("objectType")).alias("properties"))
    docs = s.groupBy(F.floor(F.col("s_suppkey") / 100).alias("k")).agg(F.to_json(F.struct(F.collect_list(feat).alias("features"))).alias("value"))
    path = fresh_path(spark, "geojson")
    docs.select("value").write.text(path)
    return path


@bind("s11_feature_scan", "SELECT s_name AS id, 'detection' AS kind FROM supplier WHERE s_suppkey % 4 = 0")
def s11(spark, d):
    f = doc.read_features(spark, feature_docs(spark, d), "detection", size=1 << 12)  # ranges far shorter than a document
    return f.select(F.col("f.id").alias("id"), F.col("f.properties.objectType").alias("kind"))


@bind("s15_roi_records", """WITH s AS (SELECT *, s_acctbal / CAST(100 AS DOUBLE) AS c, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS nm, CASE WHEN s_suppkey % 5 <> 0 THEN 'Tumor' END AS cl FROM supplier)
SELECT s_name AS id, coalesce(cl, nm, '') AS roi_name, coalesce(nm, cl, '') AS text, CASE WHEN s_nationkey % 3 = 0 THEN 'Ellipse' ELSE 'Polygon' END AS kind, FALSE AS is_hole,
CASE WHEN s_nationkey % 3 = 0 THEN round(c + 4, 6) END AS cx, CASE WHEN s_nationkey % 3 = 0 THEN CAST(3 AS DOUBLE) END AS ry FROM s
UNION ALL SELECT s_name, 'Exclude', coalesce(nm, cl, ''), 'Polygon', TRUE, NULL, NULL FROM s WHERE s_nationkey % 2 = 0""")
def s15(spark, d):
    r = doc.roi_records(doc.read_features(spark, feature_docs(spark, d)), holes="exclude")
    return r.select("id", "roi_name", "text", "kind", "is_hole", F.round("cx", 6).alias("cx"), F.round("ry", 6).alias("ry"))


@bind("s13_table_sinks", "SELECT 'skip' AS present, count(*) AS n FROM region UNION ALL SELECT 'add', 2 * count(*) FROM region UNION ALL SELECT 'replace', count(*) FROM nation")
def s13(spark, d):
    path = fresh_path(spark, "sinks")
    r, n = table(spark, d, "region").select(F.col("r_name").alias("name")), table(spark, d, "nation").select(F.col("n_name").alias("name"))
    out = None
    for present, second in (("skip", n), ("add", r), ("replace", n)):
        sk.write_table(r, f"{path}/{present}")
        sk.write_table(second, f"{path}/{present}", present=present)
        got = spark.read.parquet(f"{path}/{present}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(present).alias("present"), "n")
        out = got if out is None else out.unionByName(got)
    return out


def run_log(spark, d):
    path = fresh_path(spark, "log")
    o = table(spark, d, "orders").selectExpr(
        "cast(o_custkey as string) name", "if(o_orderkey % 7 = 0, null, o_orderkey) row_num", "o_orderstatus <> 'P' success",
        "o_totalprice elapsed", "o_orderpriority message", "'8x8' shape")
    for s in (True, False):
        sk.log_runs(o.where(F.col("success") == s), path)
    return spark.read.parquet(path)


@bind("s14_run_summary", "SELECT o_orderstatus <> 'P' AS success, count(*) AS n, round(sum(o_totalprice), 2) AS elapsed FROM orders GROUP BY 1")
def s14(spark, d):
    return sk.run_summary(run_log(spark, d)).withColumn("elapsed", F.round("elapsed", 2))


@bind("s14_failures", "SELECT CAST(o_custkey AS VARCHAR) AS name, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS row_num FROM orders WHERE o_orderstatus = 'P'")
def s14b(spark, d):
    return sk.failures(run_log(spark, d)).select("name", F.col("row_num").cast("string").alias("row_num"))


@bind("s16_sidecars", """SELECT page_id, CASE WHEN regexp_extract(url, 'page=([0-9]+)', 1) = '' THEN CAST(1 AS DOUBLE) ELSE CAST(regexp_extract(url, 'page=([0-9]+)', 1) AS DOUBLE) END AS pixel_size,
length(regexp_extract(html, 'lang="([a-z]+)"', 1)) AS n FROM pages""")
def s16(spark, d):
    p = table(spark, d, "pages")
    nums = doc.sidecar_numbers(F.col("url"), {"pixel_size": r"page=(\d+)"}, {"pixel_size": 1.0})
    return p.select("page_id", *nums, F.length(F.regexp_extract("html", 'lang="([a-z]+)"', 1)).cast("long").alias("n"))


@bind("s16_named_objects", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events WHERE event_type = 'click'""")
def s16b(spark, d):
    ev = table(spark, d, "events")
    text = F.concat(F.lit('junk {"name": "other", "v": 1} ['), F.lit('{"name": "'), F.col("event_type"), F.lit('", "v": '),
                    F.get_json_object("props", "$.k"), F.lit("}] tail"))
    got = ev.select("event_id", F.explode(doc.objects_named(text, "click", "struct<name:string,v:bigint>")).alias("o"))
    return got.select("event_id", "o.v")


@bind("s16_missing_sidecars", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s16c(spark, d):
    tiles = table(spark, d, "documents").select("doc_id")
    return doc.match_sidecars(tiles, table(spark, d, "labels"), "doc_id")[1]


@bind("s16_sidecar_files", """SELECT s_suppkey AS tile, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS x, CASE WHEN s_acctbal >= 0 THEN CAST(s_nationkey AS DOUBLE) END AS y,
CASE WHEN s_acctbal >= 0 THEN CASE WHEN s_nationkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END AS pixel_size, s_acctbal < 0 AS missing FROM supplier""")
def s16d(spark, d):
    """A sidecar of some lines in a folder per tile, read back and matched; tiles without one are kept and marked."""
    path = fresh_path(spark, "sidecars")
    tiles = table(spark, d, "supplier").withColumn("tile", F.col("s_suppkey"))
    size = F.when(F.col("s_nationkey") % 2 == 0, "pixel: 0.5 um")
    lines = F.concat_ws("\n", F.concat(F.lit("stage x = "), F.col("s_acctbal").cast("string")), F.concat(F.lit("stage y = "), F.col("s_nationkey").cast("string")), size)
    cars = tiles.where("s_acctbal >= 0").select("tile", lines.alias("value")).repartition(task_count(tiles), "tile")
    # the tasks move their own files into the new folder; the driver would move one after the other
    cars.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("tile").text(path)
    number = r"(-?[0-9.]+(?:E[0-9]+)?)"
    cars = doc.read_sidecars(spark, path, r"/tile=(\d+)/")
    found = cars.select(F.col("stem").cast("long").alias("tile"), *doc.sidecar_numbers(
        F.col("text"), {"x": "stage x = " + number, "y": "stage y = " + number, "pixel_size": "pixel: " + number}, {"pixel_size": 1.0}))
    with_car, without = doc.match_sidecars(tiles.select("tile"), found, "tile")
    none = [F.lit(None).cast("double").alias(c) for c in ("x", "y", "pixel_size")]
    return with_car.withColumn("missing", F.lit(False)).unionByName(without.select("tile", *none, F.lit(True).alias("missing")))


@bind("s3_base_names", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages")
def s3b(spark, d):
    return table(spark, d, "pages").select("page_id", base_name(F.col("url")).alias("name"))

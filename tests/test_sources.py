import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.functions import nested as nj
from cellweave.functions import scalar as sc
from cellweave.sources import collections as co
from cellweave.sources import documents as doc
from cellweave.sources import manifest as mf
from cellweave.sources import series as se
from cellweave.sources import sinks as sk
from cellweave.sources import tables as tb
from cellweave.streaming import arrivals as ar


def test_manifest_defaults_short_rows_and_rejects(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿image_id_1,image_id_2,channel,flag\r\n1,2,,yes\r\n\r\n"3",x,5,no\r\n4,5\r\n,6,1,\r\n7,8,q,maybe\r\n')
    good, bad = mf.read_manifest(spark, str(p), {"image_id_1": "int", "image_id_2": "int"}, {"channel": ("int", 0), "flag": ("boolean", False)})
    assert sorted(map(tuple, good.collect())) == [(2, 1, 2, 0, True), (4, 4, 5, 0, False)]
    assert {r.row_num: r.reason for r in bad.collect()} == {
        3: "image_id_2 is not int: x", 5: "image_id_1 is missing", 6: "channel is not int: q"}
    with pytest.raises(ValueError, match="required"):
        mf.read_manifest(spark, str(p), {"nope": "int"}, {})


def test_names_keep_inner_blanks_and_repeats(spark, tmp_path):
    (tmp_path / "n.csv").write_bytes(b"\r\n\r\nDNA\r\nBlank\r\n\r\nBlank\r\n\r\n")
    got = tb.read_names(spark, str(tmp_path / "n.csv")).orderBy("position").collect()
    assert [r.name for r in got] == ["DNA", "Blank", "", "Blank"]


def test_names_across_blocks(spark, tmp_path):
    lists = {"a.csv": ["", " "] + [f"name {k}" if k % 4 else "" for k in range(300)] + ["last", "", ""], "b.csv": ["only"], "blank.csv": ["", " ", ""]}
    for file, names in lists.items():
        (tmp_path / file).write_bytes("\r\n".join(names).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = sorted((r.file.rsplit("/", 1)[1], r.position, r.name) for r in tb.read_names(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("a.csv", k, v) for k, v in enumerate(lists["a.csv"][3:-2])] + [("b.csv", 0, "only")])


def test_series_pattern_and_missing(spark, tmp_path):
    for name in ("1_00001_Z001_CH1.tif", "1_00001_Z001_CH2.tif", "1_00002_Z001_CH1.tif", "notes.txt"):
        (tmp_path / name).write_text("x")
    s = se.list_series(spark, str(tmp_path), "1_{series:5}_Z{z}_CH{channel}.tif")
    assert sorted((r.series, r.z, r.channel) for r in s.collect()) == [(1, "001", "1"), (1, "001", "2"), (2, "001", "1")]
    assert [tuple(r) for r in se.missing_images(s, ["series", "channel"]).collect()] == [(2, "2")]


def test_file_counts_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z\n1,2,3\n4,5,6\n")
    r = tb.file_counts(spark, str(tmp_path / "a.csv")).first()
    assert (r.n_rows, r.n_columns) == (2, 3)
    out = str(tmp_path / "t")
    df = spark.range(3)
    sk.write_table(df, out)
    sk.write_table(spark.range(9), out, present="skip")
    assert spark.read.parquet(out).count() == 3
    with pytest.raises(Exception):
        sk.write_table(df, out)


def test_tagged_scan_stops_on_unknown_channel(spark, tmp_path):
    for c in ("1", "2"):
        spark.range(2).write.parquet(str(tmp_path / f"s-measurements_{c}.parquet"))
    glob = str(tmp_path / "s-measurements_*.parquet")
    ok = tb.read_tagged(spark, glob, r"measurements_(\d+)\.parquet", {"1": "CD3", "2": "CD8"})
    assert {r.marker for r in ok.collect()} == {"CD3", "CD8"}
    with pytest.raises(Exception, match="no marker name"):
        tb.read_tagged(spark, glob, r"measurements_(\d+)\.parquet", {"1": "CD3"}).collect()
    with pytest.raises(ValueError, match="unique"):
        tb.read_tagged(spark, glob, r"measurements_(\d+)\.parquet", {"1": "CD3", "2": "CD3"})


def test_parameters(spark):
    lines = spark.createDataFrame([('(Metric "A B" 1 2.5)',), ("// no",), ("",), ("(Flag)",)], "line string")
    got = doc.parse_parameters(lines).collect()
    assert [(r.key, r["values"]) for r in got] == [("Metric", ["A B", "1", "2.5"])]


def test_roi_records(spark):
    text = """{"features":[
    {"type":"Feature","id":"1","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]],[[[9,9],[8,9],[8,8],[9,9]]]]},"properties":{"classification":{"name":"T"},"objectType":"annotation"}},
    {"type":"Feature","id":"2","geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]},"properties":{"name":"l","objectType":"annotation"}},
    {"type":"Feature","id":"3","geometry":{"type":"Point","coordinates":[5,6]},"properties":{"objectType":"detection"}},
    {"type":"Feature","id":"4","geometry":{"type":"Polygon","isEllipse":true,"coordinates":[[[0,2],[4,0],[8,2],[4,4],[0,2]]]},"properties":{"name":"e","classification":{"name":"C"}}}]}"""
    f = doc.parse_features(spark.createDataFrame([(text,)], "value string"))
    got = [(r.id, r.roi_name, r.text, r.kind, r.is_hole) for r in doc.roi_records(f, "exclude").orderBy("id", "part", "ring").collect()]
    assert got == [("1", "T", "T", "Polygon", False), ("1", "Exclude", "T", "Polygon", True), ("1", "T", "T", "Polygon", False),
                   ("2", "l", "l", "Line", False), ("3", "", "", "Point", False), ("4", "C", "e", "Ellipse", False)]
    e = doc.roi_records(f).where("id = '4'").first()
    assert (e.cx, e.cy, e.rx, e.ry) == (4.0, 2.0, 4.0, 2.0)


def test_bits_repeat_when_short(spark):
    df = spark.createDataFrame([("gA==",)], "d string")  # 1000 0000
    assert df.select(nj.unpack_bits(F.col("d"), F.lit(3), F.lit(4)).alias("b")).first().b == [1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0]


def test_names_and_snake(spark):
    df = spark.createDataFrame([("a.b.OME.TIFF",), ("x.csv",), ("noext",), (".hidden",)], "n string")
    assert [r.s for r in df.select(sc.stem(F.col("n")).alias("s")).collect()] == ["a.b", "x", "noext", ".hidden"]
    row, col = sc.tile_row_col(F.col("id"), 3, 2, horizontal=False, snake=True)
    got = [(r.a, r.b) for r in spark.range(6).select(row.alias("a"), col.alias("b")).collect()]
    assert got == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 2), (1, 2)]


def test_rescale_of_an_empty_range_is_null(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert [r.x for r in df.select(sc.rescale(F.col("v"), 2.0, 2.0).alias("x")).collect()] == [None, None]
    assert [r.x for r in df.select(sc.rescale(F.col("v"), 0, 2, 0, 10).alias("x")).collect()] == [5.0, None]


def test_arrivals_once_and_own_folders_skipped(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    spark.range(3).write.parquet(f"{src}/scan1")
    spark.range(4).write.parquet(f"{src}/{ar.OWN_PREFIX}scan9")
    run = lambda: ar.run_to_end(ar.process_arrivals(ar.arriving_files(spark, src, "id long"), out, cp))
    run()
    assert spark.read.parquet(out).count() == 3
    spark.range(5).write.parquet(f"{src}/scan2")
    run()
    run()
    assert {r.scan: r["count"] for r in spark.read.parquet(out).groupBy("scan").count().collect()} == {"scan1": 3, "scan2": 5}


def test_folder_completes_once_quiet_and_duplicates_count_once(spark, tmp_path):
    src, out, cp = str(tmp_path / "ev"), str(tmp_path / "done"), str(tmp_path / "cp")
    rows = [("a", "f1", "2024-01-01 00:00:00"), ("a", "f1", "2024-01-01 00:00:00"), ("a", "f2", "2024-01-01 00:00:40"),
            ("b", "f1", "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "scan string, name string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    ar.run_to_end(ar.emit_completed(ar.completed_folders(stream, "scan", "ts", "1 minute", "10 minutes", unique=["scan", "name"]), out, cp))
    assert [(r.scan, r.n_files) for r in spark.read.parquet(out).collect()] == [("a", 2)]


def test_manifest_rows_are_numbered_across_blocks(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("id,name\r\n" + "".join(f"{i},n{i}\r\n\r\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        good, bad = mf.read_manifest(spark, str(p), {"id": "int"}, {"name": ("string", "")})
        assert [(r.row_num, r.id, r.name) for r in good.orderBy("id").collect()] == [(i + 2, i, f"n{i}") for i in range(500)]
        assert bad.isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def features_of(text):
    """Features of concatenated documents by a plain parser."""
    out, at = [], 0
    while text[at:].strip():
        at += len(text[at:]) - len(text[at:].lstrip())
        value, at = json.JSONDecoder().raw_decode(text, at)
        out += value if isinstance(value, list) else value.get("features", [])
    return [v for v in out if isinstance(v, dict)]


ODD = [
    {"type": "Feature", "id": "a", "properties": {"name": 'brackets ]}[{ and "quotes" \\', "features": [{"id": "inner"}], "x": "\\" * 9}},
    {"type": "Feature", "id": "b", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"name": '\\"', "objectType": "cell"}},
    {"type": "Feature", "id": "é" * 40 + "日本", "properties": {}}, {}, {"id": "long", "properties": {"name": "w " * 900}},
]


def test_features_by_ranges_of_any_size():
    head = '{"bbox": [1, [2]], "crs": {"features": [{"id": "no"}]}, "extra": [{"id": "no"}], "name": "features", "features" : \n ['
    one = head + ",\n".join(json.dumps(v, ensure_ascii=k % 2 == 0) for k, v in enumerate(ODD)) + '], "more": [{"id": "no"}]}'
    text = "\n".join([one, json.dumps(ODD), '{"features": []}', "[]", "{}", json.dumps({"features": ODD[:2] + [None, 3, [{"id": "no"}]]}, indent=2)])
    want, data = features_of(text), text.encode()
    for size in (1, 2, 3, 7, 64, 1000, len(data)):
        ranges = pd.DataFrame([("x", len(data), lo, min(lo + size, len(data))) for lo in range(0, len(data), size)], columns=["file", "size", "lo", "hi"])
        rows = [co.summary(data[max(0, r.lo - co.BACK):r.hi], min(r.lo, co.BACK)) for r in ranges.itertuples()]
        known = co.states(pd.concat([ranges, pd.DataFrame(rows, columns=["odd", "closed0", "left0", "closed1", "left1"])], axis=1))
        got = []
        for r in known.itertuples():
            at = min(r.lo, co.BACK)
            found, rest = co.features_from(data[r.lo - at:r.hi], at, r.inside, r.open)
            got += [data[r.lo - at + p:r.lo - at + q] for p, q in found]
            if rest is not None:
                whole = data[r.lo - at + rest:]
                got.append(json.JSONDecoder().raw_decode(whole.decode())[0])
        assert [v if isinstance(v, dict) else json.loads(v) for v in got] == want


def test_large_collections_are_read_by_many_tasks(spark, tmp_path):
    feature = lambda k: {"type": "Feature", "id": str(k), "properties": {"name": "[{" * (k % 5) + '"', "objectType": "cell" if k % 3 else "detection"}}
    (tmp_path / "a b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(k) for k in range(4000)]}))
    (tmp_path / "list.geojson").write_text(json.dumps([feature(k) for k in range(4000, 4100)]))
    (tmp_path / "none.geojson").write_text("")
    got = doc.read_features(spark, str(tmp_path), "detection", size=3001)
    assert sorted(int(r.f.id) for r in got.collect()) == [k for k in range(4100) if k % 3 == 0]
    assert got.select("file").distinct().count() == 2
    texts = co.feature_texts(spark, str(tmp_path / "a b.geojson"), size=3001)
    assert texts.select(F.spark_partition_id()).distinct().count() > 1
    places = [r.start for r in texts.orderBy(F.get_json_object("value", "$.id").cast("int")).collect()]
    assert places == sorted(places)
    whole = doc.read_features(spark, str(tmp_path / "a b.geojson"), whole=True).select("f.*")
    assert whole.exceptAll(doc.read_features(spark, str(tmp_path / "a b.geojson"), size=3001).select("f.*")).count() == 0


def test_a_broken_collection_is_an_error(spark, tmp_path):
    for name, text in (("cut", '{"features": [{"id": "a"}, {"id": "b'), ("closed", '{"features": []}]')):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="ends inside a value|not opened"):
            doc.read_features(spark, str(tmp_path / name)).collect()

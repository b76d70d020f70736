"""Sidecar files are read once, whatever asks for them."""

from cellweave.sources import documents as doc


def test_matching_reads_the_files_once(spark, tmp_path):
    for name in ("1", "2"):
        (tmp_path / f"{name}.txt").write_text(f"x = {name}")
    cars = doc.read_sidecars(spark, str(tmp_path))
    met, lone = doc.match_sidecars(spark.createDataFrame([("1",), ("3",)], "stem string"), cars)
    assert [r.stem for r in met.collect()] == ["1"] and [r.stem for r in lone.collect()] == ["3"]
    for df in (met, lone):
        assert "FileScan text" not in df._jdf.queryExecution().executedPlan().toString()


def test_mask_rows_are_moved_once(spark):
    from cellweave.operators import runs as rn

    px = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 1024, 1), (1, 0, 2)], "y long, x long, label long")
    runs = rn.pixels_to_runs(px)
    assert sorted(map(tuple, runs.collect())) == [(0, 0, 1, 1), (0, 1024, 1024, 1), (1, 0, 0, 2)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rn.pixels_to_runs(px)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

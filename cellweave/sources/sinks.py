"""Sinks: tables, GeoJSON features, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = {"skip": "ignore", "refuse": "errorifexists", "replace": "overwrite", "add": "append"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", present: str = "refuse", partition_by: list[str] | None = None) -> None:
    """``present`` says what happens when the table exists: skip, refuse, replace or add."""
    w = df.write.mode(MODES[present]).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def cell_features(cells: DataFrame, label: str = "label", contour: str = "contour", nucleus: str | None = None) -> DataFrame:
    """One GeoJSON polygon feature per cell as text; a cell lacking a wanted contour is left out.

    Contours are ``array<struct<x,y>>``.
    """
    ring = lambda c: F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(c, lambda p: F.array(p.x, p.y))).alias("coordinates"))
    needed = [contour] + ([nucleus] if nucleus else [])
    src = cells.na.drop("any", subset=needed)
    parts = [F.lit("Feature").alias("type"), F.uuid().alias("id"), ring(F.col(contour)).alias("geometry")]
    if nucleus:
        parts.append(ring(F.col(nucleus)).alias("nucleusGeometry"))
    parts.append(F.struct(F.lit("cell").alias("objectType"), F.struct(F.col(label).alias("label")).alias("measurements")).alias("properties"))
    return src.select(F.to_json(F.struct(*parts)).alias("value"))


def write_features(features: DataFrame, path: str, present: str = "refuse") -> None:
    """Gzip text, one feature per line."""
    features.write.mode(MODES[present]).option("compression", "gzip").text(path)


def log_runs(status: DataFrame, path: str) -> None:
    """Append one row per processed item ``(name, row_num, success, elapsed, message, shape)``."""
    status.write.mode("append").parquet(path)


def run_summary(log: DataFrame) -> DataFrame:
    """Numbers of successful and failed items."""
    return log.groupBy("success").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed").alias("elapsed"))


def failures(log: DataFrame) -> DataFrame:
    """Failed items by manifest row, rows without a number last."""
    return log.where(~F.col("success")).orderBy(F.col("row_num").asc_nulls_last(), "name")

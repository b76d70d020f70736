"""Scans of cell, spot and ROI tables and of name lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROI_SCHEMA = (
    "Id long, Name string, Text string, type string, all_points string, X double, Y double, RadiusX double, "
    "RadiusY double, Width double, Height double, all_transforms string")


def read_cells(spark: SparkSession, path: str | Sequence[str], schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV cell table with a given schema; unused columns are not parsed."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df if columns is None else df.select(*columns)


def read_spots(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df if columns is None else df.select(*columns)


def file_path() -> Column:
    return F.col("_metadata.file_path")


def read_tagged(
    spark: SparkSession, glob: str, pattern: str, names: Mapping[str, str], tag: str = "channel", out: str = "marker",
    base: str | None = None,
) -> DataFrame:
    """S3: Parquet files of one glob, each row tagged with the part of the file path that ``pattern`` finds
    and the marker name given for it. Names must be unique; a file without a name stops the job."""
    if len(set(names.values())) != len(names):
        raise ValueError("marker names must be unique")
    reader = spark.read if base is None else spark.read.option("basePath", base)
    df = reader.parquet(glob)
    found = F.regexp_extract(file_path(), pattern, 1)
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    marked = df.select("*", found.alias("_tag"))
    name = F.element_at(table, F.col("_tag"))
    named = F.when(name.isNull(), F.raise_error(F.concat(F.lit("no marker name for "), F.col("_tag")))).otherwise(name)
    return marked.withColumns({tag: F.col("_tag"), out: named}).drop("_tag")


def read_listed(spark: SparkSession, list_path: str, schema: str, out: str = "sample") -> DataFrame:
    """A text file names the CSV tables; each row gets the stem of its file as sample name.

    The driver holds the list of paths, as it does for any scan of so many files.
    """
    rows = spark.read.text(list_path).where(F.trim("value") != "").collect()
    if not rows:
        raise ValueError(f"{list_path} lists no tables")
    df = spark.read.schema(schema).option("header", True).csv([r.value.strip() for r in rows])
    return df.select("*", F.regexp_extract(file_path(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias(out))


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    """Shape table as exported, points still a string."""
    return spark.read.schema(ROI_SCHEMA).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, no header: ``(file, position, name)``; blank head and tail lines are cut,
    inner blank lines and repeated names stay. Lines are numbered within a block of the file, and a table of blocks
    supplies the lines before each block and the first and last line of the file that is not blank."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        file_path().alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"),
        F.trim(F.regexp_replace("value", "\r$", "")).alias("name"))
    numbered = lines.withColumn("_k", F.row_number().over(Window.partitionBy("file", "_b").orderBy("_i")))
    used = F.when(F.col("name") != "", F.col("_k"))
    blocks = numbered.groupBy("file", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min(used).alias("_u"), F.max(used).alias("_v"))
    earlier = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_o", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    every = Window.partitionBy("file")
    placed = placed.select("file", "_b", "_o", F.min(F.col("_o") + F.col("_u")).over(every).alias("_first"),
                           F.max(F.col("_o") + F.col("_v")).over(every).alias("_last"))
    line = F.col("_k") + F.col("_o")
    return numbered.join(placed, ["file", "_b"]).where((line >= F.col("_first")) & (line <= F.col("_last"))).select(
        "file", (line - F.col("_first")).cast("int").alias("position"), "name")


def file_counts(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows and columns per text table without parsing values: ``(file, n_rows, n_columns)``."""
    lines = spark.read.text(path).select(
        file_path().alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    return lines.groupBy("file").agg(
        (F.count(F.lit(1)) - 1).alias("n_rows"),
        F.size(F.split(F.min_by("value", F.struct("_b", "_i")), sep)).alias("n_columns"))

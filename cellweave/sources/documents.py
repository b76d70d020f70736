"""Parameter files, GeoJSON, sidecars and ROI records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import geometry as geo
from cellweave.session import durable
from cellweave.sources.collections import RANGE, feature_texts
from cellweave.sources.tables import file_path

FEATURE = (
    "struct<type:string,id:string,geometry:struct<type:string,coordinates:string,isEllipse:boolean,isRectangle:boolean>,"
    "properties:struct<name:string,objectType:string,classification:struct<name:string>,measurements:string>>")


def read_parameters(spark: SparkSession, path: str, case_pattern: str, step_pattern: str) -> DataFrame:
    """``(Key v1 v2 ...)`` lines to ``(file, case, step, key, values)``; other lines are skipped."""
    lines = spark.read.text(path).select(file_path().alias("file"), F.trim("value").alias("line"))
    return parse_parameters(lines).withColumns({
        "case": F.regexp_extract("file", case_pattern, 1), "step": F.regexp_extract("file", step_pattern, 1).try_cast("int")})


def parse_parameters(lines: DataFrame, line: str = "line") -> DataFrame:
    form = r"^\((\S+) (.*)\)$"
    body = F.regexp_extract(line, form, 2)
    values = F.transform(F.regexp_extract_all(body, F.lit(r'"[^"]*"|\S+'), F.lit(0)), lambda v: F.regexp_replace(v, '^"|"$', ""))
    return lines.where(F.col(line).rlike(form)).withColumns({"key": F.regexp_extract(line, form, 1), "values": values}).drop(line)


def read_features(
    spark: SparkSession, path: str, object_type: str | None = None, lines: bool = False, whole: bool = False, size: int = RANGE
) -> DataFrame:
    """GeoJSON features ``(file, f)``, optionally of one object type.

    Documents of any size are read by byte ranges of ``size``. With ``lines`` every line is a feature; with ``whole`` a file is one row,
    which small compressed files need.
    """
    if lines or whole:
        text = spark.read.text(path, wholetext=not lines).select(file_path().alias("file"), F.col("value"))
        return parse_features(text, object_type, lines)
    rows = feature_texts(spark, path, size).select("file", F.from_json("value", FEATURE).alias("f"))
    return rows if object_type is None else rows.where(F.col("f.properties.objectType") == object_type)


def parse_features(text: DataFrame, object_type: str | None = None, lines: bool = False, value: str = "value") -> DataFrame:
    others = [c for c in text.columns if c != value]
    if lines:
        body = F.regexp_replace(F.trim(F.col(value)), r",$", "")
        rows = text.where(body.startswith("{")).select(*others, F.from_json(body, FEATURE).alias("f"))
    else:
        doc = F.from_json(value, f"struct<features:array<{FEATURE}>>")
        rows = text.select(*others, F.explode(doc.features).alias("f"))
    return rows if object_type is None else rows.where(F.col("f.properties.objectType") == object_type)


# --- S15 ---------------------------------------------------------------------------------------

def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def roi_records(features: DataFrame, holes: str = "sibling") -> DataFrame:
    """Features to shape rows ``(id, roi_name, text, kind, part, ring, is_hole, points, cx, cy, rx, ry)``.

    The class names the ROI and the object name the shape, each standing in for the other. Ellipses and
    rectangles come back from the extremes of their ring. Inner rings become sibling shapes, or with
    ``holes="exclude"`` shapes of a ROI named ``Exclude``.
    """
    f = F.col("f")
    g = f.geometry
    coord = lambda depth: F.from_json(g.coordinates, "array<" * depth + "double" + ">" * depth)
    kind = g.type
    parts = (
        F.when(kind == "Polygon", F.array(coord(3))).when(kind == "MultiPolygon", coord(4))
        .when(kind == "LineString", F.array(F.array(coord(2)))).when(kind == "MultiPoint", F.transform(coord(2), lambda p: F.array(F.array(p))))
        .when(kind == "Point", F.array(F.array(F.array(coord(1))))))
    name = F.nullif(F.trim(f.properties["name"]), F.lit(""))
    cls = F.nullif(F.trim(f.properties.classification["name"]), F.lit(""))
    keep = [c for c in features.columns if c != "f"]
    base = features.select(
        *keep, f.id.alias("id"), F.coalesce(cls, name, F.lit("")).alias("roi_name"), F.coalesce(name, cls, F.lit("")).alias("text"),
        kind.alias("_k"), F.coalesce(g.isEllipse, F.lit(False)).alias("_e"), F.coalesce(g.isRectangle, F.lit(False)).alias("_q"),
        F.posexplode(parts).alias("part", "_rings"))
    rings = base.select("*", F.posexplode("_rings").alias("ring", "_ring")).withColumn("points", _points(F.col("_ring")))
    poly = F.col("_k").isin("Polygon", "MultiPolygon")
    hole = poly & (F.col("ring") > 0)
    shape = (
        F.when(poly & F.col("_e") & ~hole, "Ellipse").when(poly & F.col("_q") & ~hole, "Rectangle").when(poly, "Polygon")
        .when((F.col("_k") == "LineString") & (F.size("points") == 2), "Line").when(F.col("_k") == "LineString", "Polyline").otherwise("Point"))
    ell = geo.ellipse_from_ring(F.col("points"))
    boxed = F.col("kind").isin("Ellipse", "Rectangle")
    title = F.when(hole, F.lit("Exclude")).otherwise(F.col("roi_name")) if holes == "exclude" else F.col("roi_name")
    return rings.select(
        *keep, "id", title.alias("roi_name"), "text", shape.alias("kind"), "part", "ring", hole.alias("is_hole"), "points"
    ).withColumns({c: F.when(boxed, ell[c]) for c in ("cx", "cy", "rx", "ry")})


# --- S16 ---------------------------------------------------------------------------------------

def read_sidecars(spark: SparkSession, path: str, folder_pattern: str | None = None) -> DataFrame:
    """One small text per tile: ``(stem, text)``. The stem is the file name without its last suffix, or where sidecars lie in a
    folder per tile what ``folder_pattern`` finds in the path; files whose path lacks it are left out."""
    at = file_path()
    if folder_pattern is None:
        name = F.regexp_extract(at, r"([^/]+?)(?:\.[^./]*)?$", 1)
        return spark.read.text(path, wholetext=True).select(name.alias("stem"), F.col("value").alias("text"))
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.regexp_extract(at, folder_pattern, 1).alias("stem"), F.col("value").alias("text")).where(F.col("stem") != "")


def sidecar_numbers(text: Column, patterns: dict[str, str], defaults: dict[str, float] | None = None) -> list[Column]:
    """First number found by each pattern; a default stands in for an absent one."""
    out = []
    for name, p in patterns.items():
        v = F.regexp_extract(text, p, 1).try_cast("double")
        out.append((F.coalesce(v, F.lit(float(defaults[name]))) if defaults and name in defaults else v).alias(name))
    return out


def objects_named(text: Column, name: str, schema: str) -> Column:
    """JSON objects anywhere in a text whose ``name`` is the given one; they may hold flat objects themselves."""
    found = F.regexp_extract_all(text, F.lit(r"\{(?:[^{}]++|\{[^{}]*+\})*+\}"), F.lit(0))
    mine = F.filter(found, lambda t: F.get_json_object(t, "$.name") == name)
    return F.transform(mine, lambda t: F.from_json(t, schema))


def match_sidecars(tiles: DataFrame, sidecars: DataFrame, stem: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Tiles with their sidecar, and tiles without one (must be empty). The sidecars are stored first, so their files are read once."""
    sidecars = durable(sidecars)
    return tiles.join(sidecars, stem), tiles.join(sidecars.select(stem), stem, "left_anti")

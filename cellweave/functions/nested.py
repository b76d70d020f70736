"""Nested JSON, bit masks and waypoint records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import geometry as geo

CHANNEL = "struct<id:int,label:string,color:string,min:double,max:double>"
GROUPS = f"struct<groups:array<struct<label:string,channels:array<{CHANNEL}>,render:array<{CHANNEL}>>>>"
SETTINGS = "array<struct<name:string,channelSettings:map<string,struct<color:string,window:struct<start:double,end:double>>>>>"


def set_channel_windows(text: Column, lows: Column, highs: Column) -> Column:
    """new ``min``/``max`` by channel id (maps ``int -> double``) in every group; ids absent keep theirs."""
    doc = F.from_json(text, GROUPS)

    def one(c):
        return c.withField("min", F.coalesce(F.element_at(lows, c.id), c.min)).withField(
            "max", F.coalesce(F.element_at(highs, c.id), c.max))

    groups = F.transform(doc.groups, lambda g: g.withField("channels", F.transform(g.channels, one)).withField(
        "render", F.transform(g.render, one)))
    return F.to_json(F.struct(groups.alias("groups")))


def window_maps(windows: DataFrame, keys: list[str], channel: str, low: str, high: str) -> DataFrame:
    """Per document the maps that :func:`set_channel_windows` needs; one entry per channel."""
    return windows.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(channel).cast("int"), low))).alias("lows"),
        F.map_from_entries(F.collect_list(F.struct(F.col(channel).cast("int"), high))).alias("highs"))


def settings_to_groups(text: Column, names: Column, lo, hi) -> Column:
    """group settings (map by channel number) to the array form, windows normalised to ``lo..hi``."""
    span = F.lit(float(hi) - float(lo))

    def one(e):
        return F.struct(
            e.key.cast("int").alias("id"), F.get(names, e.key.cast("int")).alias("label"),
            F.regexp_replace(F.lower(e.value.color), "#", "").alias("color"),
            ((e.value.window.start - lo) / span).alias("min"), ((e.value.window.end - lo) / span).alias("max"))

    def group(g):
        channels = F.transform(F.map_entries(g.channelSettings), one)
        return F.struct(g["name"].alias("label"), channels.alias("channels"), channels.alias("render"))

    return F.to_json(F.struct(F.transform(F.from_json(text, SETTINGS), group).alias("groups")))


def unpack_bits(data: Column, height: Column, width: Column) -> Column:
    """base64 text to ``height * width`` bits, high bit first; short data repeat."""
    raw = F.unbase64(data)
    total = F.octet_length(raw) * 8

    def bit(i):
        j = F.pmod(i, total)
        byte = F.conv(F.hex(F.substring(raw, F.floor(j / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.floor(byte / F.pow(F.lit(2), 7 - j % 8)).cast("int") % 2

    return F.transform(F.sequence(F.lit(0), (height * width - 1).cast("int")), bit)


def mask_pixels(df: DataFrame, data: str, height: str, width: str) -> DataFrame:
    """set bits as pixel rows ``y, x``; the other columns stay."""
    bits = df.withColumn("_b", unpack_bits(F.col(data), F.col(height), F.col(width)))
    keep = [c for c in df.columns if c != data]
    flat = bits.select(*keep, F.posexplode("_b").alias("_i", "_v")).where(F.col("_v") == 1)
    return flat.withColumns({"y": F.floor(F.col("_i") / F.col(width)), "x": (F.col("_i") % F.col(width)).cast("long")}).drop("_i", "_v")


def polygon_text(points: Column, height: Column) -> Column:
    """coordinates over the image height, five decimals, comma separated."""
    xy = F.flatten(F.transform(points, lambda p: F.array(p.x, p.y)))
    return F.array_join(F.transform(xy, lambda v: F.format_string("%.5f", v / height)), ",")


def waypoint(name: Column, points: Column, height: Column, zoom: float = 1.0, group: str = "") -> Column:
    """story waypoint record of one shape."""
    c = geo.centroid(points)
    return F.struct(
        name.alias("Name"), F.lit("").alias("Description"), F.lit(float(zoom)).alias("Zoom"),
        F.array(c.x / height, c.y / height).alias("Pan"), polygon_text(points, height).alias("Polygon"),
        F.lit(group).alias("Group"))


def waypoints(shapes: DataFrame, image: str, must_contain: str | None = " | ", zoom: float = 4.0, group: str = "") -> DataFrame:
    """``(image, name, waypoint)``, one JSON record per shape ``(name, pts, height)`` whose name fits.

    The records of one image stay rows, however many there are; written with ``partitionBy(image)`` they
    form one story file set per image.
    """
    kept = shapes if must_contain is None else shapes.where(F.col("name").contains(must_contain))
    return kept.select(image, "name", F.to_json(waypoint(F.col("name"), F.col("pts"), F.col("height"), zoom, group)).alias("waypoint"))

"""File series: name patterns to typed columns and completeness."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.scalar import base_name
from cellweave.operators.joins import missing_combinations


def pattern_regex(pattern: str) -> tuple[str, list[str]]:
    """``img_s{series}_w{channel:02}.tif`` to a regular expression and its field names.

    A field with a number takes exactly so many characters, another one as few as possible.
    """
    fields, out = [], "^"
    for literal, field, width, _ in string.Formatter().parse(pattern):
        out += re.escape(literal)
        if field:
            fields.append(field)
            out += f"(.{{{int(width)}}})" if width.isdigit() else "(.*?)"
    return out + "$", fields


def parse_names(df: DataFrame, name: str, pattern: str, integers: Sequence[str] = ("series",)) -> DataFrame:
    """Rows whose name fits the pattern, one column per field; ``integers`` are cast."""
    regex, fields = pattern_regex(pattern)
    fit = df.where(F.col(name).rlike(regex))
    cols = {f: F.regexp_extract(name, regex, i + 1) for i, f in enumerate(fields)}
    return fit.withColumns({f: c.try_cast("long") if f in integers else c for f, c in cols.items()})


def list_series(
    spark: SparkSession, folder: str, pattern: str, integers: Sequence[str] = ("series",), parts: int = 1
) -> DataFrame:
    """Listing of a folder; file contents are not read. With ``parts`` above 1 subfolders are listed too and a name is the
    last ``parts`` parts of the path, so fields may stand in folder names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", parts > 1)
    files = reader.load(folder).select("path", "length")
    name = base_name(F.col("path")) if parts == 1 else F.substring_index("path", "/", -parts)
    return parse_names(files.withColumn("name", name), "name", pattern, integers)


def missing_images(series: DataFrame, fields: Sequence[str]) -> DataFrame:
    """J16 on a series: combinations without a file."""
    return missing_combinations(series, list(fields))

"""Manifests: one job per row, typed with defaults; bad rows are set aside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.sources.tables import file_path

# Texts that mean true.
TRUE_TEXTS = ("1", "yes", "y", "true", "t")


def read_manifest(
    spark: SparkSession, path: str, required: Mapping[str, str], optional: Mapping[str, tuple[str, object]]
) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``.

    ``required`` maps name to type, ``optional`` name to type and default. A filled field wins over the
    default; a required field that is empty or any field of a wrong type rejects the row. ``row_num`` counts
    non-blank lines, the header being 1. The file is split like any text file: lines are numbered within a
    block, and the number of lines before a block is added. Several part files count in the order of their names.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(
        file_path().alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"),
        F.regexp_replace("value", "^\ufeff|\r$", "").alias("_l"))
    lines = text.where(F.trim("_l") != "")
    first = lines.agg(F.min_by("_l", F.struct("_f", "_b", "_i")).alias("h")).first()
    if not first.h:
        raise ValueError("manifest is empty or has no header")
    header = [h.strip().strip('"') for h in first.h.split(",")]
    absent = [h for h in required if h not in header]
    if absent:
        raise ValueError(f"manifest lacks required headers: {', '.join(absent)}")
    order = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    before = lines.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "_f", "_b", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_o"))
    numbered = lines.withColumn("_k", F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i"))).join(before, ["_f", "_b"])
    ddl = ", ".join(f"`{h}` string" for h in header)
    rows = numbered.select((F.col("_k") + F.col("_o")).cast("int").alias("row_num"), F.from_csv("_l", ddl).alias("r")).where(
        "row_num > 1").select("row_num", "r.*")
    return typed_rows(rows, required, optional)


def typed_rows(
    rows: DataFrame, required: Mapping[str, str], optional: Mapping[str, tuple[str, object]], row_num: str = "row_num"
) -> tuple[DataFrame, DataFrame]:
    """The same for all-string rows that are already a DataFrame."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    done, reasons = {}, []
    for name, kind in required.items():
        done[name] = _cast(text(name), kind)
        reasons.append(F.when(text(name).isNull(), F.lit(f"{name} is missing")).when(
            done[name].isNull(), F.concat(F.lit(f"{name} is not {kind}: "), text(name))))
    for name, (kind, default) in optional.items():
        given = text(name) if name in rows.columns else F.lit(None).cast("string")
        done[name] = F.coalesce(_cast(given, kind), F.lit(default).cast(kind))
        reasons.append(F.when(given.isNotNull() & _cast(given, kind).isNull(), F.concat(F.lit(f"{name} is not {kind}: "), given)))
    marked = rows.withColumn("_why", F.concat_ws("; ", *reasons))
    good = marked.where(F.col("_why") == "").select(row_num, *[c.alias(n) for n, c in done.items()])
    bad = marked.where(F.col("_why") != "").select(row_num, F.col("_why").alias("reason"))
    return good, bad


def _cast(text, kind: str):
    if kind == "boolean":
        return F.when(text.isNotNull(), F.lower(text).isin(*TRUE_TEXTS))
    return text.try_cast(kind)

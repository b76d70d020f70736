"""Mergeable sketches of values and objects per slide and channel, stored by phase and merged later.

A phase (one scan, one day) reads its rows once and stores a row per group: counts, extremes, a quantile sketch and a
sketch of distinct objects. Later phases never read those rows again: quantiles, ranks and distinct counts of any union
of phases and any coarser grouping come from the stored rows. Sketches are built map-side, so a group with a third of all
rows sends one sketch per task. Nulls and NaN are left out; a group without a value keeps its row, with null answers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of the quantile sketch (``k``) and of the distinct sketch (base-2 logarithm of its slots).
QUANTILE_SIZE, DISTINCT_LOG_SIZE = 800, 14


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """Stated error of a rank, as a share of the rows, that holds with 99 % for one question (published fit for this sketch)."""
    return 2.296 / size ** 0.9021


def distinct_error(log_size: int = DISTINCT_LOG_SIZE) -> float:
    """Stated relative standard error of a distinct count."""
    return 1.04 / math.sqrt(2 ** log_size)


def sketch(
    rows: DataFrame, keys: Sequence[str], value: str, obj: str | None = None,
    size: int = QUANTILE_SIZE, log_size: int = DISTINCT_LOG_SIZE,
) -> DataFrame:
    """``(keys, n, lowest, highest, values_sketch[, objects_sketch])``; ``obj`` counts labels above 0 only, whatever their value."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    aggs = [F.count(v).alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
            F.kll_sketch_agg_double(v, F.lit(size)).alias("values_sketch")]
    if obj is not None:
        label = F.col(obj).cast("long")
        aggs.append(F.hll_sketch_agg(F.when(label > 0, label), F.lit(log_size)).alias("objects_sketch"))
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def store_phase(sketches: DataFrame, path: str, phase: str) -> None:
    """Store the sketches of one phase; a phase that is run again replaces its own rows, so none counts twice."""
    if not phase or "/" in phase or "=" in phase:
        raise ValueError("a phase is a plain, non-empty folder name")
    sketches.write.mode("overwrite").parquet(f"{path.rstrip('/')}/phase={phase}")


def stored_phases(spark: SparkSession, path: str, phases: Sequence[str] | None = None) -> DataFrame:
    """Stored sketches with their ``phase`` (a string); ``phases`` prunes folders."""
    schema = spark.read.option("basePath", path).parquet(path).drop("phase").schema.add("phase", "string")
    out = spark.read.schema(schema).option("basePath", path).parquet(path)
    return out if phases is None else out.where(F.col("phase").isin(*phases))


def merge(sketches: DataFrame, keys: Sequence[str], size: int = QUANTILE_SIZE) -> DataFrame:
    """One row per ``keys`` (any subset of the keys of the build) from stored rows."""
    aggs = [F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
            F.kll_merge_agg_double("values_sketch", F.lit(size)).alias("values_sketch")]
    if "objects_sketch" in sketches.columns:
        aggs.append(F.hll_union_agg("objects_sketch").alias("objects_sketch"))
    return sketches.groupBy(*keys).agg(*aggs) if keys else sketches.agg(*aggs)


def sketched_quantiles(sketches: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """A14 from sketches: ``(keys, p, q)``; 0 and 1 are exact, others have the rank asked for within :func:`rank_error`."""
    asked = F.array(*[F.lit(float(p)) for p in probs])
    q = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("values_sketch", asked))
    ends = lambda p, found: F.when(p <= 0, F.col("lowest")).when(p >= 1, F.col("highest")).otherwise(found)
    pairs = F.transform(asked, lambda p, i: F.struct(p.alias("p"), ends(p, F.get(q, i)).alias("q")))
    return sketches.select(*keys, F.inline(pairs))


def sketched_ranks(sketches: DataFrame, keys: Sequence[str], values: Sequence[float]) -> DataFrame:
    """Share of rows at or below each value: ``(keys, value, share)``, e.g. what a gate would keep, without the rows."""
    asked = F.array(*[F.lit(float(v)) for v in values])
    r = F.when(F.col("n") > 0, F.kll_sketch_get_rank_double("values_sketch", asked))
    return sketches.select(*keys, F.inline(F.transform(asked, lambda v, i: F.struct(v.alias("value"), F.get(r, i).alias("share")))))


def sketched_objects(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A10 from sketches: ``(keys, n_objects)``, an estimate with the standard error of :func:`distinct_error`."""
    return sketches.select(*keys, F.hll_sketch_estimate("objects_sketch").alias("n_objects"))


def rank_gaps(rows: DataFrame, keys: Sequence[str], value: str, found: DataFrame) -> DataFrame:
    """How far the ranks of ``found`` ``(keys, p, q)`` lie from those asked for, by one exact pass over the rows: ``(keys, p, n, gap)``.

    A value that occurs often has a span of ranks; the gap is the distance of ``p`` from that span. The answers of a group are
    an array, one row per group, attached to counted values by key, so a value held by a third of all rows is one row.
    ``keys`` are one name at least and never null.
    """
    answers = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("p", "q"))).alias("_a"))
    v = F.col(value).cast("double")
    hit = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    each = hit.join(answers, list(keys)).select(*keys, "_v", "_n", F.inline("_a"))
    share = lambda cond: F.sum(F.when(cond, F.col("_n")).otherwise(0)) / F.sum("_n")
    spans = each.groupBy(*keys, "p").agg(
        F.sum("_n").alias("n"), share(F.col("_v") < F.col("q")).alias("_lo"), share(F.col("_v") <= F.col("q")).alias("_hi"))
    return spans.select(*keys, "p", "n", F.greatest(F.col("_lo") - F.col("p"), F.col("p") - F.col("_hi"), F.lit(0.0)).alias("gap"))

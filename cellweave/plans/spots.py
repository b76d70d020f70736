"""Entry plan: spots to per-cell counts, merged over channels and attached to the cell table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.frames import fill_and_round
from cellweave.operators.joins import gather, pivot_known
from cellweave.operators.regions import valid_spots


def spots_per_pixel(spots: DataFrame, keys: Sequence[str], channel: str, value: str) -> DataFrame:
    """Spots of one pixel combined before the mask is looked up, so a hot pixel is one row per channel."""
    return spots.where(F.col(value) > 0).groupBy(*keys, channel).agg(
        F.sum(value).alias("sum_peak_int"), F.count(F.lit(1)).alias("count"))


def count_spots(
    spots: DataFrame, channels: Sequence[str], obj: str = "mask_id", channel: str = "channel",
    value: str = "channel_intensity",
) -> DataFrame:
    """Sum and count per object as ``<stat>_<channel>`` columns: one shuffle for any number of channels."""
    rows = valid_spots(spots, obj, value).select(obj, channel, F.col(value).alias("sum_peak_int"), F.lit(1.0).alias("count"))
    merged = pivot_known(rows, [obj], channel, list(channels), {"sum_peak_int": F.sum, "count": F.sum}, 0.0)
    return fill_and_round(merged, [c for c in merged.columns if c != obj])


def count_spots_on_mask(
    spots: DataFrame, mask: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("Y", "X"),
    channel: str = "channel", value: str = "channel_intensity",
) -> DataFrame:
    """The same from raw spots and a label pixel table."""
    placed = gather(spots_per_pixel(spots, keys, channel, value), mask, keys).where(F.col("mask_id") > 0)
    merged = pivot_known(placed, ["mask_id"], channel, list(channels), {"sum_peak_int": F.sum, "count": F.sum}, 0.0)
    return fill_and_round(merged, [c for c in merged.columns if c != "mask_id"])


def cell_table_with_spots(cells: DataFrame, spots: DataFrame, key: str, channels: Sequence[str]) -> DataFrame:
    """Cell table left-joined with its spot counts; cells without spots get zeros."""
    counts = count_spots(spots, channels).withColumnRenamed("mask_id", key)
    out = cells.join(counts, key, "left")
    return fill_and_round(out, [c for c in counts.columns if c != key])

"""Entry plan: class strings to cell types, then neighbourhood statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.frames import class_indicators
from cellweave.operators.joins import type_by_pattern
from cellweave.operators.stats import fold_rare, pattern_sizes


def typed_cells(
    cells: DataFrame, cls: str, markers: Sequence[str], conditions: DataFrame, min_rows: int = 0, cell_type: str = "cell_type"
) -> DataFrame:
    """Multi-hot markers, pattern to type; types with fewer than ``min_rows`` cells become ``Others``."""
    hot = class_indicators(cells, cls, markers)
    typed = type_by_pattern(hot, conditions, markers, cell_type)
    return fold_rare(typed, cell_type, min_rows) if min_rows else typed


def annotation_table(cells: DataFrame, cls: str, markers: Sequence[str], min_size: int = 100) -> DataFrame:
    """Pattern sizes for a person to fill in: markers, COUNT and an empty ``CELL TYPE``."""
    sizes = pattern_sizes(class_indicators(cells, cls, markers), markers, min_size)
    return sizes.select(*markers, F.col("n").alias("COUNT"), F.lit("").alias("CELL TYPE")).orderBy(F.col("COUNT").desc(), *markers)

"""Extension points for callers: row functions (X3) and functions per marker."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.ordered import attach_small


def add_columns(
    df: DataFrame, columns: Mapping[str, Column], rows: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str = ""
) -> DataFrame:
    """Columns from expressions; ``rows`` adds those of ``schema`` batch-wise where no expression exists."""
    out = df.withColumns(dict(columns))
    if rows is None:
        return out
    full = ", ".join([f"`{n}` {t}" for n, t in out.dtypes] + [schema])

    def batches(it):
        for pdf in it:
            yield rows(pdf)

    return out.mapInPandas(batches, full)


def apply_lines(long: DataFrame, lines: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Slope and intercept per key applied to long marker values; keys without a line keep their value."""
    table = lines.select(*keys, "slope", "intercept")
    joined = attach_small(long, table, list(keys))
    return joined.withColumn(value, F.col("slope") * F.col(value) + F.col("intercept")).drop("slope", "intercept")


def apply_lines_wide(df: DataFrame, lines: Mapping[str, tuple[float, float]]) -> DataFrame:
    """The same on wide columns; a column without a line stays as it is."""
    return df.withColumns({m: F.col(m) * a + b for m, (a, b) in lines.items()})

"""Derived plans: marker scaling between samples, principal components, embedding density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.ordered import attach_one_row, attach_small
from cellweave.operators.stats import anchors, fit_lines, grid_counts, unpivot_markers
from cellweave.plans.extend import apply_lines


def scaling_lines(long: DataFrame, reference: object, tails: dict, use: Sequence[str], sample: str = "sample") -> DataFrame:
    """Slope and intercept per ``(sample, marker)`` that take the chosen anchors to those of the reference."""
    a = anchors(long, [sample, "marker"], "value", tails).where(F.col("anchor").isin(*use))
    ref = a.where(F.col(sample) == reference).select("marker", "anchor", F.col("value").alias("target"))
    lines = fit_lines(attach_small(a, ref, ["marker", "anchor"]), [sample, "marker"], "value", "target")
    same = F.col(sample) == reference
    return lines.withColumns({"slope": F.when(same, 1.0).otherwise(F.col("slope")), "intercept": F.when(same, 0.0).otherwise(F.col("intercept"))})


def scale_samples(df: DataFrame, markers: Sequence[str], reference: object, tails: dict, use: Sequence[str], sample: str = "sample", ids: Sequence[str] = ()) -> DataFrame:
    """Log values of all samples on the scale of the reference, long form."""
    long = unpivot_markers(df.select(sample, *ids, *[F.log1p(m).alias(m) for m in markers]), [sample, *ids], markers)
    return apply_lines(long, scaling_lines(long, reference, tails, use, sample), [sample, "marker"])


def principal_components(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Columns ``pc1..pck``; the data are centred first, which the Spark projection does not do."""
    means = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    centred = attach_one_row(df, means).withColumn(
        "_v", array_to_vector(F.array(*[(F.col(c) - F.col(f"_m{i}")).cast("double") for i, c in enumerate(columns)])))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(centred)
    loads = model.pc.toArray()
    signs = [1.0 if loads[abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]  # the largest loading is positive
    parts = vector_to_array("_p")
    return model.transform(centred).select(*df.columns, *[(parts[i] * signs[i]).alias(f"pc{i + 1}") for i in range(k)])


def embedding_density(df: DataFrame, x: str, y: str, size: float, sample: str) -> DataFrame:
    """Grid over a 2-D embedding: counts per cell and sample."""
    return grid_counts(df, x, y, size, keys=[sample])

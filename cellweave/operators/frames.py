"""Row and column operators on cell tables (P1-P17), ordering (W1, W2, W4, W5) and unions/sampling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.ordered import attach_one_row, attach_small, ordered_fill, quantiles, running_sum

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType)


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in skip]


# --- projections -------------------------------------------------------------------------------

def select_listed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fixed column list."""
    return df.select(*names)


def select_span(df: DataFrame, first: str | int, last: str | int) -> DataFrame:
    """Slice of the header; names are inclusive, positions half-open."""
    cols = df.columns
    lo = cols.index(first) if isinstance(first, str) else first
    hi = cols.index(last) + 1 if isinstance(last, str) else last
    return df.select(*cols[lo:hi])


def select_like(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name contains ``text``, after the ``keep`` columns."""
    return df.select(*keep, *[c for c in df.columns if text in c and c not in keep])


def rename(df: DataFrame, how: Mapping[str, str] | Callable[[str], str]) -> DataFrame:
    """Rename by map or by function of the name."""
    pairs = how if isinstance(how, Mapping) else {c: how(c) for c in df.columns}
    return df.withColumnsRenamed({a: b for a, b in pairs.items() if a != b})


def prefix_unless(df: DataFrame, prefix: str, unless: str, skip: Sequence[str] = ()) -> DataFrame:
    """Prefix every column unless its name contains ``unless``."""
    return rename(df, lambda c: c if unless in c or c in skip else f"{prefix}{c}")


def drop_like(df: DataFrame, text: str) -> DataFrame:
    """Drop columns whose name contains ``text``."""
    return df.drop(*[c for c in df.columns if text in c])


# --- predicates --------------------------------------------------------------------------------

def where_text(df: DataFrame, predicate: str) -> DataFrame:
    """Predicate written by the caller; ``==`` and ``&``/``|`` between comparisons are accepted."""
    return df.where(F.expr(predicate_sql(predicate)))


def predicate_sql(predicate: str) -> str:
    """Operators in SQL's spelling; quoted text and quoted names stay as they are."""
    import re

    spelled = {"==": "=", "&": " AND ", "|": " OR "}
    token = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|==|&|\|""")
    return token.sub(lambda m: spelled.get(m[0], m[0]), predicate)


def crop(df: DataFrame, x: str, y: str, xlim: Sequence[float], ylim: Sequence[float]) -> DataFrame:
    """Inclusive range on two axes."""
    return df.where(F.col(x).between(*xlim) & F.col(y).between(*ylim))


def min_above(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """Keep rows whose smallest value over ``cols`` exceeds ``threshold`` (missing skipped)."""
    return df.where(F.least(*[missing_to_null(c) for c in cols]) > F.lit(threshold))


def missing_to_null(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def assign_where(df: DataFrame, mask: Column, values: Mapping[str, object]) -> DataFrame:
    """P10: constants into several columns where ``mask`` holds."""
    return df.withColumns({c: F.when(mask, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def label_if_contains(name: Column, text: str, yes: str, no: str) -> Column:
    """Label derived from a file name, ignoring case."""
    return F.when(F.lower(name).contains(text.lower()), F.lit(yes)).otherwise(F.lit(no))


def fill_and_round(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Null and NaN to zero, then half-to-even rounding."""
    kinds = {f.name: f.dataType for f in df.schema}
    cols = numeric_columns(df) if cols is None else cols
    done = {}
    for c in cols:
        filled = F.coalesce(missing_to_null(c), F.lit(0)).cast(kinds[c])
        done[c] = F.bround(filled, digits).cast(kinds[c])
    return df.withColumns(done)


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without null or NaN."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def row_sum(cols: Sequence[str]) -> Column:
    """Row-wise sum, missing counted as zero."""
    return reduce(add, [F.coalesce(missing_to_null(c), F.lit(0)) for c in cols])


def class_indicators(
    df: DataFrame, cls: str, markers: Sequence[str] | None = None, excluded: str = "Ignore*", sep: str = ": ",
    max_markers: int = 2000,
) -> DataFrame:
    """One boolean column per marker named in a compound class; the excluded class has none.

    Without ``markers`` the distinct names are looked up; their number becomes a column count, so it is
    checked against ``max_markers``; :func:`class_markers` has no such bound.
    """
    import re

    parts = F.split(F.col(cls), re.escape(sep))
    if markers is None:
        found = (
            df.where(F.col(cls) != excluded).select(F.explode(parts).alias("m")).distinct()
            .orderBy("m").limit(max_markers + 1).collect()
        )
        if len(found) > max_markers:
            raise ValueError(f"more than {max_markers} marker names in {cls}")
        markers = [r.m for r in found]
    usable = F.coalesce(F.col(cls) != excluded, F.lit(False))
    return df.withColumns({m: usable & F.coalesce(F.array_contains(parts, m), F.lit(False)) for m in markers})


def class_markers(df: DataFrame, cls: str, excluded: str = "Ignore*", sep: str = ": ") -> DataFrame:
    """P15 in long form: one row per marker that the class of a row names, in ``marker``; any number of names."""
    import re

    return df.where(F.col(cls) != excluded).withColumn("marker", F.explode(F.array_distinct(F.split(F.col(cls), re.escape(sep)))))


def gate(df: DataFrame, gates: Mapping[str, float], suffix: str = "+") -> DataFrame:
    """Marker above its cut-off, one boolean column per marker."""
    return df.withColumns({f"{m}{suffix}": F.col(m) > F.lit(g) for m, g in gates.items()})


def gate_long(df: DataFrame, gates: DataFrame, marker: str = "marker", value: str = "value") -> DataFrame:
    """P16 for many markers: long table joined with a gate table ``(marker, gate)``."""
    return attach_small(df, gates, [marker], how="left").withColumn("positive", F.col(value) > F.col("gate"))


def flag_contains(df: DataFrame, text_col: str, text: str, flag: str, ordered: bool = True) -> DataFrame:
    """Flag rows whose text contains ``text``; sort by flag, then text."""
    out = df.withColumn(flag, F.col(text_col).contains(text))
    return out.orderBy(flag, text_col) if ordered else out


# --- order -------------------------------------------------------------------------------------

def top_n(df: DataFrame, score: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """Best ``n`` rows by score (a top-k plan, no global sort)."""
    return df.orderBy(F.col(score).desc(), *ties).limit(n)


def arg_max(df: DataFrame, keys: Sequence[str], item: str, score: str) -> DataFrame:
    """Item with the best score per group; equal scores give the smallest item."""
    best = F.max_by(F.col(item), F.struct(F.col(score), -F.col(item)))
    return df.groupBy(*keys).agg(best.alias(item), F.max(score).alias(score))


def fill_down(df: DataFrame, order: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Repeat the last label seen in file order."""
    return ordered_fill(df, list(keys), order, value)


def cumulative(df: DataFrame, order: str, value: str, keys: Sequence[str] = (), out: str = "running") -> DataFrame:
    """Running sum over ordered steps."""
    return running_sum(df, list(keys), order, {out: value})


def running_product(factors: Column) -> Column:
    """Running product of an array of step factors."""
    step = F.transform(
        factors, lambda _, i: F.aggregate(F.slice(factors, 1, i + 1), F.lit(1.0), lambda a, x: a * x)
    )
    return step


# --- unions, sets, samples ---------------------------------------------------------------------

def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Row union by name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def seen_exactly(df: DataFrame, cols: Sequence[str], position: str, times: int = 2) -> DataFrame:
    """Distinct rows with first position and multiplicity, kept when seen exactly ``times``."""
    seen = df.groupBy(*cols).agg(F.min(position).alias("first_pos"), F.count(F.lit(1)).alias("n"))
    return seen.where(F.col("n") == times)


def joined_names(cols: Sequence[str], sep: str = ", ") -> Column:
    """Set of non-empty names as one text, in alphabetical order."""
    names = F.filter(F.array(*[F.col(c) for c in cols]), lambda v: v.isNotNull() & (v != ""))
    return F.array_join(F.array_sort(F.array_distinct(names)), sep)


def key_hash(keys: Sequence[str], seed: int = 0) -> Column:
    """48 bits of a digest of seed and keys as text: the same for equal keys on every machine and in other engines. A null is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("null")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 12), 16, 10).cast("long")


def sample_fraction(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 0) -> DataFrame:
    """U4: a row is kept when the hash of its key falls below ``fraction``; independent of partitioning."""
    return df.where(key_hash(keys, seed) < F.lit(int(fraction * (1 << 48))))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """U4: exactly ``min(n, rows)`` rows, chosen by key hash (top-k plan)."""
    return df.orderBy(key_hash(keys, seed), *keys).limit(n)


def full_tiles(tiles: DataFrame, size: int, height: str = "h", width: str = "w") -> DataFrame:
    """Tiles of the full size; those cut off by the image border are left out before sampling."""
    return tiles.where((F.col(height) == size) & (F.col(width) == size))


def stratified_sample(
    df: DataFrame, value: str, keys: Sequence[str], n_bins: int, per_bin: int, p0: float = 0.0, p100: float = 1.0,
    seed: int = 0, padded: bool = True,
) -> DataFrame:
    """``per_bin`` items from each percentile bin; values outside ]p0, p100[ are left out.

    The pick is done in two steps, so a bin that holds most rows is never ranked in one task: every
    salt keeps its own best ``per_bin`` hashes first. Short bins repeat their last item.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    if p0 > 0 or p100 < 1:
        lim = quantiles(clean, [], value, [p0, p100], wide=True)
        clean = attach_one_row(clean, lim)
        if p0 > 0:
            clean = clean.where(F.col(value) > F.col("q")[0])
        if p100 < 1:
            clean = clean.where(F.col(value) < F.col("q")[1])
        clean = clean.drop("q")
    edges = quantiles(clean, [], value, [i / n_bins for i in range(n_bins + 1)], wide=True)
    inner = F.slice(F.col("q"), 2, n_bins - 1)
    binned = attach_one_row(clean, edges).withColumn(
        "bin", F.size(F.filter(inner, lambda e: e <= F.col(value))) + 1
    ).drop("q")
    ranked = binned.withColumn("_h", key_hash(keys, seed)).withColumn("_salt", F.pmod(F.col("_h"), F.lit(256)))
    order = [F.col("_h"), *[F.col(k) for k in keys]]
    first = Window.partitionBy("bin", "_salt").orderBy(*order)
    last = Window.partitionBy("bin").orderBy(*order)
    picked = (
        ranked.withColumn("slot", F.row_number().over(first)).where(F.col("slot") <= per_bin)
        .withColumn("slot", F.row_number().over(last)).where(F.col("slot") <= per_bin)
        .drop("_h", "_salt")
    )
    if not padded:
        return picked
    have = F.count(F.lit(1)).over(Window.partitionBy("bin"))
    repeats = F.when(
        F.col("slot") == F.col("_n"), F.sequence(F.col("slot"), F.lit(per_bin))
    ).otherwise(F.array("slot"))
    return picked.withColumn("_n", have).withColumn("slot", F.explode(repeats)).drop("_n")


def combine_cycles(
    channels: DataFrame, reference_cycle: str, dna_channel: int = 0, cycle: str = "cycle", channel: str = "channel",
    height: str = "h", width: str = "w",
) -> DataFrame:
    """All channels of every cycle, the DNA channel only from the reference cycle.

    Sizes must agree over all cycles and no cycle may end up empty; a violation stops the job.
    """
    sizes = channels.agg(
        F.min(height).alias("_h0"), F.max(height).alias("_h1"), F.min(width).alias("_w0"), F.max(width).alias("_w1")
    )
    keep = (F.col(cycle) == reference_cycle) | (F.col(channel) != dna_channel)
    per_cycle = channels.groupBy(cycle).agg(F.count(F.when(keep, 1)).alias("_kept"))
    worst = per_cycle.agg(F.min("_kept").alias("_least"))
    guarded = attach_one_row(attach_one_row(channels.where(keep), sizes), worst)
    problem = (
        F.when((F.col("_h0") != F.col("_h1")) | (F.col("_w0") != F.col("_w1")), F.lit("image sizes differ"))
        .when(F.col("_least") == 0, F.lit("a cycle has no channel left"))
    )
    ok = guarded.withColumn(channel, F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col(channel)))
    return ok.drop("_h0", "_h1", "_w0", "_w1", "_least")

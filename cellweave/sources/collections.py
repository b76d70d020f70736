"""Features of GeoJSON documents of any size, read by byte ranges.

A file is cut into ranges. What a byte means depends on all bytes before it, so there are two passes. In the first every range tells,
once for a start outside and once for a start inside a string, how many open brackets it closes, which ones it leaves open
and whether it ends inside a string. Folded in file order, a few numbers for each range, this gives the state at the start of every range. In the
second pass a range cuts out the features that begin in it; the last one may end in a later range and is read on to its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.tables import file_path

RANGE = 8 << 20
BACK = 256  # bytes read ahead of a range: backslashes before a quote, the key before a bracket
KEY = re.compile(rb'"features"\s*:\s*$')
RANGES = "file string, size long, lo long, hi long"
STATES = RANGES + ", inside boolean, open string"


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``(file, size, lo, hi)`` of all files below ``path``; file contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(file_path().alias("file"), F.col("length").alias("size")).where("size > 0")
    cuts = files.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))))
    return cuts.withColumn("hi", F.least(F.col("lo") + size, "size"))


class Opened:
    """Random reads of one file after another."""

    def __init__(self) -> None:
        self.name, self.stream = None, None

    def read(self, name: str, lo: int, hi: int) -> bytes:
        if name != self.name:
            self.close()
            fs, path = pafs.FileSystem.from_uri(name)
            self.name, self.stream = name, fs.open_input_file(path)
        return self.stream.read_at(hi - lo, lo)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()

    def with_back(self, name: str, lo: int, hi: int) -> tuple[bytes, int]:
        """The range and what is needed of the bytes before it, and where the range begins in that."""
        back = min(lo, BACK)
        while True:
            data = self.read(name, lo - back, hi)
            if back == lo or data[:back].strip(b"\\"):
                return data, back
            back = min(lo, 2 * back)


def marks(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions from ``at`` of quotes that are not escaped, and of brackets wherever they are."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 34)
    if (b == 92).any():
        plain = np.maximum.accumulate(np.where(b == 92, -1, np.arange(len(b))))
        run = np.where(quotes > 0, quotes - 1 - plain[np.maximum(quotes - 1, 0)], 0)
        quotes = quotes[run % 2 == 0]
    brackets = np.flatnonzero((b | 32 == 123) | (b | 32 == 125))
    return quotes[quotes >= at], brackets[brackets >= at]


def outside(quotes: np.ndarray, brackets: np.ndarray, inside: bool) -> np.ndarray:
    return brackets[(np.searchsorted(quotes, brackets) + inside) % 2 == 0]


def steps(data: bytes, at: np.ndarray) -> np.ndarray:
    """1 for an opening bracket, -1 for a closing one."""
    return np.where(np.frombuffer(data, np.uint8)[at] | 32 == 123, 1, -1)


def kind(data: bytes, at: int) -> str:
    """``o`` for an object, ``f`` for the array of a key ``features``, ``a`` for another array."""
    if data[at] == 123:
        return "o"
    return "f" if KEY.search(data, max(0, at - BACK), at) else "a"


def summary(data: bytes, at: int) -> list:
    """``odd`` and, for a start outside and inside a string, the number of brackets closed and the kinds left open."""
    quotes, brackets = marks(data, at)
    out: list = [bool(len(quotes) % 2)]
    for inside in (False, True):
        where = outside(quotes, brackets, inside)
        step = steps(data, where)
        depth = step.cumsum()
        least = np.minimum.accumulate(depth[::-1])[::-1]
        left = where[(step == 1) & (least >= depth)]
        out += [int(max(0, -depth.min())) if len(depth) else 0, "".join(kind(data, p) for p in left)]
    return out


def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    files = Opened()
    for b in batches:
        rows = [summary(*files.with_back(r.file, r.lo, r.hi)) for r in b.itertuples(index=False)]
        yield pd.concat([b, pd.DataFrame(rows, columns=["odd", "closed0", "left0", "closed1", "left1"])], axis=1)
    files.close()


def states(ranges: pd.DataFrame) -> pd.DataFrame:
    """State at the start of each range of one file: in a string or not, kinds of the open brackets."""
    ranges = ranges.sort_values("lo")
    inside, open_ = False, ""
    rows = []
    for r in ranges.itertuples(index=False):
        rows.append((r.file, r.size, r.lo, r.hi, inside, open_))
        closed, left = (r.closed1, r.left1) if inside else (r.closed0, r.left0)
        if closed > len(open_):
            raise ValueError(f"{r.file}: a bracket is closed that was not opened, between bytes {r.lo} and {r.hi}")
        open_ = open_[:len(open_) - closed] + left
        inside ^= r.odd
    if inside or open_:
        raise ValueError(f"{ranges['file'].iloc[0]}: ends inside a value")
    return pd.DataFrame(rows, columns=["file", "size", "lo", "hi", "inside", "open"])


def features_from(data: bytes, at: int, inside: bool, open_: str) -> tuple[list[tuple[int, int]], int | None]:
    """Begin and end of the features that begin from ``at``; the begin of one that does not end in ``data``."""
    where = outside(*marks(data, at), inside)
    step = steps(data, where)
    after = len(open_) + step.cumsum()
    before = after - step

    def parents(level: int) -> tuple[np.ndarray, np.ndarray]:
        new = where[(step == 1) & (before == level)]
        first = open_[level] if len(open_) > level else "-"
        return new, np.array([first, *[kind(data, p) for p in new]])

    opens = (step == 1) & (np.frombuffer(data, np.uint8)[where] == 123)
    roots, root_kinds = parents(0)
    found, rest = [], None
    for level in (1, 2):
        k = np.flatnonzero(opens & (before == level))
        root = root_kinds[np.searchsorted(roots, where[k])]
        if level == 1:
            k = k[root == "a"]
        else:
            holders, holder_kinds = parents(1)
            k = k[(root == "o") & (holder_kinds[np.searchsorted(holders, where[k])] == "f")]
        ends = where[(step == -1) & (after == level)]
        e = np.searchsorted(ends, where[k])
        whole = e < len(ends)
        found += list(zip(where[k[whole]].tolist(), (ends[e[whole]] + 1).tolist(), strict=True))
        rest = int(where[k[~whole]][0]) if not whole.all() else rest
    return sorted(found), rest


def read_on(files: Opened, name: str, lo: int, size: int) -> bytes:
    """The object that begins at ``lo``, wherever it ends."""
    length = 1 << 16
    while True:
        data = files.read(name, lo, min(size, lo + length))
        where = outside(*marks(data, 0), False)
        end = where[steps(data, where).cumsum() == 0]
        if len(end):
            return data[:end[0] + 1]
        if lo + length >= size:
            raise ValueError(f"{name}: the object at byte {lo} has no end")
        length *= 4


def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    files = Opened()
    for b in batches:
        for r in b.itertuples(index=False):
            data, at = files.with_back(r.file, r.lo, r.hi)
            found, rest = features_from(data, at, r.inside, r.open)
            rows = [(r.file, r.lo - at + p, data[p:q].decode()) for p, q in found]
            if rest is not None:
                rows.append((r.file, r.lo - at + rest, read_on(files, r.file, r.lo - at + rest, r.size).decode()))
            if rows:
                yield pd.DataFrame(rows, columns=["file", "start", "value"])
    files.close()


def feature_texts(spark: SparkSession, path: str, size: int = RANGE, tasks: int | None = None) -> DataFrame:
    """``(file, start, value)``: every feature as text with the byte it begins at.

    Features are the objects in the array ``features`` of a document, or of a document that is a list itself; a file may hold several
    documents. Nothing else in a document counts, whatever it is named. Empty files have no features; a file that ends inside a value is an
    error. Files must not be compressed. ``tasks`` is the number of tasks, by default that of the shuffle partitions.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = byte_ranges(spark, path, size).repartition(tasks, "file", "lo")
    told = spread.mapInPandas(summaries, RANGES + ", odd boolean, closed0 long, left0 string, closed1 long, left1 string")
    known = told.groupBy("file").applyInPandas(states, STATES)
    return known.repartition(tasks, "file", "lo").mapInPandas(cut, "file string, start long, value string")

"""Fill-in-the-middle: a text is cut at two boundaries of its units and written as prefix, suffix and middle behind markers.

The boundaries of a text, as code point offsets, are a compressed sorted set: the upper bits of an offset choose a container of 65,536
places, which is an array of its members, a bitmap or a list of runs, whichever is smallest. ``counts`` holds how many members come before
each container. The k-th boundary is found by a search in ``counts`` and a selection within one container, so a cut reads one container.

The draws of a document come from a hash of seed and doc_id alone, so a repeated task cuts alike. Units are words with the white space before
them (``words``; white space at the end is a unit), lines with their line feed (``lines``) or single characters (``chars``).

A null text counts as empty; an empty text and one that holds a marker stay plain. A null doc_id has an empty decimal form. Rows are taken one by
one: repeated rows and ties get equal results. Columns of the results replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
ARRAY_MOST = 4096  # members of an array container; a bitmap of 65,536 bits takes as many bytes
MARKS = ("<P>", "<S>", "<M>")


class Container:
    """Members of one block of 65,536 places; ``kind`` is array, bitmap or run."""

    def __init__(self, members: np.ndarray):
        begins = np.flatnonzero(np.diff(members, prepend=-2) != 1)
        if 4 * len(begins) < min(2 * len(members), 8192):
            self.kind = "run"
            self.first = members[begins].astype(np.uint16)
            self.before = begins.astype(np.int32)
        elif len(members) <= ARRAY_MOST:
            self.kind, self.members = "array", members.astype(np.uint16)
        else:
            self.kind = "bitmap"
            bits = np.zeros(1 << BITS, dtype=np.uint8)
            bits[members] = 1
            self.words = np.packbits(bits.reshape(-1, 64), axis=1)
            self.before = np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int32)) - bits.reshape(-1, 64).sum(axis=1, dtype=np.int32)

    def select(self, k: int) -> int:
        """The k-th member, from 0."""
        if self.kind == "array":
            return int(self.members[k])
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        if self.kind == "run":
            return int(self.first[at]) + k - int(self.before[at])
        return 64 * at + int(np.flatnonzero(np.unpackbits(self.words[at]))[k - int(self.before[at])])


class BoundarySet:
    """A sorted set of offsets in containers; ``counts`` are cumulative."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> BITS
        edges = np.append(np.flatnonzero(np.diff(high, prepend=-1)), len(offsets))
        self.keys = high[edges[:-1]]
        self.counts = edges
        self.containers = [Container(offsets[a:b] & 0xFFFF) for a, b in zip(edges, edges[1:], strict=False)]

    def __len__(self) -> int:
        return int(self.counts[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.counts, k, side="right")) - 1
        return (int(self.keys[at]) << BITS) + self.containers[at].select(k - int(self.counts[at]))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def word_ends(text: str) -> np.ndarray:
    c = code_points(text)
    white = (c == 32) | ((c >= 9) & (c <= 13))
    return np.flatnonzero(np.append(~white[:-1] & white[1:], True)) + 1


def line_ends(text: str) -> np.ndarray:
    c = code_points(text)
    return np.flatnonzero(np.append(c[:-1] == 10, True)) + 1


UNITS: dict[str, Callable[[str], np.ndarray]] = {"words": word_ends, "lines": line_ends, "chars": lambda t: np.arange(1, len(t) + 1)}


def boundaries(text: str, units: str) -> BoundarySet:
    """0 and the end of every unit."""
    return BoundarySet(np.append(0, UNITS[units](text)) if text else np.zeros(1, dtype=np.int64))


@dataclass(frozen=True)
class Mix:
    """Seed, percentage of documents that are cut, percentage of those that put the suffix first, and the units."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    units: str = "words"


def draws(mix: Mix, doc_id: str = "doc_id") -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    hashed = F.sha2(F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cuts(units: str):
    def find(text: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b in zip(text, one, two, strict=True):
            places = boundaries(t, units)
            n = len(places) - 1
            a, b = sorted((a % (n + 1), b % (n + 1)))
            rows.append((n, places.select(a), places.select(b)))
        return pd.DataFrame(rows, columns=["n", "first", "second"])

    return F.pandas_udf(find, "n long, first long, second long")


def transform(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""
    p, s, m = MARKS
    h1, h2, h3, h4 = draws(mix)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = (text == "") | F.contains(text, F.lit(p)) | F.contains(text, F.lit(s)) | F.contains(text, F.lit(m)) | (h3 % 100 >= mix.rate)
    form = F.when(plain, "plain").when(h4 % 100 < mix.suffix_first, "spm").otherwise("psm")
    rows = docs.withColumns({"__text": text, "__form": form, "__cut": cuts(mix.units)(text, h1, h2)})
    cut = lambda a, b: F.substring("__text", a + 1, b - a)
    first, second, whole = F.col("__cut.first").cast("int"), F.col("__cut.second").cast("int"), F.char_length("__text")
    prefix, middle, suffix = cut(F.lit(0), first), cut(first, second), cut(second, whole)
    output = (F.when(F.col("__form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
              .when(F.col("__form") == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)).otherwise(F.col("__text")))
    moved = F.col("__form") != "plain"
    return rows.withColumns({
        "n": F.col("__cut.n"), "form": F.col("__form"), "prefix_chars": F.when(moved, F.col("__cut.first")),
        "middle_chars": F.when(moved, F.col("__cut.second") - F.col("__cut.first")), "output": output}).drop("__text", "__form", "__cut")


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made of. A marker never is in a cut text, and can't arise where two parts meet, as only its first character is ``<``."""
    part = F.split(output, "|".join(MARKS), -1)  # psm: "", prefix, suffix, middle; spm: "", suffix, prefix, middle
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    rows = transform(docs.select("doc_id", "text"), mix)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))

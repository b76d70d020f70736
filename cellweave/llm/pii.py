"""Personal data in whole texts, also when it is disguised.

Four kinds are found: e-mail, IP and card numbers, phone numbers. The base rules run on the text as it is. Then *transducers*
rewrite disguises - look-alike and width variants of ASCII characters, invisible characters, spelled digits, spelled ``at``
and ``dot`` - each edit keeping the place it came from; the base rules run on the rewritten text, and what they find is
carried back to the source characters. Found that way is only what overlaps no base span of its kind. A text without
disguises is scanned once.

Positions are code points, ends exclusive. A null or empty text has no spans. Every row is treated by itself: repeated
rows, ties and other columns change nothing.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base rules, written so that long runs are read once. An address is completed to the left of its @;
# an IP number is four neighbouring parts of a run of dotted numbers.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile("[0-9]")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like ASCII letters.
LOOK_ALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορι", "aeopcyxijshdqwABEKMHOPCTXIJSABEZHIKMNOPTYXavopi", strict=True))
DASHES, DOTS, INVISIBLE = "‐‑‒–−﹣", "․。｡﹒", "​‌‍⁠﻿­"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _folding() -> dict[str, str]:
    """One character to one ASCII character: look-alikes, and by rule all width, font and digit variants."""
    fold = dict(LOOK_ALIKE) | dict.fromkeys(DASHES, "-") | dict.fromkeys(DOTS, ".") | dict.fromkeys(INVISIBLE, "")
    for code in (*range(0xA0, 0x3000), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA), 0x3000):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if c not in fold and len(plain) == 1 and (" " <= plain <= "~") and unicodedata.category(c) in ("Lu", "Ll", "Nd", "Po", "Pd", "Sm", "Zs", "No", "So"):
            fold[c] = plain
        elif c not in fold and unicodedata.category(c) == "Nd":
            fold[c] = str(unicodedata.digit(c))
    return fold


FOLD = _folding()
_fold_class = "[" + "".join(map(re.escape, sorted(FOLD))) + "]"
_word = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
_dot = "dot|punkt|point|punto"
_at = "at|arroba|arobase"
_left, _right = r"[ \t]?[\[({<][ \t]?", r"[ \t]?[\])}>][ \t]?"
FOLDED = re.compile(_fold_class)
SPELLED = re.compile(rf"(?<![^\W_])(?:{_word})(?:[ -](?:{_word}))+(?![^\W_])", re.I)
SINGLE = re.compile(rf"(?:(?<=[0-9][ .-])|(?<=dot )|(?<=\+)|(?<=plus ))(?:{_word})(?![^\W_])", re.I)
AT = re.compile(  # in brackets, escaped, spaced before a dotted name, or a bare word before a name with a spelled dot
    rf"(?<=[A-Za-z0-9])(?:{_left}(?:{_at}|@){_right}|&#64;|&commat;|%40|[ \t]@[ \t](?=[A-Za-z0-9-]+[ \t]?\.[ \t]?[A-Za-z])"
    rf"|[ \t](?:{_at})[ \t](?!(?:the|an?|this|that)[ \t])(?=[A-Za-z0-9-]+(?:{_left}(?:{_dot}){_right}|[ \t](?:dot|punkt|punto)[ \t])[A-Za-z0-9]))(?=[A-Za-z0-9])", re.I)
DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_left}(?:{_dot}|\.){_right}|&#46;|&period;|[ \t](?:dot|punkt|punto)[ \t])(?=[A-Za-z0-9])", re.I)
PLUS = re.compile(r"(?<![^\W_])plus[ \t](?=\(?[0-9])", re.I)


def _disguises() -> ahocorasick.Automaton:
    """What a lower-cased text holds at least once if an edit other than folding can apply."""
    found = ahocorasick.Automaton()
    for a in DIGIT_WORDS:
        for b in DIGIT_WORDS:
            found.add_word(f"{a} {b}", 0), found.add_word(f"{a}-{b}", 0)
        for b in (*(d + s for d in "0123456789" for s in " .-"), "dot ", "+", "plus "):
            found.add_word(b + a, 0)
    for blank in ("", " ", "\t"):
        for bracket in "[({<":
            for w in (*_dot.split("|"), *_at.split("|"), "@", "."):
                found.add_word(bracket + blank + w, 0)
    for w in ("dot", "punkt", "punto", "@"):
        for a in " \t":
            found.add_word(a + w + " ", 0), found.add_word(a + w + "\t", 0)
    for w in ("&#64;", "&commat;", "%40", "&#46;", "&period;", *(f"plus{b}{c}{d}" for b in " \t" for c in ("", "(") for d in "0123456789")):
        found.add_word(w, 0)
    found.make_automaton()
    return found


DISGUISES = _disguises()
FOLDS = frozenset(FOLD)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ the name is looked for to its left, not before the end of the last address."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1
            done = max(done, at)


def base_spans(text: str) -> list[Span]:
    """The base rules, by kind as listed, then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in four)):
                out.append(("ip", at, end))
            at = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append(("phone", *m.span()))
    return out


class Rewritten:
    """A text under edits, and the way from its characters back to those of the source."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tables: list[tuple[list[int], list[tuple[int, int, int]]]] = []

    def apply(self, pattern: re.Pattern, put) -> None:
        parts, starts, rows, last, at = [], [0], [(0, 0, 0)], 0, 0
        for m in pattern.finditer(self.text):
            new = put(m[0])
            if new == m[0]:
                continue
            parts += [self.text[last:m.start()], new]
            at += m.start() - last
            starts += [at, at + len(new)]  # row: source start, source length if replaced, else 0
            rows += [(m.start(), m.end() - m.start(), 1), (m.end(), 0, 0)]
            at, last = at + len(new), m.end()
        if parts:
            self.text = "".join([*parts, self.text[last:]])
            self.tables.append((starts, rows))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Source span of a rewritten one; an edit belongs to it as a whole."""
        for starts, rows in reversed(self.tables):
            k = bisect.bisect_right(starts, start) - 1
            j = bisect.bisect_right(starts, end - 1) - 1
            source, length, edit = rows[k]
            start = source if edit else source + start - starts[k]
            last, length, edit = rows[j]
            end = last + length if edit else last + end - starts[j]
        return start, end


def rewrite(text: str) -> Rewritten:
    out = Rewritten(text)
    if not text.isascii() and not FOLDS.isdisjoint(text):
        out.apply(FOLDED, lambda s: FOLD[s])
    if next(DISGUISES.iter(out.text.lower()), None) is None:
        return out
    out.apply(SPELLED, lambda s: "".join(DIGIT_WORDS[w] for w in re.split("[ -]", s.lower())))
    out.apply(SINGLE, lambda s: DIGIT_WORDS[s.lower()])
    out.apply(AT, lambda s: "@")
    out.apply(DOT, lambda s: ".")
    out.apply(PLUS, lambda s: "+")
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added ones, both by kind as listed, then by start."""
    base = base_spans(text)
    new = rewrite(text)
    if not new.tables:
        return base, base
    taken = {kind: [(s, e) for k, s, e in base if k == kind] for kind in KINDS}
    added = []
    for kind, a, b in base_spans(new.text):
        start, end = new.source(a, b)
        near = taken[kind]
        k = bisect.bisect_left(near, (end, -1))
        if not (k and near[k - 1][1] > start):
            added.append((kind, start, end))
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found_in(texts: pd.Series) -> pd.DataFrame:
    both = [all_spans(t or "") for t in texts]
    return pd.DataFrame({"base": [written(b) for b, _ in both], "spans": [written(s) for _, s in both]})


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: comma-joined ``kind:start:end`` by kind, then start."""
    found = F.pandas_udf(found_in, "base string, spans string")
    return docs.withColumn("__found", found(F.coalesce(F.col(text), F.lit("")))).select(
        *docs.columns, F.col("__found.base").alias("base"), F.col("__found.spans").alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(F.split(spans, ","), lambda s: s.startswith(kind + ":"))).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """Per document: spans of all kinds counted, the digest of the base spans, and all spans."""
    found = find_personal_data(docs.select("doc_id", "text"))
    return found.select("doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS],
                        F.sha2("base", 256).alias("base_sha256"), "spans",
                        *[count_of(F.col("base"), k).alias(f"n_base_{k}") for k in KINDS])

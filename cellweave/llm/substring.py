"""Removes passages that a document with a smaller doc_id holds too: windows of ``WIDTH`` words, found through recompression.

1. *Phrases.* Tasks parse whole texts into phrases (``recompress.py``). A window is named by the phrase of least hash among those that
   depend on nothing outside it, so equal windows have equal names wherever they stand. Neighbouring windows with one phrase are a
   group, stored with a digest of all its words: a row for about 13 words. A window without a phrase is a group named by its own words.
2. *Shared names.* Names are counted over the corpus; groups whose name occurs in one document only can't repeat and drop out.
3. *Shared groups.* Groups with the same name and words as one in a smaller document go whole.
4. *Borders.* Where one name has groups of different words in different documents, a passage begins or ends. Only there, and
   only for the smallest document of each group, windows are compared one by one, by name and digest of their words.

Counting combines on the map side and sends one row for each name, group or window and task; joins with the counts are plain joins of two
stored tables, which adaptive execution splits where a name is frequent. Names and digests are 64 bits each and compared together.

Only the smallest doc_id matters, so a document is never compared with itself. A null text has no words. A row without doc_id is never a
source and loses nothing. Rows that share a doc_id are judged by their own texts and are no source for each other. White space between
words is not compared. Texts of more than ``PIECE`` bytes are parsed in pieces that overlap by a window. Words: ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import stored
from cellweave.llm.recompress import Words, window_groups

WIDTH = 50
PIECE = 4 << 20
BATCH = 2 << 20
FEW_KEYS = 1_000_000  # documents whose keys, 16 bytes each, are sent to all tasks to fetch their texts

GROUPS = "doc long, th int, at long, n long, name long, wide long"
WINDOWS = "doc long, th int, at long, name long, wide long"
RESULT = "n_words long, n_removed long, kept_sha256 string"


def flattened(text: bytes) -> tuple[bytes, np.ndarray]:
    """The words with one space between, and where each begins; behind them the end plus one."""
    raw = np.frombuffer(text + b" ", dtype=np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = ~white
    keep[1:] |= ~white[:-1]
    flat, gap = raw[keep], white[keep]
    flat[gap] = 32
    return flat.tobytes(), np.append(0, np.flatnonzero(gap) + 1)


def pieces(text: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a text, each with the number of its first word; every window lies in one part."""
    if len(text) <= PIECE:
        yield 0, text
        return
    flat, start = flattened(text)
    each = max(2 * width, PIECE * (len(start) - 1) // len(flat))
    for a in range(0, max(1, len(start) - width), each):
        yield a, flat[start[a]:start[min(a + each + width - 1, len(start) - 1)] - 1]


def parsed(width: int):
    def frame(rows: list[tuple], texts: list[bytes]) -> pd.DataFrame:
        text, at, n, name, wide = window_groups(Words(texts), width)
        doc, th, first = (np.array(x)[text] for x in zip(*rows, strict=True))
        return pd.DataFrame({"doc": doc, "th": th, "at": at + first, "n": n, "name": name, "wide": wide})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, texts, size = [], [], 0
        for pdf in frames:
            for doc, th, text in zip(pdf["doc"], pdf["th"], pdf["text"], strict=True):
                for a, piece in pieces(text.encode(), width):
                    rows.append((doc, th, a))
                    texts.append(piece)
                    size += len(piece)
                    if size >= BATCH:
                        yield frame(rows, texts)
                        rows, texts, size = [], [], 0
        if rows:
            yield frame(rows, texts)

    return run


def single_windows(width: int):
    """The windows of the groups in ``open`` one by one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for doc, th, text, groups in zip(pdf["doc"], pdf["th"], pdf["text"], pdf["open"], strict=True):
                flat, start = flattened(text.encode())
                at = np.concatenate([np.arange(g["at"], g["at"] + g["n"]) for g in groups])
                name = np.concatenate([np.full(g["n"], g["name"]) for g in groups])
                digests = b"".join([blake2b(flat[start[p]:start[p + width] - 1], digest_size=8).digest() for p in at.tolist()])
                yield pd.DataFrame({"doc": doc, "th": th, "at": at, "name": name, "wide": np.frombuffer(digests, dtype="<i8")})

    return run


def keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.hash("text").alias("th"), "text")
    return rows.where("doc is not null and text is not null")


def of_these(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with what ``keys`` has for their document. Up to ``FEW_KEYS`` documents are told to all tasks first, so no other text moves."""
    if keys.count() <= FEW_KEYS:
        rows = rows.join(F.broadcast(keys.select("doc", "th")), ["doc", "th"], "left_semi")
    return rows.join(keys, ["doc", "th"])


def smallest(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("doc").alias("low"), F.max("doc").alias("top"))


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc, th, spans)``: word spans ``(start, stop)`` to remove, sorted by start, for documents that have any; ``th`` is a hash of the text."""
    texts = keyed(docs)
    groups = stored(texts.mapInPandas(parsed(width), GROUPS), "groups")
    names = stored(smallest(groups, "name").where("low < top").select("name"), "names")
    shared = stored(groups.join(names, "name"), "shared")
    contexts = stored(smallest(shared, "name", "wide"), "contexts")
    borders = stored(contexts.groupBy("name").agg((F.min("low") < F.max("low")).alias("border")).where("border"), "borders")
    contexts = stored(contexts.join(borders, "name", "left").where("low < top or border"), "known")
    judged = shared.join(contexts.select("name", "wide", "low", "border"), ["name", "wide"]).where("doc > low or border")
    judged = stored(judged.select("doc", "th", "at", "n", "name", (F.col("doc") > F.col("low")).alias("gone")), "judged")
    group = F.struct("at", "n", "name")
    open_ = judged.where("not gone").distinct().groupBy("doc", "th").agg(F.sort_array(F.collect_list(group)).alias("open"))
    windows = stored(of_these(texts, stored(open_, "open")).mapInPandas(single_windows(width), WINDOWS), "windows")
    again = stored(smallest(windows, "name", "wide").where("low < top").select("name", "wide", "low"), "again")
    alone = windows.join(again, ["name", "wide"]).where("doc > low")
    span = [F.col("at").alias("start"), (F.col("at") + F.col("n") + (width - 1)).alias("stop")]
    spans = judged.where("gone").select("doc", "th", *span).unionByName(alone.withColumn("n", F.lit(1)).select("doc", "th", *span))
    spans = spans.groupBy("doc", "th", "start").agg(F.max("stop").alias("stop"))
    return stored(spans.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")), "spans")


def kept_words(text: str | None, spans) -> tuple[int, int, bytes]:
    """Words, removed words, and the others joined by one space."""
    flat, start = flattened((text or "").encode())
    n = len(start) - 1
    parts, done, gone = [], 0, 0
    for s in spans if spans is not None else ():
        a, b = max(s["start"], done), s["stop"]
        if b > a:
            if a > done:
                parts.append(flat[start[done]:start[a] - 1])
            done, gone = b, gone + b - a
    if done < n:
        parts.append(flat[start[done]:start[n] - 1])
    return n, gone, b" ".join(parts)


def with_spans(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` with ``__spans``, null where nothing goes."""
    spans = repeated_spans(docs, width).select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    rows = docs.withColumn("__key", F.hash("text"))
    return rows.join(spans, (rows["doc_id"] == spans["__doc"]) & (rows["__key"] == spans["__th"]), "left").drop("__doc", "__key", "__th")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; what stays of such a text is joined by single spaces. Other rows are as they were."""
    cut = F.pandas_udf(lambda text, spans: pd.Series([kept_words(t, s)[2].decode() for t, s in zip(text, spans, strict=True)]), "string")
    rows = with_spans(docs, width)
    new: Column = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut("text", "__spans"))
    return rows.withColumn("text", new).select(*docs.columns)


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: words, removed words and the digest of the kept words joined by one space."""

    def judge(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [kept_words(t, s) for t, s in zip(text, spans, strict=True)]
        return pd.DataFrame([(n, gone, sha256(kept).hexdigest()) for n, gone, kept in rows], columns=["n_words", "n_removed", "kept_sha256"])

    rows = with_spans(docs.select("doc_id", "text"), width)
    return rows.select("doc_id", F.pandas_udf(judge, RESULT)("text", "__spans").alias("__r")).select("doc_id", "__r.*")

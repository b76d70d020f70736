"""Vector best-fit packing of tokenised documents into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths). Pieces go in
order of falling length, each to the open sequence that the rule prefers among those with room in every respect:
``norm`` takes the smallest weighted norm of what stays free, ``dot`` the largest weighted dot product of need and room over
the squared room. Sequences in the same state are one *class* with a multiplicity, pieces of one length one count. So the plan
is made from the histogram of lengths, at most ``tokens`` rows, exactly as if piece by piece; its size doesn't grow
with the data. With the defaults, which ``op4_pack`` and the pipeline use since as few sequences as possible are asked for, only
tokens bind: pieces that sum to 2048 are at most 2048 documents and cost at most 2048 * 2048; these two act through the score alone. Spark counts lengths, numbers the pieces of each length and joins them with the plan.

Nulls: a null text is an empty one, which is a single end token. A null doc_id is packed like any other. Repeated rows are
packed once each; which of two equal rows gets which place is not defined. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import stored

END = 0
RANKED = 5000  # pieces of one length that one window group numbers
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Texts of these characters alone go to the faster library; its splitting rule and vocabulary are the same.
PLAIN = re.compile("[^\t\n\r -~\u00a1-\u024f\u2010-\u2027]")


class Encoder:
    """Token ids as the tokenizers library gives them; ``ranks`` names the same vocabulary for a faster one."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not PLAIN.search(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, tokens: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with its end token: ``tokens`` ids each, the first what is over."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(tokenizer, ranks, pattern)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                at, end = 0, (len(ids) - 1) % tokens + 1
                for piece in range(-(-len(ids) // tokens)):
                    part = ids[at:end]
                    rows.append((doc_id, piece, at, end - at, zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
                    at, end = end, end + tokens
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES + (", ids array<long>" if with_ids else ""))


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"


def plan(histogram: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, first rank, pieces, first sequence, pieces a sequence, first offset)``.

    Filling a class with several equal pieces a sequence is what piece-by-piece best fit does: a sequence just used has
    less room than its class, so the next equal piece goes there again.
    """
    if cap.rule not in ("norm", "dot"):
        raise ValueError("rule must be 'norm' or 'dot'")
    scale = np.array([cap.tokens, cap.documents, cap.cost], dtype=float)
    weights = np.array(cap.weights)
    room = np.zeros((0, 3), dtype=np.int64)  # of each class
    first, many = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    full = np.array([cap.tokens, cap.documents, cap.cost], dtype=np.int64)
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of an empty sequence")
        rank, left = 0, histogram[length]
        while left:
            fits = np.flatnonzero((room >= need).all(axis=1) & (many > 0))
            if len(fits):
                r, v = room[fits] / scale, need / scale
                score = (weights * (r - v) ** 2).sum(axis=1) if cap.rule == "norm" else -(weights * r * v).sum(axis=1) / (weights * r * r).sum(axis=1)
                k = int(fits[score.argmin()])
                state, at, there = room[k].copy(), int(first[k]), int(many[k])
            else:
                k, state, at = -1, full, opened
            each = int((state // need).min())
            bins = left // each if k < 0 else min(there, left // each)
            over = left - bins * each if (k < 0 or there > bins) and left - bins * each < each else 0
            new = []
            if bins:
                rows.append((length, rank, bins * each, at, each, int(cap.tokens - state[0])))
                new.append((state - each * need, at, bins))
            if over:
                rows.append((length, rank + bins * each, over, at + bins, over, int(cap.tokens - state[0])))
                new.append((state - over * need, at + bins, 1))
            used = bins + (over > 0)
            if k < 0:
                opened += used
            else:
                first[k] += used
                many[k] -= used
            for s, f, m in new:
                if s.min() > 0:
                    room, first, many = np.vstack([room, s]), np.append(first, f), np.append(many, m)
            rank += bins * each + over
            left -= bins * each + over
        alive = many > 0
        room, first, many = room[alive], first[alive], many[alive]
    return rows


def pack(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (stored, with ``doc_id, piece, length``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, salts long")
    # Pieces of one length are numbered in groups of about RANKED; a table of group sizes supplies the offsets.
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "salt")
    rows = spark.createDataFrame(plan(histogram, cap), "length long, rank0 long, n long, bin0 long, each long, offset0 long")
    rows = rows.withColumnRenamed("length", "of_length")
    hit = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("n"))
    at = F.col("rank") - F.col("rank0")
    return ranked.join(F.broadcast(rows), hit).select(
        *pieces.columns, (F.col("bin0") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + (at % F.col("each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, cap: Capacity = Capacity()) -> DataFrame:
    return pack(stored(token_pieces(docs, tokenizer, ranks, pattern, cap.tokens), "pieces"), cap)

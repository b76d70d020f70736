"""Token counts through a digest cache.

A text is known by the SHA-256 of its normalised content and the digest of the tokenizer: model file, library version and
options. Texts whose pair of digests is in the cache are not encoded; of the others each distinct text is encoded once
and its count appended to the cache. Normalising is limited to what cannot change a count: null becomes empty.

The cache is a Parquet folder that only grows. Two runs that append the same pair write equal counts; reading takes
one of them. Repeated documents get equal counts, ties don't arise, other columns are ignored, a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import stored

CACHE = "content binary, n_tokens long, tokenizer string"
LIMIT = 4096
BATCH_CHARS = 1 << 21


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def tokenizer_digest(path: str) -> str:
    """Of the file, the library's name and version, and the options used."""
    data = Path(path).read_bytes()
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(data + f"{library.__name__} {library.__version__} plain".encode()).hexdigest()[:32]


def counter(path: str):
    """Function from a list of texts to their numbers of tokens, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation(), whole.no_padding()
    return lambda texts: [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """``(content, n_tokens)`` of rows ``(content, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for b in batches:
            n, part, size = [], [], 0
            for t in b["text"]:
                part.append(t)
                size += len(t)
                if size >= BATCH_CHARS:
                    n += count(part)
                    part, size = [], 0
            n += count(part) if part else []
            yield pd.DataFrame({"content": b["content"], "n_tokens": n})

    return texts.mapInPandas(run, "content binary, n_tokens long")


def cached(spark, cache: str, tokenizer: str) -> DataFrame:
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """Per document row ``doc_id, n_bytes, n_tokens, over_limit``; distinct texts new to ``cache`` are added to it."""
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(path)
    text = F.coalesce("text", F.lit(""))
    # Copies are merged before their texts are moved and the counts are stored before rows meet them, so a text that
    # many rows hold is one row in every shuffle but the last, whose join can be split.
    distinct = docs.groupBy(content_digest(F.col("text")).alias("content")).agg(F.first(text).alias("text"))
    misses = distinct.join(cached(spark, cache, tokenizer), "content", "left_anti")
    encode_counts(misses, path).withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").parquet(cache)
    keys = stored(docs.select(
        "doc_id", content_digest(F.col("text")).alias("content"), F.octet_length(text).cast("long").alias("n_bytes")), "token-keys")
    counts = stored(cached(spark, cache, tokenizer).join(keys.select("content").distinct(), "content", "left_semi"), "token-counts")
    return keys.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

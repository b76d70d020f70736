"""From raw documents to packed training sequences: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes the documents its predecessor kept and its decision takes effect: documents whose language is rejected
go, later copies of repeated runs of lines are cut out, one document of each group of near-duplicates stays, documents
with a benchmark passage go, the rest is packed. Columns that ``documents`` has besides ``doc_id`` and ``text`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, langid, linededup, neardup, packing
from cellweave.llm.common import stored, table
from cellweave.llm.queries import byte_bpe


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, trained on the labelled ones, does not reject."""
    return langid.accepted(docs, langid.fit(langid.training_rows(docs)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; ``n_chars`` follows the text."""
    cut = linededup.delete_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, five-word shingles at similarity 0.8."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, *byte_bpe())


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates),
          ("decontamination", contamination), ("packing", sequences)]

#: Language ID, suffix arrays and packing have no statement in SQL; the tests hold run() against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

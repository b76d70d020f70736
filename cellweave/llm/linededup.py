"""Deletes later copies of repeated runs of lines, found by a distributed suffix array.

Lines that occur once in the corpus can't be part of a repeat and drop out. The others get dense names in sorted order, and
*prefix doubling* gives every position the name of its next 1, 2, 4, ... lines: pairs of names are counted, the repeated ones
sorted and numbered. A name of level k is the rank of a suffix by its first 2^k lines, so positions that share it are an
interval of the suffix array whose longest common prefix is at least 2^k. Runs end at the end of their document.

Then the levels are walked downwards. A group of positions that share a prefix of some length is split by the names that
follow; positions that are not first in their part share a longer prefix with an earlier one and move on with it, the first of
each part stands for it where it stays. At the end every position knows the length of the longest run that starts there and
occurs earlier: the deepest interval whose first position is another one. A run of at least ``MIN_WORDS`` words is deleted; so all
copies but the first, by (doc_id, text digest, line), lose maximal repeated runs. Counting is done per group and sent back by joins,
never by gathering a group.

A null text has no lines and stays null; an empty one is one empty line. Rows with equal doc_id and text count as one document and
get the same result; a null doc_id sorts first. Blank lines are lines of no words. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import partitions, stored

MIN_WORDS = 10
LINE_BITS = 27  # a position is its document's number, then its line
WORD = r"[^\x20\x09-\x0D]+"


def digest(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def numbered(df: DataFrame, *by: str, name: str = "number") -> DataFrame:
    """``df`` with dense numbers in the order of ``by``; stored."""
    spark = df.sparkSession
    low = (1 << 33) - 1
    rows = df.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("__part", F.shiftright("__id", 33)).withColumn("__id", F.col("__id").bitwiseAND(low)), "numbered")
    total, starts = 0, []
    for r in sorted(rows.groupBy("__part").count().collect(), key=lambda r: r["__part"]):  # a row for each partition
        starts.append((r["__part"], total))
        total += r["count"]
    table = spark.createDataFrame(starts, "__part long, __start long")
    return rows.join(F.broadcast(table), "__part").withColumn(name, F.col("__id") + F.col("__start")).drop("__id", "__part", "__start")


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, th, doc)`` of documents with repeated lines, and their ``(pos, name, words)``."""
    text = docs.select(F.col("doc_id"), digest(F.col("text")).alias("th"), "text").where("text is not null")
    lines = text.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line", "s")).select(
        "doc_id", "th", "line", digest(F.col("s")).alias("h"), F.regexp_count("s", F.lit(WORD)).alias("words"))
    lines = stored(lines.dropDuplicates(["doc_id", "th", "line"]), "lines")
    names = numbered(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "h", name="name")
    kept = stored(lines.join(names, "h").drop("h"), "repeated-lines")
    owners = stored(numbered(kept.select("doc_id", "th").distinct(), "doc_id", "th", name="doc"), "owners")
    same = kept["doc_id"].eqNullSafe(owners["doc_id"]) & (kept["th"] == owners["th"])
    pos = F.shiftleft("doc", LINE_BITS) + F.col("line")
    return owners, stored(kept.join(owners, same).select(pos.alias("pos"), "name", "words"), "positions")


def levels_of(first: DataFrame) -> list[DataFrame]:
    """``(pos, name)`` for runs of 1, 2, 4, ... lines that are repeated."""
    levels = [first.select("pos", "name")]
    while True:
        last, step = levels[-1], 1 << (len(levels) - 1)
        pairs = last.withColumnRenamed("name", "x").join(last.select((F.col("pos") - step).alias("pos"), F.col("name").alias("y")), "pos")
        pairs = stored(pairs, "pairs")
        names = numbered(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y"), "x", "y", name="name")
        level = stored(pairs.join(names, ["x", "y"]).select("pos", "name"), "level")
        if level.isEmpty():
            return levels
        levels.append(level)


def longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """``(pos, len)``: lines of the longest run at ``pos`` that also starts at an earlier position."""
    rows = levels[0].select("pos", F.lit(0).cast("long").alias("gid"), F.lit(0).cast("long").alias("len"), F.lit(False).alias("anchor"))
    for k in reversed(range(len(levels))):
        next_name = levels[k].select(F.col("pos").alias("at"), F.col("name").alias("next"))
        split = stored(rows.join(next_name, F.col("pos") + F.col("len") == F.col("at"), "left").drop("at"), "split")
        parts = split.where("next is not null").groupBy("gid", "next").agg(
            F.min("pos").alias("low"), F.count(F.lit(1)).alias("n"), F.first("len").alias("plen")).where("n > 1")
        new_gid = F.monotonically_increasing_id() * 64 + (k + 1)
        parts = stored(parts.select("gid", "next", "low", "plen", new_gid.alias("new")), "parts")
        moved = split.join(parts.select("gid", "next", "low", "new"), ["gid", "next"], "left")
        later = F.col("low").isNotNull() & (F.col("pos") > F.col("low"))
        moved = moved.select("pos", F.when(later, F.col("new")).otherwise(F.col("gid")).alias("gid"),
                             (F.col("len") + F.when(later, 1 << k).otherwise(0)).alias("len"), "anchor")
        anchors = parts.select(F.col("low").alias("pos"), F.col("new").alias("gid"), (F.col("plen") + (1 << k)).alias("len"), F.lit(True).alias("anchor"))
        rows = moved.unionByName(anchors)
    return rows.where("not anchor and len > 0").select("pos", "len")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, th, spans)``: sorted line spans ``(start, stop)`` to delete, with lines between them, for documents that have any."""
    owners, positions = repeated_lines(docs)
    runs = stored(longest_earlier(levels_of(positions)), "runs")
    doc = F.shiftright("pos", LINE_BITS)
    in_doc = Window.partitionBy("doc").orderBy("pos")
    sums = stored(positions.withColumn("doc", doc).select("pos", "words", F.sum("words").over(in_doc).alias("upto")), "sums")
    ends = sums.select(F.col("pos").alias("last"), F.col("upto").alias("total"))
    sized = runs.join(sums, "pos").join(ends, F.col("pos") + F.col("len") - 1 == F.col("last"))
    good = sized.where(F.col("total") - F.col("upto") + F.col("words") >= min_words).select(
        doc.alias("doc"), "pos", (F.col("pos") + F.col("len")).alias("end"))
    before = F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("before").isNull() | (F.col("pos") > F.col("before"))).cast("int")
    good = good.withColumn("before", before).withColumn("part", F.sum(fresh).over(in_doc))
    merged = good.groupBy("doc", "part").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    line = lambda c: F.col(c).bitwiseAND((1 << LINE_BITS) - 1)
    spans = merged.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(line("pos").alias("start"), line("end").alias("stop")))).alias("spans"))
    return owners.join(spans, "doc").drop("doc")


def with_deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``__lines`` and, where lines go, ``__spans``."""
    found = later_copies(docs, min_words).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    rows = docs.withColumn("__key", digest(F.col("text")))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["__id"]) & (rows["__key"] == found["__th"]), "left").withColumn(
        "__lines", F.when(F.col("text").isNotNull(), F.split("text", "\n")))


def kept_lines():
    """The lines between the spans, in slices."""
    begin = F.concat(F.array(F.lit(0).cast("long")), F.col("__spans.stop"))
    end = F.concat(F.col("__spans.start"), F.array(F.size("__lines").cast("long")))
    gaps = F.zip_with(begin, end, lambda a, b: F.slice("__lines", (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.col("__spans").isNull(), F.col("__lines")).otherwise(F.flatten(gaps))


def delete_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies cut out of ``text``; a document of which no line with a word is left goes."""
    rows = with_deletions(docs, min_words).withColumn("__kept", F.array_join(kept_lines(), "\n"))
    left = F.col("__spans").isNull() | F.col("__kept").rlike(r"[^\x20\x09-\x0D]")
    return rows.where(left).withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.col("__kept"))).select(*docs.columns)


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: lines, deleted lines, their spans as ``start:stop`` (sorted), digest of the text that stays."""
    rows = with_deletions(docs.select("doc_id", "text"), min_words).withColumn("__kept", kept_lines())
    shown = F.array_join(F.transform("__spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    n = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(count("__lines"))
    left = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(count("__kept"))
    return rows.select("doc_id", n.alias("n_lines"), (n - left).alias("n_deleted"), F.coalesce(shown, F.lit("")).alias("spans"),
                       F.sha2(F.coalesce(F.array_join("__kept", "\n"), F.lit("")), 256).alias("kept_sha256"))

"""Benchmark decontamination: a hash set of benchmark n-grams is probed with the token windows of every document.

All steps are DataFrame functions. Each n-gram is filed under one *anchor*, its rarest word within the benchmark. A
document is scanned word by word, once; where a word is an anchor, the windows that would put the anchor at that place are
compared with the stored n-gram, by their outer words and then as text. So every window of a document is covered, yet only
those with an anchor are built. The n-gram table is broadcast after its rows have been counted; above ``BROADCAST_GRAMS``
windows are named by a digest and joined by name; the result is the same.

Nulls: a null text has no words, so neither hits nor windows. An item without id is found but cannot be named, so it
counts in ``n_hit`` and not in ``n_items``. Rows of one doc_id and text get equal results; an item_id that repeats counts
once. Other columns are ignored by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import ascii_lower, stored

#: ASCII but digits and letters, one by one: Java's regex looks such a class up in a table of bits and tests ranges in turn.
SEPARATORS = "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: Words before lower-casing: runs of digits, ASCII letters and all that is not ASCII.
WORD = f"[^{SEPARATORS}]+"
#: A word with the separators before it, for cutting spans out of a text.
PIECE = f"[{SEPARATORS}]*[^{SEPARATORS}]+"
WINDOW = 10
BROADCAST_GRAMS = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(gram_id, gram, len, anchor, shift, head, last)`` and ``(gram_id, item_id)``.

    A gram is ``window`` consecutive lower-cased words joined by blanks, or all words of a shorter item; ``anchor`` is its
    rarest word (then the longest), ``shift`` words from its start; ``head`` and ``last`` are its outer words.
    """
    items = benchmark.select("item_id", F.transform(words(F.col("text")), ascii_lower).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    grams = items.select("item_id", "w", F.explode(starts).alias("at")).select(
        "item_id", F.slice("w", F.col("at") + 1, F.lit(window)).alias("g"))
    grams = grams.withColumn("gram", F.array_join("g", " ")).withColumn("gram_id", F.xxhash64("gram", F.md5("gram")))
    of_items = grams.select("gram_id", "item_id").distinct()
    once = grams.groupBy("gram_id").agg(F.first("gram").alias("gram"), F.first("g").alias("g"))
    ends = once.select("gram_id", "gram", F.size("g").alias("len"), F.lower(F.get("g", F.lit(0))).alias("head"), F.lower(F.element_at("g", -1)).alias("last"), "g")
    placed = ends.select("gram_id", "gram", "len", "head", "last", F.posexplode("g").alias("shift", "word"))
    often = placed.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    best = placed.join(often, "word").groupBy("gram_id").agg(
        *[F.first(c).alias(c) for c in ("gram", "len", "head", "last")],
        F.min(F.struct("often", (-F.length("word")).alias("short"), "shift", "word")).alias("a"))
    return best.select("gram_id", "gram", "len", F.lower("a.word").alias("anchor"), F.col("a.shift").alias("shift"), "head", "last"), of_items


def scanned(docs: DataFrame, grams: DataFrame, few: int) -> DataFrame:
    """``docs`` without text, with ``n_words, start, stop, gram_id``: a row for every window that is a benchmark gram.

    Every row of ``docs`` keeps at least one row, without gram if need be, so that words are taken from its text only once.

    Up to ``few`` grams go to all tasks and are compared as text. Beyond, only the places of an anchor in its grams go there, or none
    if the anchors are more than ``few`` too: then a task names all windows of the lengths there are. Windows are named by 128 bits of
    a digest and joined by name, so no words are shuffled, one name for each occurrence of an anchor at most as often as it has places.
    """
    own = [c for c in docs.columns if c != "text"]
    probe = docs.select(*own, words(F.col("text")).alias("w"))
    # The outer form: from the other Spark infers that there are words, a filter before which it takes them once more.
    each = probe.select(*own, "w", F.posexplode_outer("w").alias("pos", "word"))
    n_words, start, stop = F.size("w"), F.col("pos") - F.col("shift"), F.col("pos") - F.col("shift") + F.col("len")
    inside = (start >= 0) & (stop <= n_words)
    window = ascii_lower(F.array_join(F.slice("w", start + 1, F.col("len")), " "))
    first = F.coalesce("pos", F.lit(0)) == 0
    # Full lower-casing is coarser than A-Z alone, so probing with it loses nothing; the last comparison is exact.
    anchored = F.lower("word") == F.col("anchor")
    if grams.count() <= few:
        outer = (F.lower(F.get("w", start)) == F.col("head")) & (F.lower(F.get("w", stop - 1)) == F.col("last"))
        met = each.join(F.broadcast(grams), anchored & inside & outer & (window == F.col("gram")), "left")
        return met.where(F.col("gram_id").isNotNull() | first).select(
            *own, n_words.cast("long").alias("n_words"), start.alias("start"), stop.alias("stop"), "gram_id")
    places = stored(grams.groupBy("anchor").agg(F.collect_set(F.struct("shift", "len")).alias("places")), "places")
    if places.count() <= few:
        met = each.join(F.broadcast(places), anchored, "left").select(*own, "w", "pos", F.inline_outer("places"))
    else:
        sizes = [r.len for r in grams.select("len").distinct().collect()]  # 1 to the window's length
        met = each.select(*own, "w", "pos", F.lit(0).alias("shift"), F.explode(F.array(*[F.lit(n) for n in sizes])).alias("len"))
    # Rows without a window go by their key, else all of them would meet in one task.
    named = met.where(inside | first).select(
        *own, n_words.cast("long").alias("n_words"), F.when(inside, start).alias("start"), F.when(inside, stop).alias("stop"),
        F.unhex(F.md5(F.when(inside, window).otherwise(F.col("key").cast("string")))).alias("name"))
    joined = named.join(grams.select(F.col("gram_id").alias("of"), F.unhex(F.md5("gram")).alias("name")), "name", "left")
    found = joined.withColumn("gram_id", F.when(F.col("start").isNotNull(), F.col("of")))
    return found.where(F.col("gram_id").isNotNull() | (F.coalesce("start", F.lit(0)) == 0)).select(*own, "n_words", "start", "stop", "gram_id")


def merged_spans(hits: DataFrame) -> DataFrame:
    """``(key, spans, n_hit)``: sorted spans with words between them, and the words they hold."""
    in_document = Window.partitionBy("key").orderBy("start", "stop")
    before = F.max("stop").over(in_document.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("before").isNull() | (F.col("start") > F.col("before"))).cast("int")
    once = hits.select("key", "start", "stop").distinct().withColumn("before", before).withColumn("part", F.sum(fresh).over(in_document))
    merged = once.groupBy("key", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"),
                                     F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"))


def hits_by_document(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(key, spans, n_hit, items)`` of the documents that hold a benchmark window, and what was scanned.

    ``docs`` has ``key`` and ``text``; rows of one key count as one document.
    """
    grams, of_items = benchmark_grams(benchmark, window)
    grams, of_items = stored(grams, "grams"), stored(of_items, "gram-items")
    scan = stored(scanned(docs, grams, BROADCAST_GRAMS), "window-hits")
    hits = scan.where(F.col("gram_id").isNotNull())
    small = of_items.count() <= BROADCAST_GRAMS
    named = hits.select("key", "gram_id").distinct().join(F.broadcast(of_items) if small else of_items, "gram_id")
    items = named.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return merged_spans(hits).join(items, "key", "left"), scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")  # stored with the scan before it is joined
    found, scan = hits_by_document(rows, benchmark, window)
    return scan.select("key", "doc_id", "n_words").distinct().join(found.drop("spans"), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, or (``remove="spans"``) without the hit words.

    A cut span takes the separators before each of its words along; the other words, their order and what
    follows the last word stay.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    columns = docs.columns
    mark = "__key"
    found, _ = hits_by_document(docs.select(document_key().alias("key"), "text"), benchmark, window)
    found = found.select(F.col("key").alias(mark), F.col("spans").alias("__spans"))
    keyed = docs.withColumn(mark, document_key())
    if remove == "documents":
        return keyed.join(found, mark, "left_anti").select(*columns)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(PIECE), F.lit(0))
    begin, end = F.concat(F.array(F.lit(0)), F.col("__spans.stop")), F.concat(F.col("__spans.start"), F.array(F.size("__pieces")))
    kept = F.flatten(F.zip_with(begin, end, lambda a, b: F.slice("__pieces", a + 1, b - a)))
    tail = F.regexp_extract(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    clean = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return keyed.join(found, mark, "left").withColumn("__pieces", F.when(F.col("__spans").isNotNull(), pieces)).withColumn("text", clean).select(*columns)

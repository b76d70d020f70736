"""Near-duplicate texts: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation.

A document's set is its distinct word shingles as 64-bit hashes. Documents with equal sets are one *class* from the start; its
smallest doc_id stands for it, so copies never meet in a bucket. One hash per shingle fills ``BANDS * ROWS`` bins; an empty
bin takes over a full one chosen by its own sequence of hashes (optimal densification). Bands of bins are bucket keys.

In a bucket the smallest document is the centre of a star. First each document is compared with the centre that shares
most of its bands, on the full sets; confirmed links form components. Pairs of a bucket that are then in one component
need no test: they can't change it. The others are compared by their signatures in blocks of ``BLOCK`` by ``BLOCK``, within a
task, each in the first bucket it shares; those that agree in no fewer bins than six standard deviations below the threshold
are compared by 16-bit short forms of their sets, which can only overstate what is common, and those that pass on the full sets. So a bucket of n documents costs n - 1 pairs where its documents are alike, and no pair that
shares a band is left out. At similarity 0.8 two documents share no band with a probability below 1e-5.

Words are runs without ASCII white space, A-Z lower-cased. Documents without words (or null) have an empty set and no
links. Rows that repeat a doc_id take part with each of their texts; the result holds one row per input row. A null doc_id
takes part in no link. Other columns stay as they are in ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import LOWER, UPPER, partitions, stored
from cellweave.operators.components import connected_components

BANDS, ROWS = 40, 6
BLOCK = 512
_lower = bytes.maketrans(UPPER.encode(), LOWER.encode())
_golden = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "doc_id long, n_shingles long, content binary, bands array<long>, bytes binary, digest binary"


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles; fewer words are one shingle, none are none."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_lower).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    n = len(h) - words + 1
    out = h[:n].copy()
    for k in range(1, words):
        out = mixed(out + _golden) ^ h[k:n + k]
    return np.unique(mixed(out))


def signature(items: np.ndarray, bins: int) -> np.ndarray:
    """Smallest hash of each bin; empty bins copy a full one, the one their own hash sequence meets first."""
    low = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    place = ((items >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    np.minimum.at(low, place.astype(np.int64), mixed(items))
    full = np.zeros(bins, dtype=bool)
    full[np.unique(place).astype(np.int64)] = True
    want = np.flatnonzero(~full)
    out, tries = low.copy(), np.uint64(1)
    while len(want):
        probe = (mixed(want.astype(np.uint64) * _golden + tries * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bins)).astype(np.int64)
        hit = full[probe]
        out[want[hit]] = low[probe[hit]]
        want = want[~hit]
        tries += np.uint64(1)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * _golden
    for k in range(rows):
        key = mixed(key ^ sig[k::rows][:bands])
    return key.view(np.int64)


def text_digest():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def sketches(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, content, bands, bytes, digest)``; ``content`` names the set, ``bytes`` has a byte of each bin, ``digest`` names the text.

    ``bands`` and ``bytes`` of an empty set are empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, digest in zip(b["doc_id"], b["text"], b["digest"], strict=True):
                s = shingles(text, words)
                sig = signature(s, bands * rows) if len(s) else s
                keys = band_keys(sig, bands, rows) if len(s) else []
                out.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys, sig.astype(np.uint8).tobytes(), digest))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "content", "bands", "bytes", "digest"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest().alias("digest")).mapInPandas(run, SKETCH)


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``(doc_id, content, items)`` with the set as packed 64-bit hashes, for the classes in ``ids``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t, words) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found],
                                "items": [s.tobytes() for s in found]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    return rows.mapInPandas(run, "doc_id long, content binary, items binary").join(ids, ["doc_id", "content"], "left_semi").dropDuplicates(["doc_id", "content"])


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``(a, b)`` of class numbers whose full sets are alike: 100 * common >= percent * united."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), dtype=bool)
        for k, (p, q) in enumerate(zip(x, y, strict=True)):
            s, t = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                continue
            common = len(np.intersect1d(s, t, assume_unique=True))
            out[k] = 100 * common >= percent * (len(s) + len(t) - common)
        return pd.Series(out)

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return edges.select("a", "b").join(right, "b").join(left, "a").where(alike("x", "y")).select("a", "b")


def links(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_shingles, content, digest)`` per row, and ``(content, component_id)`` per non-empty class."""
    sketch = stored(sketches(docs, words, bands, rows), "sketches")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    # A class is known by its smallest doc_id; where one doc_id has several texts, the set's name tells them apart.
    classes = full.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    classes = stored(classes.withColumn("node", F.xxhash64("doc_id", "content")), "classes")
    spread = classes.select("node", "doc_id", F.explode("bands").alias("bucket"))
    busy = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).where("n > 1")
    # Only classes that share a bucket go on.
    members = stored(spread.join(busy.drop("n"), "bucket"), "members")
    centres = members.where("doc_id = low").groupBy("bucket").agg(F.min("node").alias("a"))
    star = members.join(centres, "bucket").where("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
    star = stored(star, "star")
    best = Window.partitionBy("b").orderBy(F.desc("votes"), "a")
    edges = star.withColumn("k", F.row_number().over(best)).where("k = 1").select("a", "b")
    some = members.select("node").distinct().join(classes.select("node", "doc_id", "content"), "node")
    sets = sets_of(docs, some.select("doc_id", "content"), words).join(some, ["doc_id", "content"]).select("node", "items")
    sets = stored(sets, "sets")
    good = stored(confirmed(edges, sets, percent), "links")
    roots = stored(connected_components(good, "a", "b"), "roots")
    placed = members.select("bucket", "node").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_component = across(placed, classes.select("node", "n", "bytes", "bands"), sets, percent)
    # Node numbers are hashes; the component takes the smallest doc_id of its classes.
    named = classes.select("node", "doc_id", "content").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(of_component, "component", "left").withColumn("component", F.coalesce("root", "component"))
    low = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return sketch.drop("bands", "bytes"), named.join(low, "component").select("content", "component_id")


def across(placed: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(component, root)`` of components joined by links between them.

    Members of a bucket with several components are numbered and cut into blocks; every pair of blocks is one group of at most
    twice ``BLOCK`` rows.
    """
    busy = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")
    order = Window.partitionBy("bucket").orderBy("node")
    rest = placed.join(busy, "bucket").withColumn("k", F.row_number().over(order) - 1)
    rest = stored(rest.withColumn("blocks", F.floor(F.max("k").over(Window.partitionBy("bucket")) / BLOCK)), "rest")
    own = F.floor(F.col("k") / BLOCK)
    dealt = rest.withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))))
    short = F.pandas_udf(short_forms, "binary")
    dealt = dealt.join(sizes.join(sets.select("node", short("items").alias("short")), "node"), "node").withColumn("i", F.least("own", "x")).withColumn("j", F.greatest("own", "x"))
    keys = ["bucket", "i", "j"]
    dealt = dealt.repartition(partitions(placed.sparkSession), *keys).sortWithinPartitions(*keys, "k").select(
        *keys, "own", "node", "component", "n", "bytes", "bands", "short")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            new = (b[keys].to_numpy()[1:] != b[keys].to_numpy()[:-1]).any(axis=1)
            cuts = [0, *(np.flatnonzero(new) + 1)]
            yield from (plausible(b.iloc[p:q], percent) for p, q in zip(cuts, cuts[1:], strict=False))
            held = b.iloc[cuts[-1]:]  # its group may go on in the next batch
        if held is not None:
            yield plausible(held, percent)

    pairs = stored(dealt.mapInPandas(run, "a long, b long, ca long, cb long"), "across")
    linked = stored(confirmed(pairs, sets, percent).join(pairs, ["a", "b"]).select("ca", "cb").distinct(), "across-links")
    return connected_components(linked, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("root"))


def short_forms(items: pd.Series) -> pd.Series:
    """Sorted distinct low 16 bits of a set's hashes."""
    return pd.Series([np.unique(np.frombuffer(x, dtype=np.uint64).astype(np.uint16)).tobytes() for x in items])


def may_link(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int) -> bool:
    """False only if the sets can't be alike: what is common is at most what the short forms share and have lost."""
    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y]))) + min(nx - len(x), ny - len(y))
    return bool(100 * common >= percent * (nx + ny - common))


def plausible(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of a group in different components whose sizes and signatures allow a link, if this is their first common bucket.

    The first one is told by the full band keys: bytes of a band may agree by chance where its key, and so its bucket, differs.
    """
    own, component, n, node = (group[c].to_numpy() for c in ("own", "component", "n", "node"))
    sig = np.frombuffer(b"".join(group["bytes"]), dtype=np.uint8).reshape(len(group), -1)
    keys = np.stack(group["bands"].to_list())
    cross = group["i"].iloc[0] != group["j"].iloc[0]
    left, right = (np.flatnonzero(own == group[c].iloc[0]) for c in "ij")
    low = percent / 100
    fits = (component[left, None] != component[None, right]) & (np.minimum(n[left, None], n[None, right]) >= low * np.maximum(n[left, None], n[None, right]) - 1e-9)
    p, q = np.nonzero(fits)
    p, q = left[p], right[q]
    if not cross:
        p, q = p[p < q], q[p < q]
    short = [np.frombuffer(x, dtype=np.uint16) for x in group["short"]]
    found = []
    for at in range(0, len(p), 1 << 15):
        a, b = p[at:at + (1 << 15)], q[at:at + (1 << 15)]
        same = (sig[a] == sig[b]).mean(axis=1)
        doubt = 6 * np.sqrt(low * (1 - low) / np.minimum(sig.shape[1], np.maximum(n[a], n[b])))
        good = same >= low - doubt
        a, b = a[good], b[good]
        first = (keys[a] == keys[b]).argmax(axis=1)
        mine = keys[a, first] == group["bucket"].iloc[0]
        a, b = a[mine], b[mine]
        near = [k for k in range(len(a)) if may_link(short[a[k]], short[b[k]], n[a[k]], n[b[k]], percent)]
        found.append((a[near], b[near]))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=int) for k in (0, 1))
    return pd.DataFrame({"a": node[a], "b": node[b], "ca": component[a], "cb": component[b]})


def judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``report`` with the ``digest`` of a row's text."""
    sketch, of_class = links(docs, words, percent)
    return sketch.join(of_class, "content", "left").select(
        "doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "digest"
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def report(docs: DataFrame, words: int, percent: int = 80) -> DataFrame:
    """Per row: set size, the smallest doc_id reachable by links, and whether that is its own."""
    return judged(docs, words, percent).drop("digest")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each component; documents without words or id stay.

    Where a doc_id has several texts, only the rows whose own text is not kept go.
    """
    columns = docs.columns
    gone = judged(docs, words, percent).where("not kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (text_digest() == F.col("__digest")), "left_anti").select(*columns)

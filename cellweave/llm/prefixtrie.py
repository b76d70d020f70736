"""The trie of conversation prefixes, built as a burst trie over shards.

A turn is named by 128 bits of a digest of role and text; a conversation is the string of its turns' names, and conversations with the same
turns are one string with a number of members. *Containers* hold the strings below a trie head. At first one container, of the root, holds all.
A container with more than ``LIMIT`` turns left in several strings bursts: its head takes in the turns that all strings share, and the strings go to new
containers by the next turn's name. Only counts, the least and the greatest string of a container are gathered for this, combined on the map side; the
strings move by a join that adaptive execution splits. So every round really divides, and long shared beginnings take one round.

Containers that fit are sorted within their shards and swept once: a stack holds the nodes on the way to the current string, a node is complete when the
next string leaves it. Nodes wait for the smallest member of their parent, so a task holds one container. What lies below burst heads is summed over
their containers, each of which knows the heads above it.

The members of a string are digested in order of conv_id: sorted by ranges of (string, conv_id), cut into chunks, and the chunks of a string are streamed
through one hash; so a string with very many members is one row for some thousand members by then.

Turns are ordered by turn (null first), then role and text; a null role or text is empty. Rows without conv_id belong to no conversation and are
left out. Equal rows are turns of their own. A conversation is one row of names, 24 bytes a turn. Without rows there is no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import partitions, stored

LIMIT = 50_000
CHUNK = 4096
UNIT = 16  # bytes of a turn's name
WORD = r"[^\x20\x09-\x0D]+"
NOTHING = sha256(b"").hexdigest()

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, heads array<binary>")


def named(*parts: Column) -> Column:
    """Hexadecimal digits of ``UNIT`` bytes of a digest."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 2 * UNIT)


def own_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: names and words of the turns, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    name = named(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = rows.select("conv_id", place.alias("place"), name.alias("name"), F.regexp_count("text", F.lit(WORD)).alias("words"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "name", "words"))).alias("turns"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """``(conv_id, key, path, words)`` with the beginning of the first conversation of each block of twenty put before the later turns."""
    own = stored(own_turns(rows), "turns")
    lead = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    both = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "h": h}).join(lead, "base", "left")
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = F.concat(F.when(F.col("lead").isNotNull(), F.slice("lead", 1, F.col("h"))).otherwise(F.slice("turns", 1, 0)), tail)
    both = both.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.unhex(F.array_join("turns.name", "")).alias("path"), F.col("turns.words").alias("words"))
    return both.select("conv_id", F.unhex(named(F.col("path"))).alias("key"), "path", "words")


def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ``(key, conv_id)`` to runs of at most ``CHUNK`` members of one key."""
    for pdf in frames:
        run = (pdf["key"] != pdf["key"].shift()).cumsum()
        part = pdf.groupby(run, sort=False).cumcount() // CHUNK
        grouped = pdf.groupby([run, part], sort=False)
        out = grouped.agg(key=("key", "first"), first=("conv_id", "first"), n=("conv_id", "size"))
        out["ids"] = [",".join(map(str, ids)) for _, ids in grouped["conv_id"]]
        yield out


def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted chunks to one row for each key: members, the smallest, and the digest of all joined by commas."""
    key, state, conv, n = None, None, 0, 0
    for pdf in frames:
        done = []
        for k, first, count, ids in zip(pdf["key"], pdf["first"], pdf["n"], pdf["ids"], strict=True):
            if k != key:
                if key is not None:
                    done.append((key, conv, n, state.hexdigest()))
                key, state, conv, n = k, sha256(ids.encode()), first, count
            else:
                state.update(f",{ids}".encode())
                n += count
        yield pd.DataFrame(done, columns=["key", "conv", "n", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, conv, n, state.hexdigest())], columns=["key", "conv", "n", "ends"])


def strings(members: DataFrame) -> DataFrame:
    """``(path, words, conv, n, ends)``: each distinct string once."""
    parts = partitions(members.sparkSession)
    ids = members.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = ids.mapInPandas(chunks, "key binary, first long, n long, ids string")
    known = runs.repartition(parts, "key").sortWithinPartitions("key", "first").mapInPandas(digests, "key binary, conv long, n long, ends string")
    once = members.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"))
    return once.join(known, "key").drop("key")


def shared_units(a: str, b: str) -> Column:
    return F.pandas_udf(lambda a, b: pd.Series([common(x, y, 0) for x, y in zip(a, b, strict=True)], dtype="int32"), "int")(a, b)


def common(a: bytes, b: bytes, known: int) -> int:
    """Turns that two strings share at their beginning, ``known`` of them being known."""
    most = min(len(a), len(b)) // UNIT
    while known < most and a[UNIT * known:UNIT * known + UNIT] == b[UNIT * known:UNIT * known + UNIT]:
        known += 1
    return known


def burst(paths: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Containers that fit, as rows of strings, and the heads above them (None without any)."""
    rows = paths.select("*", F.substring("path", F.lit(1), F.lit(0)).alias("head"), F.lit(0).alias("top"), F.lit(None).cast("long").alias("parent"),
                        F.array().cast("array<binary>").alias("heads"))
    turns = (F.octet_length("path") / UNIT).cast("long")
    fitting, heads = [], []
    while True:
        sizes = rows.groupBy("head").agg(
            F.sum(turns - F.col("top")).alias("turns"), F.count(F.lit(1)).alias("strings"), F.min(F.struct("path", "words", "ends")).alias("low"),
            F.max("path").alias("high"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
            F.first("top").alias("top"), F.first("parent").alias("parent"), F.first("heads").alias("heads"))
        large = sizes.where((F.col("turns") > limit) & (F.col("strings") > 1)).withColumn("bottom", shared_units("low.path", "high"))
        ends = F.when(F.octet_length("low.path") == F.col("bottom") * UNIT, F.col("low.ends")).otherwise(NOTHING)
        words = F.slice(F.concat(F.array(F.lit(0)), "low.words"), F.col("top") + 1, F.col("bottom") - F.col("top") + 1)
        large = stored(large.select("head", "heads", "top", "bottom", "parent", "conv", "n", words.alias("words"), ends.alias("ends")), "heads")
        if large.isEmpty():
            break
        new = large.select("head", "bottom", F.col("conv").alias("head_conv"))
        rows = stored(rows.join(new if heads else F.broadcast(new), "head", "left"), "containers")  # the root is one row
        heads.append(large)
        fitting.append(rows.where("bottom is null").drop("bottom", "head_conv"))
        below = rows.where(F.octet_length("path") > F.col("bottom") * UNIT)
        rows = below.select(
            "path", "words", "conv", "n", "ends", F.unhex(named(F.substring("path", F.lit(1), (F.col("bottom") + 1) * UNIT))).alias("head"),
            (F.col("bottom") + 1).alias("top"), F.col("head_conv").alias("parent"), F.concat("heads", F.array("head")).alias("heads"))
    for part in fitting:
        rows = rows.unionByName(part)
    every = heads[0] if heads else None
    for part in heads[1:]:
        every = every.unionByName(part)
    return rows, every


class Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "words", "ends", "kids")

    def __init__(self, words: int):
        self.conv, self.n, self.children, self.leaves, self.saved, self.words, self.ends, self.kids = None, 0, 0, 0, 0, words, NOTHING, []

    def add(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n

    def row(self, depth: int) -> tuple:
        return self.conv, depth, self.n, self.children, self.leaves or 1, self.saved + (self.n - 1) * self.words, self.ends


class Sweep:
    """The nodes of one container from its sorted strings."""

    def __init__(self, top: int, parent: int | None, heads: list[bytes], words: list[int], done: list[tuple]):
        self.top, self.parent, self.heads, self.done, self.path = top, parent, heads, done, None
        self.stack = [Node(words[top - 1] if top else 0)]

    def close(self, depth: int) -> None:
        """Nodes deeper than ``depth`` are complete."""
        while len(self.stack) > depth - self.top + 1:
            node = self.stack.pop()
            row = node.row(self.top + len(self.stack))
            self.done += [(kid, node.conv, None) for kid in node.kids]
            above = self.stack[-1]
            above.add(node.conv, node.n)
            above.children += 1
            above.leaves += row[4]
            above.saved += row[5]
            above.kids.append(row)

    def take(self, path: bytes, words, conv: int, n: int, ends: str) -> None:
        shared = self.top if self.path is None else common(self.path, path, self.top)
        self.close(shared)
        self.stack += [Node(int(w)) for w in words[shared:]]
        self.stack[-1].add(conv, n)
        self.stack[-1].ends = ends
        self.path = path

    def end(self) -> None:
        self.close(self.top)
        node = self.stack[0]
        self.done += [(kid, node.conv, None) for kid in node.kids]
        self.done.append((node.row(self.top), self.parent, self.heads))


def swept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Containers, each together and sorted by string, to their nodes."""

    def frame(done: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(*row[:2], parent, *row[2:], heads) for row, parent, heads in done], columns=[x.split()[0] for x in NODES.split(", ")])
        return out.astype({"parent_conv_id": "Int64"})

    current, head, done = None, None, []
    for pdf in frames:
        for h, top, parent, heads, path, words, conv, n, ends in zip(
                *(pdf[c] for c in ("head", "top", "parent", "heads", "path", "words", "conv", "n", "ends")), strict=True):
            if h != head:
                if current:
                    current.end()
                current, head = Sweep(top, None if pd.isna(parent) else int(parent), list(heads), words, done), h
            current.take(path, words, conv, n, ends)
        if len(done) >= 20_000:
            yield frame(done)
            done.clear()
    if current:
        current.end()
        yield frame(done)


def trie(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each node; ``heads`` is for the operator's own use and left out."""
    parts = partitions(rows.sparkSession)
    paths = stored(strings(stored(rebuilt(rows), "rebuilt")), "strings")
    fitting, heads = burst(paths, limit)
    wanted = fitting.select("head", "top", F.col("parent").cast("string").alias("parent"), "heads", "path", "words", "conv", "n", "ends")
    nodes = wanted.repartition(parts, "head").sortWithinPartitions("head", "path").mapInPandas(swept, NODES)
    if heads is None:
        return nodes.drop("heads")
    nodes = stored(nodes, "nodes")
    own = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w) * (F.col("n") - 1)
    parts_below = nodes.where("heads is not null").select("heads", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).unionByName(
        heads.select("heads", F.lit(0).cast("long").alias("leaves"), own.alias("saved")))
    child = (F.col("head") == F.element_at("heads", F.size("heads"))).cast("long")
    below = parts_below.where(F.size("heads") > 0).select("heads", F.explode("heads").alias("head"), "leaves", "saved").groupBy("head").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum(child).alias("children"))
    chain = heads.join(below, "head").select("*", F.posexplode("words").alias("k", "w"))
    last = F.col("k") == F.size("words") - 1
    rest = F.aggregate(F.slice("words", F.col("k") + 1, F.size("words")), F.lit(0).cast("long"), lambda a, w: a + w) * (F.col("n") - 1)
    chain = chain.select(
        F.col("conv").alias("conv_id"), (F.col("top") + F.col("k")).cast("long").alias("depth"),
        F.when(F.col("k") > 0, F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + rest).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"))
    return nodes.drop("heads").unionByName(chain)

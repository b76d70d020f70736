"""Folder watcher with one state and one timer per folder (R2).

A notice says that a poll saw a file of a folder at some size. A new file or a changed size is activity; the same size seen
again is not, so polling a finished folder does not keep it open, and a file that still grows does. When nothing was active for
``quiet`` the folder is emitted with all its files. A folder that stirs after that is emitted again as a correction
with the next revision and the totals of *all* its files; nothing that came late is lost.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
OUT = "folder string, revision int, start timestamp, last timestamp, n_files long, n_bytes long"
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


class FolderState(StatefulProcessor):
    """Sizes seen by file, and per folder ``(start, last, n_files, n_bytes, revision, open)``, times in microseconds.

    Every call to the state is a message to the JVM, so only what can have changed is asked for and written. An open folder
    has one timer, which its ``last`` tells.
    """

    def __init__(self, quiet_us: int):
        self.quiet_us = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sizes = handle.getMapState("sizes", "file string", "size long")
        self.folder = handle.getValueState("folder", "start long, last long, n_files long, n_bytes long, revision int, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Notices of one folder in one batch, in order of their clock; a gap of ``quiet`` between them closes as a timer would."""
        got = sorted((r["clock"], r["file"], r["size"]) for r in rows)
        now = self._now()
        before, timer, closed = dict(now), self._timer(now), []
        stored = {file: self._size(file) if now["n_files"] else None for file in {file for _, file, _ in got}}
        known = dict(stored)
        for at, file, size in got:
            if now["open"] and at - now["last"] >= self.quiet_us:
                closed.append(self._close(key, now))
            if known[file] == size:
                continue
            now["n_files"] += known[file] is None
            now["n_bytes"] += size - (known[file] or 0)
            known[file] = size
            now["start"] = at if now["start"] is None else min(now["start"], at)
            now["last"] = at if now["last"] is None else max(now["last"], at)
            now["open"] = True
        for file, size in known.items():
            if stored[file] != size:
                self.sizes.updateValue((file,), (size,))
        if now != before:
            self._keep(now)
        if (wake := self._timer(now)) != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        yield from closed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The watermark has passed: close if the folder is still open and really was quiet, else wait on."""
        now = self._now()
        if now["open"] and expiredTimerInfo.getExpiryTimeInMs() * 1000 >= now["last"] + self.quiet_us:
            row = self._close(key, now)
            self._keep(now)
            yield row

    def _now(self) -> dict:
        names = ("start", "last", "n_files", "n_bytes", "revision", "open")
        return dict(zip(names, self.folder.get() or (None, None, 0, 0, 0, False)))

    def _size(self, file: str) -> int | None:
        value = self.sizes.getValue((file,))
        return None if value is None else value[0]

    def _keep(self, now: dict) -> None:
        self.folder.update(tuple(now.values()))

    def _timer(self, now: dict) -> int | None:
        """The end of the quiet time of an open folder, rounded up to a millisecond."""
        return -((-now["last"] - self.quiet_us) // 1000) if now["open"] else None

    def _close(self, key, now: dict) -> Row:
        now["revision"] += 1
        now["open"] = False
        stamp = lambda us: EPOCH + dt.timedelta(microseconds=us)
        return Row(folder=key[0], revision=now["revision"], start=stamp(now["start"]), last=stamp(now["last"]),
                   n_files=now["n_files"], n_bytes=now["n_bytes"])


def watch_folders(
    notices: DataFrame, folder: str, file: str, size: str, quiet_seconds: int, late: str = "0 seconds", clock: str | None = None,
) -> DataFrame:
    """R2 with state: ``(folder, revision, start, last, n_files, n_bytes)``, one row each time a folder falls quiet.

    ``clock`` is the time of the poll; polls may be out of order by ``late``. Without it the time of the batch is the
    clock, which never runs backwards, so no notice can be too late however old its file is. Rows without folder, file or
    clock are left out; a null size counts as 0. State is one small row per folder and one per file, kept by the state
    store, which must be the RocksDB provider; the notices of one folder in one batch are read by one task, so
    bound a batch with ``maxFilesPerTrigger``.
    """
    at: Column = F.current_timestamp() if clock is None else F.col(clock).cast("timestamp")
    rows = notices.select(
        F.col(folder).cast("string").alias("folder"), F.col(file).cast("string").alias("file"),
        F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("size"), at.alias("_at"),
    ).where("folder IS NOT NULL AND file IS NOT NULL AND _at IS NOT NULL").withWatermark("_at", late)
    rows = rows.withColumn("clock", F.unix_micros("_at"))
    return rows.groupBy("folder").transformWithState(
        statefulProcessor=FolderState(quiet_seconds * 1_000_000), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def use_state_store(spark: SparkSession) -> None:
    """The state store that timers need; a cluster may set it in its defaults instead."""
    spark.conf.set(STORE_KEY, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def emit_revisions(folders: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Revisions to a Parquet table, each once: the sink's log and the state commit with the batch."""
    w = folders.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def latest(revisions: DataFrame) -> DataFrame:
    """The last revision of each folder: the corrected state (map-side ``max_by``)."""
    rest = [c for c in revisions.columns if c != "folder"]
    best = F.max_by(F.struct(*rest), F.col("revision")).alias("_r")
    return revisions.groupBy("folder").agg(best).select("folder", *[F.col(f"_r.{c}").alias(c) for c in rest])


def closings(notices: DataFrame, folder: str, file: str, size: str, clock: str, quiet_seconds: int) -> DataFrame:
    """The same revisions from stored notices, by windows: to rebuild a lost table and to check a stream.

    A closed folder whose quiet time ends after the last clock has no revision yet.
    """
    rows = notices.select(
        F.col(folder).cast("string").alias("folder"), F.col(file).cast("string").alias("file"),
        F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("size"), F.unix_micros(F.col(clock).cast("timestamp")).alias("at"),
    ).dropna(subset=["folder", "file", "at"])
    seen = F.lag("size").over(Window.partitionBy("folder", "file").orderBy("at", "size"))
    act = rows.withColumn("was", seen).where("was IS NULL OR was <> size")
    order = Window.partitionBy("folder").orderBy("at", "file", "size")
    runs = act.withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(order) >= quiet_seconds * 1_000_000).cast("int"), F.lit(1)))
    runs = runs.withColumn("revision", F.sum("new").over(order).cast("int"))
    each = runs.groupBy("folder", "revision").agg(
        F.max("at").alias("last"), F.min("at").alias("first"), F.count_if(F.col("was").isNull()).alias("f"),
        F.sum(F.col("size") - F.coalesce("was", F.lit(0))).alias("b"))
    upto = Window.partitionBy("folder").orderBy("revision")
    return each.select(
        "folder", "revision", F.timestamp_micros(F.min("first").over(upto)).alias("start"), F.timestamp_micros("last").alias("last"),
        F.sum("f").over(upto).alias("n_files"), F.sum("b").over(upto).alias("n_bytes"))

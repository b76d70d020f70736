"""Newly arriving scans: process each once, wait until a folder is quiet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Folder names of the watcher's own work.
OWN_PREFIX = "compressing-"


def arriving_files(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", glob: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """File stream over all scan folders below ``folder``; only data files, none from the watcher's own folders."""
    r = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    rows = r.format(fmt).load(folder).select("*", F.col("_metadata.file_path").alias("file"))
    rows = rows.withColumn("scan", F.element_at(F.split("file", "/"), -2))
    return rows.where(~F.col("scan").startswith(OWN_PREFIX))


def process_arrivals(
    rows: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda d: d, available_now: bool = True
) -> StreamingQuery:
    """``work`` on every new file exactly once.

    The checkpoint remembers the files. A batch writes only its own ``batch=<id>`` folder and replaces it when
    it is repeated after a failure, so no row is lost or doubled.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()


def completed_folders(events: DataFrame, folder: str, ts: str, quiet: str, late: str, unique: list[str] | None = None) -> DataFrame:
    """R2: a folder is complete when nothing arrived for ``quiet``: ``(folder, start, end, n_files)``.

    Events later than ``late`` behind the newest are dropped, and a folder that stirs again after closing
    opens a new session. ``unique`` names columns that identify a file, so repeated notices count once.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    if unique:
        timed = timed.dropDuplicatesWithinWatermark(unique)
    w = F.session_window(F.col(ts), quiet)
    return timed.groupBy(F.col(folder), w.alias("_w")).agg(F.count(F.lit(1)).alias("n_files")).select(
        folder, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n_files")


def emit_completed(folders: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """R2: closed sessions to a Parquet table, each once."""
    w = folders.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()

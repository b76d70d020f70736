"""Streams over files that Spark writes from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import bind, table
from cellweave.session import fresh_path
from cellweave.streaming import arrivals as ar
from cellweave.streaming import folders as fo

SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def arrivals(spark, d):
    """Events as data files in one folder per type, plus a folder of the watcher's own."""
    path = fresh_path(spark, "arrivals")
    ev = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    ev.withColumnRenamed("event_type", "scan").write.partitionBy("scan").parquet(path)
    ev.drop("event_type").write.parquet(f"{path}/compressing-now")
    return path


@bind("r1_process_once", "SELECT 'scan=' || event_type AS scan, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def r1(spark, d):
    src, out, cp = arrivals(spark, d), fresh_path(spark, "processed"), fresh_path(spark, "progress")
    for _ in range(2):  # the second run finds nothing new
        rows = ar.arriving_files(spark, src, SCHEMA, max_files=3)
        ar.run_to_end(ar.process_arrivals(rows, out, cp))
    return spark.read.parquet(out).groupBy("scan").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@bind("r2_completed_folders", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n_files FROM s, m GROUP BY user_id, k, wm HAVING max(ts) + INTERVAL 2 HOUR < wm""")
def r2(spark, d):
    src, out, cp = fresh_path(spark, "notices"), fresh_path(spark, "complete"), fresh_path(spark, "progress")
    ev = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    ev.write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    ar.run_to_end(ar.emit_completed(ar.completed_folders(stream, "user_id", "ts", "2 hours", "1 hour", unique=["event_id"]), out, cp))
    newest = ev.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("_wm"))
    from cellweave.operators.ordered import attach_one_row
    done = attach_one_row(spark.read.parquet(out), newest).where(F.col("end") < F.col("_wm")).drop("_wm")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@bind("r2_folder_revisions", """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS folder, event_type AS file, event_id % 2 AS size, ts AS seen FROM events),
w AS (SELECT *, lag(size) OVER (PARTITION BY folder, file ORDER BY seen, size) AS was FROM r),
a AS (SELECT *, CASE WHEN seen < lag(seen) OVER (PARTITION BY folder ORDER BY seen, file, size) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS nw FROM w WHERE was IS NULL OR was <> size),
g AS (SELECT *, sum(nw) OVER (PARTITION BY folder ORDER BY seen, file, size ROWS UNBOUNDED PRECEDING) AS revision FROM a),
e AS (SELECT folder, revision, min(seen) AS first, max(seen) AS last, count(*) FILTER (WHERE was IS NULL) AS f, sum(size - coalesce(was, 0)) AS b FROM g GROUP BY 1, 2)
SELECT folder, CAST(revision AS INTEGER) AS revision, min(first) OVER k AS "start", last, CAST(sum(f) OVER k AS BIGINT) AS n_files, CAST(sum(b) OVER k AS BIGINT) AS n_bytes
FROM e, (SELECT max(ts) AS m FROM events) WHERE last + INTERVAL '2 hours 1 second' < m WINDOW k AS (PARTITION BY folder ORDER BY revision)""")
def r2b(spark, d):
    """Polls arrive in two parts; the watcher is stopped between them and goes on from its checkpoint."""
    src, out, cp = fresh_path(spark, "polls"), fresh_path(spark, "revisions"), fresh_path(spark, "progress")
    schema = "user_id long, event_type string, size long, ts timestamp"
    ev = table(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 2).alias("size"), F.col("ts").cast("timestamp").alias("ts"))
    first, last = ev.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return spark.createDataFrame([], fo.OUT)
    half = F.lit(first + (last - first) / 2)
    before = spark.conf.get(fo.STORE_KEY)
    fo.use_state_store(spark)
    try:
        for part in (F.col("ts") <= half, F.col("ts") > half):
            ev.where(part).write.mode("append").parquet(src)
            seen = fo.watch_folders(spark.readStream.schema(schema).parquet(src), "user_id", "event_type", "size", 2 * 3600, clock="ts")
            ar.run_to_end(fo.emit_revisions(seen, out, cp))
    finally:
        spark.conf.set(fo.STORE_KEY, before)
    done = spark.read.schema(fo.OUT).parquet(out).where(F.col("last") + F.expr("INTERVAL '2:00:01' HOUR TO SECOND") < F.lit(last))
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "last")})

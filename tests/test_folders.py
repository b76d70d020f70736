"""The folder watcher: growing files, corrections, late files, a restart, and the batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellweave.session import fresh_path
from cellweave.streaming import arrivals as ar
from cellweave.streaming import folders as fo

SCHEMA = "folder string, file string, size long, clock timestamp"
ZERO = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def state_store(spark):
    before = spark.conf.get(fo.STORE_KEY)
    fo.use_state_store(spark)
    yield
    spark.conf.set(fo.STORE_KEY, before)


def notices(spark, rows):
    at = lambda s: None if s is None else ZERO + dt.timedelta(seconds=s)
    return spark.createDataFrame([(d, f, n, at(s)) for d, f, n, s in rows], SCHEMA).coalesce(1)


def watch(spark, src, out, progress, late="0 seconds"):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    ar.run_to_end(fo.emit_revisions(fo.watch_folders(rows, "folder", "file", "size", 10, late, "clock"), out, progress))


def found(df):
    at = lambda t: (t - ZERO).total_seconds()
    return sorted((r.folder, r.revision, at(r.start), at(r.last), r.n_files, r.n_bytes) for r in df.collect())


BATCHES = [
    # a grows until 16; polls that see nothing new don't count; b is one file
    [("a", "x", 5, 0), ("a", "x", 7, 8), ("a", "x", 9, 16), ("b", "y", 4, 3), ("a", "x", 9, 20)],
    # b has closed by now; a closes at 26
    [("c", "z", 1, 27), ("a", "x", 9, 27), (None, "q", 1, 27), ("a", None, 1, 27), ("a", "n", 1, None)],
    # a file comes to b long after: a correction with both files; c's file has no size
    [("b", "late", None, 40), ("c", "z", 1, 41)],
    [("d", "end", 1, 100)],
]
WANT = [("a", 1, 0, 16, 1, 9), ("b", 1, 3, 3, 1, 4), ("b", 2, 3, 40, 2, 4), ("c", 1, 27, 27, 1, 1)]


def test_revisions_in_one_run_after_restarts_and_from_stored_notices(spark):
    once, steps = fresh_path(spark, "once"), fresh_path(spark, "steps")
    for i, rows in enumerate(BATCHES):
        notices(spark, rows).write.mode("append").parquet(once)
    out = fresh_path(spark, "out")
    watch(spark, once, out, fresh_path(spark, "progress"))
    assert found(spark.read.parquet(out)) == WANT
    out, progress = fresh_path(spark, "out"), fresh_path(spark, "progress")
    for rows in BATCHES:  # the query stops after each batch and goes on from its checkpoint
        notices(spark, rows).write.mode("append").parquet(steps)
        watch(spark, steps, out, progress)
    watch(spark, steps, out, progress)
    assert found(spark.read.parquet(out)) == WANT
    last = {r.folder: r.revision for r in fo.latest(spark.read.parquet(out)).collect()}
    assert last == {"a": 1, "b": 2, "c": 1}
    batch = fo.closings(spark.read.parquet(once), "folder", "file", "size", "clock", 10)
    assert found(batch.where(F.col("folder") != "d")) == WANT


def test_one_batch_closes_like_many(spark):
    src, out = fresh_path(spark, "one"), fresh_path(spark, "out")
    notices(spark, [r for b in BATCHES for r in b][::-1]).write.parquet(src)
    watch(spark, src, out, fresh_path(spark, "progress"))
    assert found(spark.read.parquet(out)) == WANT


def test_empty_stream_and_ties(spark):
    src, out = fresh_path(spark, "none"), fresh_path(spark, "out")
    notices(spark, [("a", "x", 1, 0)]).limit(0).write.parquet(src)
    watch(spark, src, out, fresh_path(spark, "progress"))
    assert found(spark.read.schema(fo.OUT).parquet(out)) == []
    src, out = fresh_path(spark, "tie"), fresh_path(spark, "out")
    notices(spark, [("a", "x", 1, 0)] * 3 + [("a", "y", 2, 0), ("b", "x", 1, 90)]).write.parquet(src)
    watch(spark, src, out, fresh_path(spark, "progress"))
    assert found(spark.read.parquet(out)) == [("a", 1, 0, 0, 2, 3)]


class Counted:
    """State of one folder that counts the messages a state server would get."""

    def __init__(self):
        self.calls, self.value, self.files, self.timers = 0, None, {}, []

    def getMapState(self, *_):
        counted = lambda f: lambda *a: (setattr(self, "calls", self.calls + 1), f(*a))[1]
        return type("Map", (), {"getValue": staticmethod(counted(self.files.get)), "updateValue": staticmethod(counted(self.files.__setitem__))})

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_a_folder_asks_its_state_only_for_what_can_have_changed():
    from pyspark.sql import Row
    state, folder = Counted(), fo.FolderState(10_000_000)
    folder.init(state)
    polls = lambda at, size, n: [Row(clock=at * 1_000_000, file=f"f{i}", size=size) for i in range(n)]
    assert list(folder.handleInputRows(("a",), iter(polls(0, 5, 5)), None)) == [] and state.timers == [10_000]
    assert state.calls == 1 + 5 + 1 + 1  # before, also five for files of a folder never seen, and the list of timers
    state.calls = 0
    assert list(folder.handleInputRows(("a",), iter(polls(5, 5, 5)), None)) == [] and state.timers == [10_000]
    assert state.calls == 1 + 5  # nothing changed, nothing written
    got = list(folder.handleInputRows(("a",), iter(polls(20, 6, 1)), None))
    assert [(r.revision, r.n_files, r.n_bytes) for r in got] == [(1, 5, 25)] and state.timers == [30_000]


def test_times_do_not_depend_on_the_time_zone_of_the_session(spark):
    src, out = fresh_path(spark, "zone"), fresh_path(spark, "out")
    notices(spark, [r for b in BATCHES for r in b]).write.parquet(src)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        watch(spark, src, out, fresh_path(spark, "progress"))
        got = spark.read.parquet(out).select("folder", "revision", F.unix_micros("last").alias("last")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    zero = int(ZERO.replace(tzinfo=dt.timezone.utc).timestamp())
    assert sorted((r.folder, r.revision, r.last // 1_000_000 - zero) for r in got) == [(f, n, last) for f, n, _, last, _, _ in WANT]

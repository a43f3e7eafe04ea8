"""Streams with state by key: outcomes, timers, restarts from a checkpoint, and that no state stays behind."""

import datetime as dt
import random
import time

import pytest

from quire.streaming import keyed

pytest.importorskip("google.protobuf")
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


class Files:
    """A folder that a stream reads a file at a time; ``run`` takes what is new, restarting from the checkpoint each time."""

    def __init__(self, spark, tmp, schema, make):
        self.spark, self.tmp, self.schema, self.make, self.n = spark, tmp, schema, make, 0
        (tmp / "in").mkdir(parents=True)

    def source(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.tmp / "in"))

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.json(str(self.tmp / f"x{self.n}"))
        [part] = (self.tmp / f"x{self.n}").glob("part-*")
        part.rename(self.tmp / "in" / f"{self.n:04d}.json")

    def run(self):
        self.query = self.make(self.source()).writeStream.format("json").option("path", str(self.tmp / "out")).option("checkpointLocation", str(self.tmp / "cp")).trigger(availableNow=True).start()
        self.query.awaitTermination(120)
        assert self.query.exception() is None
        return sorted(map(tuple, self.spark.read.schema(self.query_schema).json(str(self.tmp / "out")).collect()))

    def state_rows(self):
        """Rows of state, timers included, after the last batch."""
        return self.query.lastProgress["stateOperators"][0]["numRowsTotal"]


POLLS = "path string, ts timestamp, size long"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_files_settle_or_time_out(spark, tmp_path):
    files = Files(spark, tmp_path, POLLS, lambda s: keyed.settled_files(s, limit_s=60, clock="event"))
    files.query_schema = "path string, size long, outcome string"
    files.add([("a", at(0), 10), ("b", at(0), None), ("c", at(0), 5), ("d", at(1), 0)])
    files.add([("a", at(3), 20), ("b", at(3), None), ("c", at(3), 6), ("d", at(4), 7)])
    assert files.run() == []
    files.add([("a", at(6), None), ("a", at(9), 20), ("c", at(6), 7), ("d", at(7), 0)])
    assert files.run() == [("a", 20, "settled")]  # a poll without the file doesn't count; the state came from the checkpoint
    files.add([("a", at(12), 20), ("a", at(15), 20), ("d", at(10), 7)])
    assert files.run() == [("a", 20, "settled"), ("d", 7, "settled")]  # once each
    files.add([("z", at(100), 1)])
    files.add([("z", at(101), 2)])
    done = [("a", 20, "settled"), ("b", 0, "timeout"), ("c", 7, "timeout_with_file"), ("d", 7, "settled")]
    assert files.run() == done
    files.add([("y", at(500), 1), ("y", at(500.5), 1)])
    files.add([("y", at(900), 1)])
    files.add([("y", at(901), 1)])
    files.run()
    assert files.state_rows() <= 2  # what there was of a, b, c, d and z went; y's mark or wait and its timer are left


def test_no_state_is_left_by_the_clock(spark, tmp_path):
    files = Files(spark, tmp_path, POLLS, lambda s: keyed.settled_files(s, limit_s=10))
    for i in range(3):
        files.add([("f", at(i), 10 if i else 4), ("g", at(i), i + 1), ("h", at(i), None)])
    query = files.make(files.source()).writeStream.format("memory").queryName("by_clock").trigger(processingTime="500 milliseconds").start()
    try:
        left, empty = dt.datetime.now() + dt.timedelta(seconds=90), False
        while dt.datetime.now() < left and not empty:
            time.sleep(0.5)
            progress = query.lastProgress
            empty = spark.table("by_clock").count() == 3 and progress is not None and progress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        query.stop()
    assert sorted(map(tuple, spark.table("by_clock").collect())) == [("f", 10, "settled"), ("g", 3, "timeout_with_file"), ("h", 0, "timeout")]
    assert empty


def test_progress_never_falls_back(spark, tmp_path):
    files = Files(spark, tmp_path, "run_id string, ts timestamp, value double, force boolean", keyed.running_progress)
    files.query_schema = "run_id string, ts timestamp, progress double"
    files.add([("a", at(0), 1.0, None), ("a", at(0.5), 9.0, None), ("a", at(2), 7.0, None), ("b", at(0), None, None)])
    files.add([("a", at(3), 8.0, None), ("a", at(3.1), 12.0, None), ("a", at(1), 30.0, None)])
    first = files.run()
    assert first == [("a", at(0), 5.0), ("a", at(2), 9.0), ("b", at(0), 5.0)]  # 3.0 and 3.1 wait; 30 was late and counts from then on
    files.add([("a", at(3.2), 10.0, True), ("a", at(4), 3.0, None)])
    assert files.run() == sorted([*first, ("a", at(3.2), 17.0)])
    files.add([("c", at(60), 6.0, None)])
    files.add([("c", at(61.5), 4.0, None)])
    found = files.run()
    assert ("a", at(4), 17.0) in found  # what waited was written once the time was up
    by = {}
    for run, ts, value in found:
        by.setdefault(run, []).append((ts, value))
    assert all([v for _, v in sorted(x)] == sorted(v for _, v in x) for x in by.values())
    files.add([("c", at(3000), 6.0, None)])
    files.add([("c", at(3001), 6.0, None)])
    files.run()
    assert files.state_rows() <= 2  # a and b are forgotten


def test_items_wait_while_their_run_is_paused(spark, tmp_path):
    schema = "run_id string, at timestamp, item string, status string"
    split = lambda s: keyed.gated_items(s.where("item IS NOT NULL").select("run_id", "item", "at"), s.where("item IS NULL").select("run_id", "status", "at"))
    files = Files(spark, tmp_path, schema, split)
    files.query_schema = "run_id string, item string, at timestamp, released_at timestamp"
    item = lambda run, t, name: (run, at(t), name, None)
    flag = lambda run, t, name: (run, at(t), None, name)
    files.add([item("r", 1, "a"), flag("r", 2, "paused"), item("r", 3, "c"), item("r", 2, "b"), item("q", 1, "x")])
    first = [("q", "x", at(1), at(1)), ("r", "a", at(1), at(1))]
    assert files.run() == first  # b comes at the time of the flag, which counts first
    files.add([item("r", 4, "d"), item("q", 4, "y")])
    second = files.run()
    assert second == sorted([*first, ("q", "y", at(4), at(4))])  # still paused after a restart
    files.add([flag("r", 5, "running"), item("r", 6, "e"), flag("r", 7, "paused"), item("r", 8, "f")])
    third = files.run()
    assert third == sorted([*second, ("r", "b", at(2), at(5)), ("r", "c", at(3), at(5)), ("r", "d", at(4), at(5)), ("r", "e", at(6), at(6))])
    files.add([flag("r", 9, "running")])
    assert files.run() == sorted([*third, ("r", "f", at(8), at(9))])
    assert files.state_rows() == 0


def test_plain_fold():
    assert keyed.fold_settled([(0, 5), (1, None), (2, 5)]) == (5, "settled")
    assert keyed.fold_settled([(0, 5), (1, 6)]) is None
    assert keyed.fold_settled([(0, None), (721_000, None)]) == (0, "timeout")
    r = random.Random(1)
    assert all(keyed.fold_settled([(i, r.choice([0, 1])) for i in range(40)]) == (1, "settled") for _ in range(20))

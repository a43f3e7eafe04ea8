import datetime as dt

import pytest

from quire.streaming import keyed, runs

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def stream(spark, path, batches, schema):
    """A stream that reads one file for each list of rows, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_sessions_agree_with_a_batch(spark, tmp_path):
    rows = [("a", at(0)), ("a", at(10)), ("a", at(40)), ("b", at(5)), ("z", at(500))]
    schema = "run_id string, ts timestamp"
    want = {(r.run_id, r.started, r.stale_from, r.beats) for r in runs.sessions(spark.createDataFrame(rows, schema)).collect()}
    got = {(r.run_id, r.started, r.stale_from, r.beats) for r in drain(runs.sessions(stream(spark, tmp_path, [rows[:3], rows[3:]], schema)), "sessions").collect()}
    assert ("a", at(0), at(25), 2) in got
    assert got == {w for w in want if w[0] != "z"}  # the last one is still open


def test_repeated_starts_are_dropped(spark, tmp_path):
    schema = "source string, out string, ts timestamp"
    source = stream(spark, tmp_path, [[("s", "o", at(0)), ("s", "o", at(3))], [("s", "o", at(5)), ("t", "o", at(5))]], schema)
    assert sorted(r.source for r in drain(runs.first_starts(source, ["source", "out"]), "starts").collect()) == ["s", "t"]


def test_settled_files(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    schema = "path string, ts timestamp, size long"
    source = stream(spark, tmp_path, [[("f", at(0), 10), ("g", at(0), 1)], [("f", at(1), 20), ("g", at(1), 1)], [("f", at(2), 20)], [("f", at(3), 20)]], schema)
    assert sorted((r.path, r["size"]) for r in drain(keyed.settled_files(source, clock="event"), "settled").collect()) == [("f", 20), ("g", 1)]


def test_progress_windows(spark, tmp_path):
    schema = "run_id string, ts timestamp, value double"
    rows = [("a", at(1), 5.0), ("a", at(2), 9.0), ("a", at(7), 7.0), ("a", at(300), 1.0)]
    got = drain(runs.progress_by_window(stream(spark, tmp_path, [rows], schema), "run_id", "ts", "value"), "progress", "complete")
    assert {(r["from"], r.progress, r.events) for r in got.collect()} == {(at(0), 9.0, 2), (at(5), 7.0, 1), (at(300), 1.0, 1)}


def test_linked_and_latest(spark, tmp_path):
    schema = "run_id string, ts timestamp, status string"
    source = stream(spark, tmp_path / "in", [[("i1", at(0), "running")], [("i1", at(1), "completed"), ("i2", at(1), "paused"), ("x", at(1), "failed")]], schema)
    links = spark.createDataFrame([("i1", "b1"), ("i2", "b2")], "image_run_id string, book_run_id string")
    query = runs.upsert_latest(runs.linked_states(source, links), str(tmp_path / "out"), str(tmp_path / "cp"), "book_run_id", "ts")
    query.awaitTermination(120)
    last = query.lastProgress["batchId"]
    got = {r.book_run_id: r.book_status for r in spark.read.parquet(f"{tmp_path}/out/v{last}").collect()}
    assert got == {"b1": "completed", "b2": "paused"}

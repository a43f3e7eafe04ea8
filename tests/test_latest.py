"""Latest rows kept by appending: over many batches, with snapshots, and for batches that run again."""

import os

from quire.streaming import runs

SCHEMA = "run_id string, n long, status string"


def batches():
    return [[(f"r{(i * 7 + j) % 11}", i * 3 + j, f"s{i}{j}") for j in range(3)] for i in range(9)]


def test_append_and_snapshots(spark, tmp_path):
    for i, rows in enumerate(batches()):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    query = runs.append_latest(source, str(tmp_path / "out"), str(tmp_path / "cp"), "run_id", "n", every=3)
    query.awaitTermination(180)
    want = {}
    for rows in batches():
        want.update({k: (n, s) for k, n, s in rows})
    got = {r.run_id: (r.n, r.status) for r in runs.read_latest(spark, str(tmp_path / "out"), "run_id", "n").collect()}
    assert got == want
    left = os.listdir(tmp_path / "out")
    assert sum(x.startswith("whole") for x in left) == 2 and sum(x.startswith("batch") for x in left) <= 6


def test_a_batch_that_ran_twice_counts_once(spark, tmp_path):
    first, again = ([("a", 1, "x"), ("b", 2, "y")], [("a", 1, "x"), ("b", 2, "y")])
    for rows in (first, again):
        spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "out/batch0"))
    os.makedirs(tmp_path / "out/batch1")  # begun and never ended
    assert sorted(map(tuple, runs.read_latest(spark, str(tmp_path / "out"), "run_id", "n").collect())) == [("a", 1, "x"), ("b", 2, "y")]

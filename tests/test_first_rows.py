"""Rows whose keys came before: hot keys, nulls, and rows that are equal altogether."""

import random

from quire.operators import audit, runs


def test_rows_that_came_before(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + [None, "", "a", "b"]), r.choice([1, None]), i % 60, i) for i in range(400)]
    seen, want = {}, []
    for k, x, at, i in sorted(rows, key=lambda v: (v[2], v[3])):
        if (k, x) in seen:
            want.append((k, x, at, i, seen[k, x]))
        seen.setdefault((k, x), i)
    frame = spark.createDataFrame(rows, "k string, x int, at int, id int")
    got = [(v.k, v.x, v["at"], v.id, v.first_id) for v in audit.duplicates(frame, ["k", "x"], ["at", "id"], "id").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    same = spark.createDataFrame([("a", 1)] * 5 + [("b", 1)], "k string, at int")
    assert audit.duplicates(same, ["k"], ["at"], "at").count() == 4


def test_the_best_run_of_a_group(spark):
    rows = [(1, "p", "running", 5, "2024-01-01"), (2, "p", "running", 7, "2024-01-01"), (3, "p", "queued", 7, "2024-01-02"), (4, "p", "queued", 7, "2024-01-02"), (5, "p", "failed", 99, "2024-01-02"), (6, None, "running", None, None)]
    frame = spark.createDataFrame(rows, "id int, project string, status string, total_items long, created_at string").selectExpr("*", "CAST(NULL AS string) AS heartbeat_at", "CAST(NULL AS string) AS updated_at")
    assert {r.project: r.id for r in runs.best_run(frame, ["project"]).collect()} == {"p": 3, None: 6}

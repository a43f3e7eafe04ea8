"""The as-of match over all runs and files of a hot project, against brute force and without all pairs."""

from quire.operators import work


def test_recover_match_of_a_hot_project(spark):
    runs = [(i, "hot" if i % 5 else f"p{i}", i * 40) for i in range(600)] + [(900, None, 1), (901, "hot", None)]
    files = [("hot", f"f{j}", j * 20 if j % 9 else None) for j in range(900)] + [(f"p{i}", f"g{i}", i * 40 - i) for i in range(0, 600, 10)] + [(None, "x", 5), ("hot", "f10", 200)]
    left = spark.createDataFrame(runs, "run_id long, project string, s long").selectExpr("run_id", "project", "timestamp_seconds(s) AS started")
    right = spark.createDataFrame(files, "project string, path string, m long").selectExpr("project", "path", "timestamp_seconds(m) AS mtime")
    found = work.recover_match(left, right)
    want = {i: max(((m, path) for q, path, m in files if q == p and None not in (q, m, s) and m >= s - 60), default=(None, None))[1] for i, p, s in runs}
    assert {r.run_id: r.path for r in found.collect()} == want
    assert len({x for x in want.values() if x}) > 2 and None in want.values()
    # one join, of runs with one row for each project
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("Join ") == 1 and found.count() == len(runs)
    assert "max(struct(mtime" in tree


def test_whole_tables_are_registered():
    from quire.queries import ORACLES, QUERIES

    assert {"recover_match_all", "rank_zip_import_all"} <= set(QUERIES) & set(ORACLES)
    assert "% 40" not in ORACLES["recover_match_all"] and "% 10" not in ORACLES["rank_zip_import_all"]

"""Rules of plans, outcomes, recovery, changes and lines on small tables, against plain Python where there is a rule to fold."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from quire.operators import merge, runs, segments, work
from quire.plans import pages as P
from quire.streaming import keyed
from quire.streaming import runs as streams

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_a_shard_is_matched_by_index_then_id_then_place(spark):
    chapters = spark.createDataFrame([(1, i, f"ch-{i}", 800 * i, 1) for i in range(8)], "doc_id int, chapter_idx long, chapter_id string, char_count int, paragraph_count int")
    said = [
        (1, 0, 0, "9", "ch-3", "10"),  # by id for 3, which also has the first place's neighbour
        (1, 0, 1, "2", "", "9"), (1, 0, 2, "2", "", "10"),  # the first of two by index
        (1, 0, 3, None, None, None), (1, 0, 4, "x", "ch-9", "5"),
    ]
    got = {r.chapter_idx: (r.spread_count, r.fell_back) for r in P.plan_by_shard(chapters, spark.createDataFrame(said, "doc_id int, shard long, pos long, chapter_index string, chapter_id string, spread_count string")).collect()}
    assert got[2] == (8, False) and got[3] == (8, False)  # "9" and "10" are over the most; the first stands
    assert got[1] == (8, False)  # by place: that of index 2
    assert got[0] == (8, False)  # by place
    assert {i: got[i] for i in range(4, 8)} == {4: (4, True), 5: (4, True), 6: (4, True), 7: (5, True)}


def test_outcomes_of_polls_are_those_of_a_fold(spark):
    r = random.Random(2)
    polls = {f"f{k}": [(i * r.choice([40_000, 90_000]), r.choice([None, 0, *range(1, 9)])) for i in range(12)] for k in range(60)}
    polls = {k: sorted({a: s for a, s in v}.items()) for k, v in polls.items()}
    rows = [(k, at(a / 1000), s) for k, v in polls.items() for a, s in v]
    got = {r.path: (r["size"], r.outcome) for r in runs.settle_outcomes(spark.createDataFrame(rows, "path string, ts timestamp, size long")).collect()}
    assert got == {k: o for k, v in polls.items() if (o := keyed.fold_settled(v))}


def test_progress_of_a_hot_run_is_a_running_maximum(spark):
    r = random.Random(4)
    rows = [("hot" if i % 10 else "b", i, r.choice([None, r.random() * 20])) for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.at: r.progress for r in runs.monotone_progress(spark.createDataFrame(rows, "run string, at long, value double"), "run", ["at"], "value").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    most = {}
    for run, i, value in rows:
        most[run] = max(most.get(run, 5.0), value or 0.0)
        assert got[i] == min(17.0, most[run])


def test_recovery_prefers_the_newest_and_then_the_log(spark):
    files = spark.createDataFrame([("p", "/a.png", at(100), 5), ("p", "/b.png", at(200), 5), ("p", "/empty.png", at(300), 0), ("q", "/c.png", at(200), 5), ("p", "/late.png", at(900), 5)], "project string, path string, mtime timestamp, size long")
    rows = [(1, "p", at(150), at(400), "x"), (2, "p", at(150), at(400), "see /c.png, /empty.png"), (3, "p", at(300), at(400), "/a.png"), (4, "p", at(150), at(170), None), (5, "zz", at(100), at(999), "/late.png."), (6, None, at(100), at(999), None)]
    got = {r.run_id: (r.path, r.from_log) for r in work.recover_as_of(spark.createDataFrame(rows, "run_id int, project string, started timestamp, at timestamp, log string"), files).collect()}
    assert got == {1: ("/b.png", False), 2: ("/c.png", True), 3: (None, False), 4: ("/a.png", False), 5: ("/late.png", True), 6: (None, False)}


def test_changed_pages(spark):
    schema = "doc_id int, chapter_idx int, spread_id string, image string"
    old = spark.createDataFrame([(1, 0, "a", "x"), (1, 0, "b", None), (1, 1, "c", "y"), (2, 0, "d", "z"), (3, 0, "e", "z")], schema)
    new = spark.createDataFrame([(1, 0, "a", "x"), (1, 0, "b", ""), (1, 1, "c", "y"), (2, 0, "d", "z"), (2, 0, "f", "z"), (4, 0, "e", "z")], schema)
    assert sorted(map(tuple, merge.changed_pages(old, new, ["image"]).collect())) == [(1, 0, "b", "changed"), (2, 0, "f", "added"), (3, 0, "e", "removed"), (4, 0, "e", "added")]
    assert merge.changed_pages(old, old, ["image"]).collect() == []


def test_lines_of_a_long_text_are_found_in_linear_time(spark):
    lines = [f"line {i} of a text without any heading at all, and some words" for i in range(160_000)]
    docs = spark.createDataFrame([(1, "\n\n".join(lines)), (2, "one\n\none\n\ntwo")], "doc_id int, text string")
    began = time.time()
    found = segments.split_chapters(docs).select("doc_id", "chapter_idx", "anchor_line", F.substring_index("text", "\n", 1).alias("first")).collect()
    assert time.time() - began < 60
    assert all(r.anchor_line == 2 * int(r.first.split()[1]) + 1 for r in found if r.doc_id == 1) and len(found) > 2000
    assert [r.anchor_line for r in found if r.doc_id == 2] == [1]


def test_states_are_handed_on_between_streams(spark, tmp_path):
    """Image and book runs as streams: events before and after their link, repeated and late ones; merged into one table."""
    events = [[("i1", at(0), "running", 50), ("i1", at(0), "running", 50), ("i2", at(5), "paused", 10)], [("i1", at(60), "completed", 90), ("i2", at(61), "superseded", 0), ("i3", at(61), "failed", 5)], [("x", at(5000), "running", 0)], [("i1", at(10), "failed", 0)]]
    links = [[("i1", "b1", at(1))], [("i2", "b2", at(30)), ("i3", "b3", at(62))], [("x", "bx", at(5000))], [("i9", "b9", at(5000))]]
    schemas = {"events": "run_id string, ts timestamp, status string, progress long", "links": "image_run_id string, book_run_id string, linked_at timestamp"}
    for name, batches in (("events", events), ("links", links)):
        (tmp_path / name).mkdir()
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schemas[name]).coalesce(1).write.json(str(tmp_path / f"{name}-{i}"))
    read = lambda name: spark.readStream.schema(schemas[name]).json(str(tmp_path / name))
    like = "book_run_id string, ts timestamp, status string, progress long"
    out = str(tmp_path / "out")
    assert streams.read_latest(spark, out, "book_run_id", "ts", like).collect() == []
    for i in range(4):
        for name in schemas:
            [part] = (tmp_path / f"{name}-{i}").glob("part-*")
            part.rename(tmp_path / name / f"{i}.json")
        query = streams.append_latest(streams.propagated(read("events"), read("links")), out, str(tmp_path / "cp"), "book_run_id", "ts")  # restarts from its checkpoint
        query.awaitTermination(100)
        assert query.exception() is None
    got = {r.book_run_id: (r.status, r.progress) for r in streams.read_latest(spark, out, "book_run_id", "ts", like).collect()}
    assert got == {"b1": ("ready_for_revision", 100), "b2": ("drawing", 28), "b3": ("failed", 100), "bx": ("drawing", 20)}

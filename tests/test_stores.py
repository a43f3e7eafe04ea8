"""Folders listed and read by tasks, against Spark's own reader."""

import os

from quire.sources import readers


def test_the_driver_holds_no_list_of_files(spark, tmp_path):
    names = ["a.txt", "x/b c.txt", "x/y/é%20.txt", "x/y/z/c.TXT", "k=1/d.txt", "k=1/_e=1.txt", "x/_no.txt", "_gone/f.txt", ".g.txt", "x/h.md", "x/empty.txt", "x/a[1]+b.txt"]
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else f"text {i} ü")
        os.utime(tmp_path / name, ns=(1, 1_700_000_000_123_456_789 + i * 10**9))
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    for pattern in ("*", "*.txt", "?.txt", "*[1]*", "{a,b c}.txt"):
        want = own.option("pathGlobFilter", pattern).load(str(tmp_path)).select("path", "length", "modificationTime").collect()
        got = sorted(map(tuple, readers.list_files(spark, str(tmp_path), pattern).collect()))
        # Spark's reader leaves files without a byte out
        assert [r for r in got if r[1]] == sorted(map(tuple, want)) and want
        assert sum(not r[1] for r in got) == (pattern in ("*", "*.txt"))
    listed = readers.list_files(spark, str(tmp_path), "*.txt")
    documents, errors = readers.read_documents(spark, str(tmp_path))
    assert not listed.inputFiles() and not documents.inputFiles() and not errors.inputFiles()
    want = {r.path: bytes(r.content).decode() for r in own.option("pathGlobFilter", "*").load(str(tmp_path)).collect()}
    assert {r.doc_id: r.text for r in documents.collect()} == want
    assert [(r.doc_id, r.error) for r in errors.collect()] == [(f"file:{tmp_path}/x/empty.txt", "No text could be extracted.")]
    assert readers.list_files(spark, str(tmp_path / "a.txt")).count() == 1

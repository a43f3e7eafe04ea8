"""Files below a folder, listed and opened by tasks: the driver holds no list of them."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read in a task before they are handed on.
_HELD = 4 << 20
_FOUND = pa.schema([("place", pa.string()), ("file_name", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("mtime", pa.int64())])
_OPENED = pa.schema([("doc_id", pa.string()), ("ext", pa.string()), ("content", pa.binary())])


def tasks(spark: SparkSession) -> int:
    """A core has at most eight tasks, however many files there are."""
    return 8 * spark.sparkContext.defaultParallelism


def located(spark: SparkSession, path: str):
    """A place as Hadoop's qualified path, its store, and its name for pyarrow: null for stores that pyarrow can't open."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(conf)
    where = store.makeQualified(where)
    local = where.toUri().getScheme() == "file"
    name = posixpath.normpath(where.toUri().getPath()) if local else where.toString()
    try:
        fs.FileSystem.from_uri(name)
    except (pa.ArrowInvalid, OSError):
        name = None
    return where, store, name


def _hidden(name: str) -> bool:
    """Names that Spark's readers skip."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))) or name.endswith("._COPYING_")


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """Name, whether it is a folder, length and time (whole milliseconds, in microseconds) of what a folder holds."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if _hidden(e.name):
                    continue
                if e.is_dir():
                    yield e.name, True, None, None
                elif e.is_file():
                    facts = e.stat()
                    yield e.name, False, facts.st_size, facts.st_mtime_ns // 1_000_000 * 1000
        return
    for e in store.get_file_info(fs.FileSelector(folder)):
        if not _hidden(e.base_name):
            yield e.base_name, e.type == fs.FileType.Directory, e.size, e.mtime_ns and e.mtime_ns // 1_000_000 * 1000


def _listed(name: str, deep: bool) -> Callable:
    """What is in the folders among the rows, one level or all below; files go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(name)

        def below(place: str) -> Iterator[tuple]:
            waiting = [place]
            while waiting:
                at = waiting.pop()
                for entry, folder, length, mtime in _entries(store, posixpath.join(root, at)):
                    where = posixpath.join(at, entry)
                    if folder and deep:
                        waiting.append(where)
                    else:
                        yield where, entry, folder, length, mtime

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[2]:
                        yield from below(row[0])
                    else:
                        yield row

        for part in batched(rows(), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), _FOUND.types, strict=True)], schema=_FOUND)

    return run


def files_below(spark: SparkSession, path: str) -> tuple[DataFrame, str] | None:
    """(path, place, file_name, length, mtime of all files below a folder; the folder's name for pyarrow). None where only Spark's readers can tell: other stores, patterns, single files.

    A task lists the folder, and the folders in it are dealt out and listed to their ends: one is listed in one task, a row at a time. Hidden names are
    skipped as Spark skips them.
    """
    if any(c in path for c in "*?[{\\"):
        return None
    where, store, name = located(spark, path)
    if name is None or not store.exists(where) or not store.getFileStatus(where).isDirectory():
        return None
    kind = "place string, file_name string, folder boolean, length long, mtime long"
    start = spark.range(0, 1, 1, 1).selectExpr("'' AS place", "'' AS file_name", "true AS folder", "cast(null AS long) AS length", "cast(null AS long) AS mtime")
    rows = start.mapInArrow(_listed(name, False), kind).repartition(tasks(spark)).mapInArrow(_listed(name, True), kind)
    return rows.select(F.concat(F.lit(where.toString().rstrip("/") + "/"), "place").alias("path"), "place", "file_name", "length", F.timestamp_micros("mtime").alias("mtime")), name


def _contents(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(name)
        held, size = [], 0
        for batch in batches:
            for doc_id, ext, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(posixpath.join(root, place)) as file:
                    held.append((doc_id, ext, file.read()))
                size += len(held[-1][2])
                if size >= _HELD or len(held) >= 10_000:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _OPENED.types, strict=True)], schema=_OPENED)


def contents(files: DataFrame, name: str) -> DataFrame:
    """doc_id, ext, content of files (doc_id, ext, place), dealt out by their names and read a few MB at a time."""
    return files.select("doc_id", "ext", "place").repartition(tasks(files.sparkSession)).mapInArrow(_contents(name), "doc_id string, ext string, content binary")

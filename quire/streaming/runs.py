"""Run logs as streams: stale runs, idempotent starts, progress by window, states handed on, upserts of the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.runs import _book_state


def sessions(beats: DataFrame, key: str = "run_id", at: str = "ts", gap: str = "15 minutes", late: str = "15 minutes") -> DataFrame:
    """Sessions of heartbeats; a run whose session ended is stale from then on. Works on streams and tables alike."""
    return beats.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("beats")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("stale_from"), "beats")


def first_starts(requests: DataFrame, keys: list[str], at: str = "ts", within: str = "12 minutes") -> DataFrame:
    """Requests without those that repeat one of the last 12 minutes."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def progress_by_window(events: DataFrame, key: str, at: str, value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """The most progress seen in each window of each run."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), key).agg(F.max(value).alias("progress"), F.count("*").alias("events")).select(key, F.col("w.start").alias("from"), "progress", "events")


def linked_states(events: DataFrame, links: DataFrame) -> DataFrame:
    """Events of image runs with the book run they belong to and the status that it takes on. links: image_run_id, book_run_id (static)."""
    status = F.when(F.col("status").isin("completed", "ready"), "completed").when(F.col("status").isin("failed", "stale"), "needs_attention").when(F.col("status") == "paused", "paused").otherwise("drawing")
    return events.join(links, F.col("run_id") == F.col("image_run_id")).select("book_run_id", "ts", status.alias("book_status"))


def propagated(events: DataFrame, links: DataFrame, late: str = "10 minutes", within: str = "1 day") -> DataFrame:
    """What book runs take on from their image runs, both streams: book_run_id, ts, status, progress. To be merged by ``append_latest``.

    events: run_id, ts, status, progress (of image runs). links: image_run_id, book_run_id, linked_at (from book runs). A link and an event meet whichever
    comes first, if the event is at most ``late`` before the link and at most ``within`` after it; what is older than that by the watermarks leaves the state.
    Repeated events (same run, time and status) count once; events later than ``late`` are left out.
    """
    seen = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "ts", "status"])
    known = links.withWatermark("linked_at", late)
    rows = seen.where("NOT coalesce(status IN ('superseded', 'stale'), false)").join(known, F.expr(f"run_id = image_run_id AND ts >= linked_at - INTERVAL {late} AND ts <= linked_at + INTERVAL {within}"))
    return rows.select("book_run_id", "ts", *_book_state(F.col("status"), F.col("progress")))


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """Complete folders ``kind``N below a path, by N."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()]
    return {int(n[len(kind) :]): f"{path}/{n}" for n in names if n.startswith(kind) and n[len(kind) :].isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))}


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: str, order: str):
    """Start a query that keeps, below ``path``, one versioned table of the latest row by key. Each batch reads the version before it.

    Batches that run again after a failure write their version anew, so that each counts once. Versions older than the one before the last
    are dropped. Every batch writes the whole table; where that is large beside a batch, ``append_latest`` writes what is new.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch:
            rows = spark.read.parquet(f"{path}/v{epoch - 1}").unionByName(batch)
        _latest(rows, key, order).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        _drop(spark, [p for n, p in _folders(spark, path, "v").items() if n < epoch - 1])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_latest(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, every: int = 20):
    """Start a query that writes, below ``path``, the latest rows of each batch; ``read_latest`` reads the table they make.

    Every ``every`` batches all that is there becomes one snapshot, so a row is written again once in so many batches. Batches that run
    again write the same folder. What a snapshot holds is dropped one snapshot later, so that readers of before can end.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch{epoch}")
        if epoch % every == every - 1:
            read_latest(spark, path, key, order).write.mode("overwrite").parquet(f"{path}/whole{epoch}")
            before = sorted(_folders(spark, path, "whole"))[-2:][0]
            _drop(spark, [p for n, p in _folders(spark, path, "batch").items() if n <= before and before < epoch] + [p for n, p in _folders(spark, path, "whole").items() if n < before])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, key: str, order: str, like: str | None = None) -> DataFrame:
    """The latest row by key of what ``append_latest`` wrote: the newest snapshot and the batches after it. No rows, of the schema ``like``, before the first batch."""
    whole, batches = _folders(spark, path, "whole"), _folders(spark, path, "batch")
    newest = max(whole, default=-1)
    parts = ([whole[newest]] if whole else []) + [p for n, p in sorted(batches.items()) if n > newest]
    if not parts:
        return spark.createDataFrame([], like or f"{key} string, {order} string")
    return _latest(spark.read.parquet(*parts), key, order)

"""Streams with state by key: files that settle or time out, progress that never falls back, items that wait while their run is paused.

State is kept by Spark's ``transformWithState``, which needs the RocksDB state store; ``keep_state`` sets it. Rows of one key and micro-batch are
sorted by their time before they are folded, so that the order within a batch doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# How long a file may take, how often progress is written, and the most and least of an import's progress.
FILE_LIMIT_S, WRITE_EVERY_MS, FLUSH_AFTER_MS = 12 * 60, 1200, 5000
PROGRESS_LOW, PROGRESS_HIGH = 5.0, 17.0
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, clock: str) -> DataFrame:
    keep_state(rows.sparkSession)
    return rows.groupBy(key).transformWithState(processor, out, "Append", {"processing": "ProcessingTime", "event": "EventTime", "none": "None"}[clock])


class _Settle(StatefulProcessor):
    """State: the last size seen and when watching began; a mark, which expires, on files that are through."""

    def __init__(self, limit_ms: int, event_time: bool) -> None:
        self.limit, self.event_time = limit_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watch = handle.getValueState("watch", "size long, began long")
        # state expires by the clock only, so that with event time the mark goes by a timer
        self.through = handle.getValueState("through", "until long", None if self.event_time else self.limit)

    def _end(self, path: str, size: int, outcome: str, now: int) -> Row:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.watch.clear()
        self.through.update((now + self.limit,))
        if self.event_time:
            self.handle.registerTimer(now + self.limit)
        return Row(path=path, size=size, outcome=outcome)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if self.through.exists():
            return
        for row in sorted(rows, key=lambda r: (r.at, r.size or 0)):
            now = row.at if self.event_time else timerValues.getCurrentProcessingTimeInMs()
            size, began = self.watch.get() if self.watch.exists() else (-1, now)
            if not self.watch.exists():
                self.handle.registerTimer(began + self.limit + 1)
            if row.size is not None and row.size > 0:
                if row.size == size:
                    yield self._end(key[0], size, "settled", now)
                    return
                size = row.size
            self.watch.update((size, began))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.through.exists():
            self.through.clear()
        elif self.watch.exists():
            size, _ = self.watch.get()
            now = expiredTimerInfo.getExpiryTimeInMs()
            yield self._end(key[0], max(size, 0), "timeout_with_file" if size > 0 else "timeout", now)


def settled_files(polls: DataFrame, limit_s: float = FILE_LIMIT_S, clock: str = "processing", late: str = "0 seconds") -> DataFrame:
    """path, size, outcome, once for each watched file. polls: path, ts, size (a stream; size null or 0 while there is no file).

    settled: two sizes above 0, one after another, are the same; polls without a file in between don't count. After ``limit_s`` seconds from the first poll,
    timeout_with_file where a size above 0 was seen and timeout (size 0) where none was. Then the file's state goes, but for a mark that
    lets polls of the same wait pass without a new one and expires after ``limit_s``.

    clock: processing (timers by the clock) or event (by the watermark of ts, ``late`` behind the latest). Polls without a path are one file's.
    """
    event = clock == "event"
    rows = polls.select("path", "ts", F.unix_millis("ts").alias("at"), F.col("size").cast("long").alias("size"))
    return _keyed(rows.withWatermark("ts", late) if event else rows, "path", _Settle(int(limit_s * 1000), event), "path string, size long, outcome string", clock)


class _Progress(StatefulProcessor):
    """State: the most progress so far, when it was written last, and what waits to be written."""

    def __init__(self, low: float, high: float, every: int, flush: int, keep: int) -> None:
        self.low, self.high, self.every, self.flush, self.keep = low, high, every, flush, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.most = handle.getValueState("most", "value double, written long, waits long")

    def _row(self, key: Any, value: float, at: int) -> Row:
        return Row(run_id=key[0], at=at, progress=min(self.high, max(self.low, value)))

    def _timer(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        value, written, waits = self.most.get() if self.most.exists() else (self.low, -1, -1)
        for row in sorted(rows, key=lambda r: (r.at, r.value or 0.0)):
            at = row.at
            value = value if row.value is None else max(value, row.value)
            if written < 0 or at - written >= self.every or row.force:
                written, waits = max(written, at), -1
                yield self._row(key, value, written)
            else:
                waits = max(waits, at)
        self.most.update((value, written, waits))
        self._timer(waits + self.flush if waits >= 0 else written + self.keep)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.most.exists():
            return
        value, written, waits = self.most.get()
        if waits < 0:
            self.most.clear()  # no word for long: the run is over
            return
        self.most.update((value, max(written, waits), -1))
        self._timer(max(written, waits) + self.keep)
        yield self._row(key, value, max(written, waits))


def running_progress(events: DataFrame, low: float = PROGRESS_LOW, high: float = PROGRESS_HIGH, every_ms: int = WRITE_EVERY_MS, flush_ms: int = FLUSH_AFTER_MS, keep_s: int = 900, late: str = "10 seconds") -> DataFrame:
    """run_id, ts, progress: what is written of each run's progress, which never falls back and stays within bounds.

    events: run_id, ts, value, and optionally force (a stream). An event less than ``every_ms`` after the last one written waits, unless forced; what
    waits is written once ``flush_ms`` have passed by the watermark. A run without a word for ``keep_s`` seconds is forgotten. An event
    that is late within the watermark raises the progress from then on and changes nothing written; a null value changes nothing.
    """
    forced = F.coalesce("force", F.lit(False)) if "force" in events.columns else F.lit(False)
    rows = events.select("run_id", "ts", F.unix_millis("ts").alias("at"), F.col("value").cast("double").alias("value"), forced.alias("force")).withWatermark("ts", late)
    written = _keyed(rows, "run_id", _Progress(low, high, every_ms, flush_ms, keep_s * 1000), "run_id string, at long, progress double", "event")
    return written.select("run_id", F.timestamp_millis("at").alias("ts"), "progress")


class _Gate(StatefulProcessor):
    """State: whether the run is paused, and the items that wait, in their order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paused = handle.getValueState("paused", "paused boolean")
        self.waiting = handle.getListState("waiting", "item string, at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        paused = self.paused.exists() and self.paused.get()[0]
        for row in sorted(rows, key=lambda r: (r.at, r.item is not None, r.flag or "", r.item or "")):
            if row.item is not None:
                if paused:
                    self.waiting.appendValue((row.item, row.at))
                else:
                    yield Row(run_id=key[0], item=row.item, at=row.at, released_at=row.at)
            elif row.flag == "paused":
                paused = True
            else:
                paused = False
                for item, at in list(self.waiting.get()) if self.waiting.exists() else []:
                    yield Row(run_id=key[0], item=item, at=at, released_at=row.at)
                self.waiting.clear()
        if paused:
            self.paused.update((True,))
        else:
            self.paused.clear()


def gated_items(items: DataFrame, flags: DataFrame) -> DataFrame:
    """run_id, item, at, released_at: items, once their run may go on with them.

    items: run_id, item, at. flags: run_id, status, at (both streams). While a run's last flag is ``paused``, its items wait; any other flag
    lets them go, in their order, at its time. A flag comes before items of its time. A run without flags goes on, and a run that isn't paused has no state.
    """
    micros = F.coalesce(F.unix_micros("at"), F.lit(-1)).alias("at")
    none = F.lit(None).cast("string")
    both = items.select("run_id", micros, F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), none.alias("flag"))
    control = flags.select("run_id", micros, none.alias("item"), F.coalesce(F.col("status").cast("string"), F.lit("")).alias("flag"))
    out = _keyed(both.unionByName(control), "run_id", _Gate(), "run_id string, item string, at long, released_at long", "none")
    return out.select("run_id", "item", F.timestamp_micros("at").alias("at"), F.timestamp_micros("released_at").alias("released_at"))


def fold_settled(polls: list[tuple[int, int | None]], limit_ms: int = FILE_LIMIT_S * 1000) -> tuple[int, str] | None:
    """What ``settled_files`` says of one file's polls (milliseconds, size), in order; None while it waits. For tests and small logs."""
    size, began = -1, None
    for at, seen in polls:
        began = at if began is None else began
        if at > began + limit_ms:
            break
        if seen and seen > 0:
            if seen == size:
                return size, "settled"
            size = seen
    else:
        return None
    return max(size, 0), "timeout_with_file" if size > 0 else "timeout"

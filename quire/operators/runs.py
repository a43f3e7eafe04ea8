"""Job runs: latest times, stale and repeated ones, the one to show, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numbers import book_progress
from quire.functions.scan import scan

ACTIVE = ("queued", "running", "pausing")
STALE_AFTER, REPEAT_WITHIN = "15 MINUTES", "12 MINUTES"
_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"


def latest_time(*times: Column) -> Column:
    """The latest of several times; missing ones count as the epoch."""
    return F.greatest(*[F.coalesce(t, F.expr(_EPOCH)) for t in times])


def shown_time(*times: Column) -> Column:
    """The first time there is: heartbeat, then update, then creation. Not always the latest."""
    return F.coalesce(*times)


def with_stale(runs: DataFrame, as_of: Column) -> DataFrame:
    """Active runs without a sign of life for 15 minutes become stale."""
    latest = latest_time(F.col("heartbeat_at"), F.col("updated_at"), F.col("created_at"))
    late = F.col("status").isin(*ACTIVE) & (as_of - latest > F.expr(f"INTERVAL {STALE_AFTER}"))
    return runs.withColumn("status", F.when(late, "stale").otherwise(F.col("status")))


def repeated_starts(requests: DataFrame, runs: DataFrame, keys: list[str], as_of: Column, anti: bool = False) -> DataFrame:
    """Requests that an active run with the same keys, seen within 12 minutes, answers already (or, with ``anti``, the others)."""
    latest = latest_time(F.col("heartbeat_at"), F.col("updated_at"), F.col("created_at"))
    live = runs.where(F.col("status").isin(*ACTIVE) & (as_of - latest <= F.expr(f"INTERVAL {REPEAT_WITHIN}"))).select(*keys).distinct()
    return requests.join(live, keys, "left_anti" if anti else "left_semi")


def best_run(runs: DataFrame, by: list[str]) -> DataFrame:
    """The active run with most items, then the latest, then the smallest id, in each group."""
    shown = shown_time(F.col("heartbeat_at"), F.col("updated_at"), F.col("created_at"))
    live = runs.where(F.col("status").isin(*ACTIVE)).withColumn("shown_at", shown)
    rest = [c for c in live.columns if c not in by]
    whole = live.groupBy(*by, "total_items", "shown_at").agg(F.min_by(F.struct(*rest), "id").alias("r"))
    return whole.groupBy(*by).agg(F.max_by("r", F.struct("total_items", "shown_at")).alias("r")).select(*by, "r.*")


def run_for_project(runs: DataFrame, project: str | None) -> DataFrame:
    """The run to show: of this project and active, else of this project, else (without a project) active, else the newest."""
    mine = F.lit(False) if project is None else F.col("project_path") == project
    active = F.col("status").isin(*ACTIVE)
    rank = F.when(mine & active, 0).when(mine, 1).when(active & F.lit(project is None), 2).otherwise(3)
    return runs.withColumn("rank", rank).orderBy("rank", F.desc("id")).limit(1).drop("rank")


def recent_runs(runs: DataFrame, most: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(most)


def to_resume(image_runs: DataFrame, book_runs: DataFrame, as_of: Column, most: int = 0) -> DataFrame:
    """The newest active image runs seen within 15 minutes, with the book run they belong to; none unless ``most`` is set."""
    latest = latest_time(F.col("heartbeat_at"), F.col("updated_at"), F.col("created_at"))
    live = image_runs.where(F.col("status").isin(*ACTIVE)).withColumn("latest", latest).where(as_of - F.col("latest") <= F.expr(f"INTERVAL {STALE_AFTER}"))
    newest = live.orderBy(F.desc("latest"), "id").limit(most)
    linked = book_runs.select(F.col("image_run_id").alias("id"), F.col("id").alias("book_run_id"))
    return newest.join(linked, "id", "left")


def latest_state(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row of each run: an upsert as one grouped maximum."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def monotone_progress(events: DataFrame, key: str, order: list[str], value: str, low: int = 5, high: int = 17) -> DataFrame:
    """Progress that never falls back and stays within bounds. A run of any number of events is folded in pieces."""
    rows = scan(events, [key], order, progress=("max", F.col(value).cast("double")))
    return rows.withColumn("progress", F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), "progress")))


def runnable_items(items: DataFrame, flags: DataFrame) -> DataFrame:
    """Items that their run goes on with: those before which the run's last flag isn't ``paused``. An item before any flag goes on.

    items: run_id, item, at. flags: run_id, status, at. A flag at the time of an item comes before it. Both are sorted together, in pieces of a run.
    """
    both = items.select("run_id", "item", "at", F.lit(None).cast("string").alias("flag"), F.lit(1).alias("part")).unionByName(flags.select("run_id", F.lit(None).cast(items.schema["item"].dataType).alias("item"), "at", F.col("status").alias("flag"), F.lit(0).alias("part")))
    rows = scan(both, ["run_id"], ["at", "part", "flag", "item"], last_flag=("last", F.col("flag")))
    return rows.where("part = 1 AND NOT (last_flag <=> 'paused')").select("run_id", "item", "at")


def settle_outcomes(polls: DataFrame, limit: str = "12 MINUTES") -> DataFrame:
    """path, size, outcome of files that were watched by polls (path, ts, size; null or 0 without a file), as the stream ``settled_files`` says by event time.

    settled: two sizes above 0, one after another, are the same within the limit from the first poll; else, at the first poll after it, timeout_with_file
    with the last size above 0, or timeout without one. Files that still wait have no row.
    """
    seen = F.when(F.col("size") > 0, F.col("size").cast("long"))
    rows = scan(polls.select("path", "ts", seen.alias("size")), ["path"], ["ts", "size"], before=("previous", F.col("size")), began=("min", F.col("ts")))
    over = F.col("ts") > F.col("began") + F.expr(f"INTERVAL {limit}")
    outcome = F.when(over, F.when(F.col("before").isNotNull(), "timeout_with_file").otherwise("timeout")).when(F.col("size") == F.col("before"), "settled")
    told = rows.withColumn("outcome", outcome).where("outcome IS NOT NULL").withColumn("size", F.coalesce(F.when(F.col("outcome") == "settled", F.col("size")).otherwise(F.col("before")), F.lit(0).cast("long")))
    return told.groupBy("path").agg(F.min_by(F.struct("size", "outcome"), F.struct("ts", F.col("outcome") == "settled")).alias("o")).select("path", "o.size", "o.outcome")


def handed_on(events: DataFrame, links: DataFrame) -> DataFrame:
    """What book runs take on from events of their image runs: book_run_id, ts, status, progress.

    events: run_id, ts, status, progress. links: image_run_id, book_run_id. A run that is superseded or stale hands on nothing. Works on streams too.
    """
    rows = events.where("NOT coalesce(status IN ('superseded', 'stale'), false)").join(links, F.col("run_id") == F.col("image_run_id"))
    return rows.select("book_run_id", "ts", *_book_state(F.col("status"), F.col("progress")))


def _book_state(status: Column, progress: Column) -> list[Column]:
    done = status.isin("completed", "failed")
    state = F.when(status == "completed", "ready_for_revision").when(status == "failed", "failed").otherwise("drawing")
    return [state.alias("status"), F.when(F.coalesce(done, F.lit(False)), F.lit(100).cast("long")).otherwise(book_progress(F.coalesce(progress, F.lit(0)))).alias("progress")]


def request_states(events: DataFrame) -> DataFrame:
    """id, status, created_at, updated_at of change requests: queued until an event says otherwise; the last one stands. events: id, status (null when filed), at."""
    return events.groupBy("id").agg(F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("at"))), F.lit("queued")).alias("status"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def artifact_summary(files: DataFrame) -> DataFrame:
    """Number of files, of text pages, the newest time, and whether key artifacts are there, by run. files: run_id, path, mtime."""
    has = lambda name: F.max(F.when(F.col("path").endswith(name), True).otherwise(False))
    return files.groupBy("run_id").agg(F.count("*").alias("files"), F.count_if(F.col("path").rlike(r"(?i)\.(?:md|txt)$")).alias("text_files"), F.max("mtime").alias("latest"), has("extracted.txt").alias("has_text"), has("page-audit.json").alias("has_audit"))

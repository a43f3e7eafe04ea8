"""Image work queues: items, priorities, imports, redraws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scan import scan

# Places in the queue, and the order of file types.
CHARACTER_WAITING, CHARACTER_READY, FIRST_PAGE = 10, 90, 30
RASTER_TYPES = ("png", "jpg", "jpeg", "webp")


def pending_pages(pages: DataFrame, provider: str = "local") -> DataFrame:
    """Pages of this provider whose image isn't ready; no status counts as not ready."""
    return pages.where((F.col("image_provider") == provider) & ~F.col("image_status").eqNullSafe("ready"))


def work_queue(people: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, seq, type, id, status, priority: characters and pending pages, most urgent first, in their own order where equal.

    people: doc_id, rank, id, reference_status. pages: doc_id, page_number, spread_id (pending ones only).
    """
    cast = people.select("doc_id", F.lit("character").alias("type"), "id", F.col("reference_status").alias("status"), F.when(F.col("reference_status") == "ready", CHARACTER_READY).otherwise(CHARACTER_WAITING).cast("long").alias("priority"), F.lit(0).alias("part"), F.col("rank").cast("long").alias("place"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")).cast("long")
    leaves = pages.select("doc_id", F.lit("spread").alias("type"), F.col("spread_id").alias("id"), F.lit("needs_generation").alias("status"), (place - 1 + FIRST_PAGE).alias("priority"), F.lit(1).alias("part"), place.alias("place"))
    both = cast.unionByName(leaves)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("priority", "part", "place"))
    return both.select("doc_id", seq.cast("long").alias("seq"), "type", "id", "status", "priority")


def pending_items(queue: DataFrame) -> DataFrame:
    return queue.where("NOT (status <=> 'ready')")


def find_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages whose spread_id is among ``ids``, once each however often they are asked for."""
    return pages.join(ids.select("spread_id"), "spread_id", "left_semi")


def queue_counts(queue: DataFrame) -> DataFrame:
    ready = F.count_if(F.col("status") == "ready")
    return queue.groupBy("doc_id", "type").agg(F.count("*").alias("items"), ready.alias("ready"), (F.count("*") - ready).alias("pending"))


def next_item(queue: DataFrame) -> DataFrame:
    """The most urgent item that isn't ready, for each document."""
    return pending_items(queue).groupBy("doc_id").agg(F.min_by(F.struct("type", "id", "priority"), "seq").alias("n")).select("doc_id", "n.*")


def newest_files(files: DataFrame, most: int) -> DataFrame:
    """The newest files (path, mtime), oldest first; ``at`` is their place."""
    top = files.orderBy(F.desc("mtime"), "path").limit(most)
    return top.withColumn("at", F.row_number().over(Window.orderBy("mtime", F.desc("path"))).cast("long"))


def import_by_rank(queue: DataFrame, files: DataFrame) -> DataFrame:
    """The n-th pending item of each document with its n-th oldest file; ``enough`` tells whether there were files for all.

    files: doc_id, path, mtime, and are the newest as many as items wait.
    """
    items = pending_items(queue).withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")))
    waits = items.groupBy("doc_id").agg(F.count("*").alias("n"))
    newest = files.withColumn("newness", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mtime"), "path"))).join(waits, "doc_id").where("newness <= n")
    newest = newest.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("newness"))))
    have = newest.groupBy("doc_id").agg(F.count("*").alias("n_files"))
    return items.join(newest.select("doc_id", "at", "path"), ["doc_id", "at"], "left").join(waits, "doc_id").join(have, "doc_id", "left").select("doc_id", "at", "type", "id", "path", (F.coalesce("n_files", F.lit(0)) >= F.col("n")).alias("enough"))


def best_raster(pages: DataFrame, files: DataFrame) -> DataFrame:
    """For each page its file (target, path) whose type comes first; null without one."""
    kind = F.lower(F.substring_index("path", ".", -1))
    rank = F.array_position(F.array(*map(F.lit, RASTER_TYPES)), kind)
    found = files.withColumn("rank", rank).where("rank > 0").groupBy("target").agg(F.min_by("path", "rank").alias("raster"))
    return pages.join(found, "target", "left")


def fresh_for_redraw(mtime: Column, requested: Column) -> Column:
    """Whether a file is at most a second older than the request; an unreadable request time counts as satisfied."""
    asked = F.try_to_timestamp(requested)
    return F.coalesce(mtime >= asked - F.expr("INTERVAL 1 SECOND"), F.lit(True))


def mark_redraw(pages: DataFrame, ids: DataFrame, reason: str, at: Column) -> DataFrame:
    """Pages whose spread_id is in ``ids`` with image_status needs_redraw, the reason and the time."""
    rows = pages.join(ids.select("spread_id", F.lit(True).alias("hit")).distinct(), "spread_id", "left")
    hit = F.coalesce("hit", F.lit(False))
    return rows.withColumns({"image_status": F.when(hit, "needs_redraw").otherwise(F.col("image_status")), "redraw_reason": F.when(hit, reason), "requested_at": F.when(hit, at)}).drop("hit")


def imported(pages: DataFrame, checks: DataFrame) -> DataFrame:
    """Pages with the outcome of a check of their image: ready or needs_redraw. checks: spread_id, qa_status."""
    rows = pages.join(checks.select("spread_id", F.col("qa_status").alias("new_qa")), "spread_id", "left")
    return rows.withColumn("image_status", F.when(F.col("new_qa") == "basic_passed", "ready").when(F.col("new_qa").isNotNull(), "needs_redraw").otherwise(F.col("image_status"))).withColumnRenamed("new_qa", "qa_status_new")


def missing_assets(targets: DataFrame, files: DataFrame) -> DataFrame:
    return targets.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti")


def log_paths(log: Column) -> Column:
    """Distinct paths of image files named in a log, in order, without marks at their end."""
    found = F.regexp_extract_all(log, F.lit(r"(/[^\s\"'`<>]+?\.(?:png|jpe?g|webp))(?![A-Za-z0-9])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"[).,;:\]]+$", "")))


def recover_match(runs: DataFrame, files: DataFrame, slack: str = "60 SECONDS") -> DataFrame:
    """For each run the newest file of its project that is no older than its start less the slack.

    runs: run_id, project, started. files: project, path, mtime. No later bound is set, so a project's newest file answers for all
    its runs or for none; it is found by one grouped maximum, and no pair of a run and a file is made besides.
    """
    newest = files.where("mtime IS NOT NULL").groupBy("project").agg(F.max(F.struct("mtime", "path")).alias("newest"))
    recent = F.col("newest.mtime") >= F.col("started") - F.expr(f"INTERVAL {slack}")
    return runs.join(newest, "project", "left").withColumn("path", F.when(recent, F.col("newest.path"))).drop("newest").select("run_id", *[c for c in runs.columns if c != "run_id"], "path")


def recover_as_of(runs: DataFrame, files: DataFrame, slack: str = "60 SECONDS") -> DataFrame:
    """For each run the image to recover as of a time: run_id, path, from_log; null without one.

    runs: run_id, project, started, at, log. files: project, path, mtime, size. Candidates are the files that the log names, of any project, and those of
    the run's project; each with a size above 0, written by ``at`` and no earlier than ``started`` less the slack. The newest stands, one from the log before another
    of its time, then the smallest path. A path that is listed more than once counts as it was written last by then.

    Files and runs of a project are sorted together and the newest file is carried on in pieces, so that no project's rows need one task and no run
    meets all files; paths from logs are looked up by path.
    """
    there = files.where("size > 0 AND mtime IS NOT NULL")
    newest = F.struct("mtime", F.col("path").alias("path"))
    events = there.groupBy("project", "mtime").agg(F.min("path").alias("path")).select("project", F.col("mtime").alias("at"), F.lit(0).alias("part"), newest.alias("newest"), F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"), F.lit(None).cast(runs.schema["started"].dataType).alias("started"))
    asked = runs.select("project", "at", F.lit(1).alias("part"), F.lit(None).cast(events.schema["newest"].dataType).alias("newest"), "run_id", "started")
    carried = scan(events.unionByName(asked), ["project"], ["at", "part", "run_id"], newest=("last", F.col("newest"))).where("part = 1")
    named = runs.select("run_id", F.col("at").alias("by"), F.explode(log_paths(F.col("log"))).alias("path"))
    logged = named.join(there.select("path", "mtime"), "path").where("mtime <= by").groupBy("run_id", "path").agg(F.max("mtime").alias("mtime"))
    logged = logged.groupBy("run_id").agg(F.max("mtime").alias("log_mtime"), F.min_by("path", F.struct(-F.unix_micros("mtime"), "path")).alias("log_path"))
    late = F.col("started") - F.expr(f"INTERVAL {slack}")
    both = carried.join(logged, "run_id", "left")
    from_log = (F.col("log_mtime") >= late) & F.coalesce(F.col("log_mtime") >= F.col("newest.mtime"), F.lit(True))
    path = F.when(from_log, F.col("log_path")).when(F.col("newest.mtime") >= late, F.col("newest.path"))
    return both.select("run_id", path.alias("path"), F.coalesce(from_log, F.lit(False)).alias("from_log"))

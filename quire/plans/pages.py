"""Page plans: how many pages each chapter gets, and how proposals from elsewhere are merged into a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import text as T

# Character counts from which a chapter gets one more page.
STEPS = (700, 1600, 3200, 5200, 7600, 10500, 13500)


def heuristic_count(chars: Column, paragraphs: Column, low: int = 1, high: int = 8, target: int | None = None) -> Column:
    """Pages by length and density; with a target, by characters a page."""
    if target:
        by_length = F.ceil(F.greatest(chars, F.lit(0)) / max(400, target))
        by_paragraphs = F.when(paragraphs >= 18, F.ceil(paragraphs / 42)).otherwise(0)
        return N.clamp(F.greatest(by_length, by_paragraphs, F.lit(low).cast("long")), low, high)
    count = F.lit(1) + sum((F.when(chars >= s, 1).otherwise(0) for s in STEPS), F.lit(0))
    count = count + F.when((paragraphs >= 24) & (chars >= 2600), 1).otherwise(0) + F.when((paragraphs >= 42) & (chars >= 5200), 1).otherwise(0)
    return N.clamp(count, low, high)


def heuristic_reason(chars: Column, paragraphs: Column, pages: Column, target: int | None = None) -> Column:
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    if target:
        return text(f"完整覆盖模式按约 {target} 字/页规划；本章 ", chars, " chars, ", paragraphs, " paragraphs，拆为 ", pages, " 页。")
    long = text("章节较长且段落较多（", chars, " chars, ", paragraphs, " paragraphs），需要 ", pages, " 页承接节奏。")
    return F.when(pages <= 1, "短章或过渡章，1 页足够保留主要画面。").when(pages >= 6, long).otherwise(text("按文本长度和场景密度规划为 ", pages, " 页。"))


def plan_chapters(chapters: DataFrame, mode: str = "coverage", count: int = 3, target: int = 1800, low: int | None = None, high: int | None = None) -> DataFrame:
    """``chapters`` (char_count, paragraph_count) with spread_count and reason. mode: fixed, heuristic or coverage."""
    chars, paras = F.coalesce("char_count", F.lit(0)), F.coalesce("paragraph_count", F.lit(0))
    if mode == "fixed":
        pages = N.spread_count(F.lit(count), 3, low or 1, high or 8)
        reason = F.concat(F.lit("Manual setting uses "), pages.cast("string"), F.lit(" pages for this chapter."))
    elif mode == "heuristic":
        pages = heuristic_count(chars, paras, low or 1, high or 8)
        reason = heuristic_reason(chars, paras, pages)
    else:
        pages = heuristic_count(chars, paras, low or 2, high or 60, target)
        reason = heuristic_reason(chars, paras, pages, target)
    return chapters.withColumn("spread_count", pages).withColumn("reason", reason)


def chapter_sketches(chapters: DataFrame) -> DataFrame:
    """What a planner is told of each chapter: its counts, opening and closing. chapters: doc_id, chapter_idx, chapter_id, title, text, char_count, paragraph_count."""
    closing = F.right(T.text(F.col("text")), F.lit(420))
    return chapters.select("doc_id", "chapter_idx", "chapter_id", "title", "char_count", "paragraph_count", T.clip(F.col("text"), 300, "…").alias("opening"), T.clip(closing, 260, "…").alias("closing"))


def plan_by_shard(chapters: DataFrame, proposals: DataFrame, size: int = 4, low: int = 1, high: int = 8) -> DataFrame:
    """Proposed page counts of chapters in shards of ``size``, heuristic ones where nothing valid is proposed; ``fell_back`` tells where a shard had no answer.

    chapters: doc_id, chapter_idx, chapter_id, char_count, paragraph_count. proposals: doc_id, shard, pos (from 0, within the shard's answer), chapter_index,
    chapter_id, spread_count (all three text) and of shards that were answered. A chapter gets the first proposal of its shard with its index, else the first with its id,
    else the one at its place within the shard. A count that is no number, or none, is the heuristic one.
    """
    heuristic = heuristic_count(F.col("char_count"), F.col("paragraph_count"), low, high)
    rows = chapters.withColumns({"shard": F.floor(F.col("chapter_idx") / size).cast("long"), "place": (F.col("chapter_idx") % size).cast("long")})
    number = F.trim("chapter_index").try_cast("double")
    said = proposals.select("doc_id", "shard", F.col("pos").cast("long").alias("place"), F.when(number == F.floor(number), number.cast("long")).alias("chapter_idx"), F.nullif("chapter_id", F.lit("")).alias("chapter_id"), F.struct("spread_count").alias("said"))
    found, keys = rows, ["doc_id", "shard"]
    for n, by in enumerate(("chapter_idx", "chapter_id", "place")):
        first = said.where(F.col(by).isNotNull()).groupBy(*keys, by).agg(F.min_by("said", "place").alias(f"said_{n}"))
        found = found.join(first, [*keys, by], "left")
    answered = said.select(*keys).distinct().withColumn("answered", F.lit(True))
    found = found.join(answered, keys, "left")
    pages = N.spread_count(F.coalesce("said_0", "said_1", "said_2")["spread_count"], 3, low, high, heuristic)
    return found.select(*chapters.columns, "shard", F.when(F.col("answered"), pages).otherwise(heuristic).alias("spread_count"), F.col("answered").isNull().alias("fell_back"))


def plan_mode(option: Column, has_provider: Column) -> Column:
    """What a page count option asks for: full-coverage, fixed, auto, or heuristic where no provider answers."""
    blank = F.trim(F.coalesce(option.cast("string"), F.lit(""))) == ""
    return F.when(blank | N.is_full_coverage(option), "full-coverage").when(~N.is_auto(option), "fixed").when(has_provider, "auto").otherwise("heuristic")


def plan_totals(plan: DataFrame, *by: str) -> DataFrame:
    """Total and average pages by group; the average has two decimals."""
    total = F.coalesce(F.sum("spread_count"), F.lit(0))
    average = F.when(F.count("*") > 0, N.half_up(total / F.count("*"), 2)).otherwise(0.0)
    return plan.groupBy(*by).agg(F.count("*").alias("chapter_count"), total.cast("long").alias("total_spread_count"), average.alias("average_spreads"))


def once(rows: DataFrame, keys: list[str], order: str, policy: str) -> DataFrame:
    """One row for each key: the first or the last by ``order``."""
    by = F.col(order).asc() if policy == "first" else F.col(order).desc()
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("rn = 1").drop("rn")


def merge_proposals(chapters: DataFrame, proposals: DataFrame, policy: str = "last", low: int = 1, high: int = 8, fallback: Column | None = None) -> DataFrame:
    """Chapters with the page counts proposed for them, by index, else by id, else by place.

    chapters: doc_id, chapter_idx, chapter_id. proposals: doc_id, pos, chapter_index, chapter_id, spread_count and reason, all text but doc_id and pos.
    Of several proposals with one key the first or last stands, as ``policy`` says. A null index counts as 0 under ``last``.
    """
    number = F.trim(F.col("chapter_index")).try_cast("double")
    index = F.when(F.col("chapter_index").isNull(), F.lit(0.0) if policy == "last" else F.lit(None).cast("double")).otherwise(number)
    said = proposals.select("doc_id", "pos", F.when(index == F.floor(index), index.cast("long")).alias("p_index"), F.nullif("chapter_id", F.lit("")).alias("p_id"), F.struct("spread_count", "reason").alias("p"))
    by_index = once(said.where("p_index is not null"), ["doc_id", "p_index"], "pos", policy).select("doc_id", F.col("p_index").alias("chapter_idx"), F.col("p").alias("by_index"))
    by_id = once(said.where("p_id is not null"), ["doc_id", "p_id"], "pos", policy).select("doc_id", F.col("p_id").alias("chapter_id"), F.col("p").alias("by_id"))
    by_place = said.select("doc_id", F.col("pos").alias("chapter_idx"), F.col("p").alias("by_place"))
    joined = chapters.join(by_index, ["doc_id", "chapter_idx"], "left").join(by_id, ["doc_id", "chapter_id"], "left").join(by_place, ["doc_id", "chapter_idx"], "left")
    found = F.coalesce("by_index", "by_id", "by_place")
    pages = N.spread_count(found["spread_count"], 3, low, high)
    if fallback is not None:
        pages = F.when(found["spread_count"].isNull(), fallback).otherwise(pages)
    reason = F.trim(F.coalesce(F.nullif(found["reason"], F.lit("")), F.concat(F.lit("Planned "), pages.cast("string"), F.lit(" pages."))))
    return joined.withColumn("spread_count", pages).withColumn("reason", reason).drop("by_index", "by_id", "by_place")

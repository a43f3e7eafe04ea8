"""Captions and corrections merged into pages under stated precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.rows import numbered
from quire.plans.pages import once

# The style presets; the first is the default.
STYLES = (
    ("warm-watercolor", "gentle watercolor picture book, soft pencil linework, warm daylight, tactile paper grain", "storybook eye-level composition with clear silhouettes"),
    ("ink-collage", "ink and paper collage picture book, bold cut-paper shapes, expressive texture, crisp silhouettes", "flat theatrical stage composition with playful depth layers"),
)
ADAPT_CLIPS = {"caption": 180, "source_excerpt": 260, "source_passage": 420}


def with_style(rows: DataFrame, column: str = "style") -> DataFrame:
    """``rows`` with style_name, art_direction and camera of their preset; the default for an unknown one."""
    table = {name: F.struct(F.lit(name).alias("style_name"), F.lit(art).alias("art_direction"), F.lit(camera).alias("camera")) for name, art, camera in STYLES}
    found = F.lit(None)
    for name, preset in table.items():
        found = F.when(F.col(column) == name, preset).otherwise(found)
    chosen = F.coalesce(found, table[STYLES[0][0]])
    return rows.withColumn("preset", chosen).select(*rows.columns, "preset.*")


def caption_lines(caption: Column, profile: Column, source: Column) -> Column:
    """array of (language, label, text, source, needs_translation): the source language's line is filled, others wait."""
    targets = F.array_distinct(F.array_compact(F.when(profile["bilingual"], F.array(profile["primary"], profile["secondary"])).otherwise(F.array(F.coalesce(profile["primary"], source)))))
    return F.transform(targets, lambda t: F.struct(t.alias("language"), T.language_name(t).alias("label"), F.when(t == source, caption).otherwise("").alias("text"), F.when(t == source, "source").otherwise("pending_translation").alias("source"), (t != source).alias("needs_translation")))


def apply_corrections(pages: DataFrame, corrections: DataFrame, reason: str = "ocr_caption_corrected", limit: int = 180) -> DataFrame:
    """Pages with the last correction of each: new caption, the first original kept, and the image marked for redrawing.

    pages: spread_id, caption, original_caption (null before the first revision), image_status. corrections: pos, id, caption. Blank captions correct nothing.
    """
    clean = corrections.withColumn("new_caption", T.clip_polished(F.col("caption"), limit)).where("new_caption <> '' and id is not null")
    last = once(clean, ["id"], "pos", "last").select(F.col("id").alias("spread_id"), "new_caption")
    rows = pages.join(last, "spread_id", "left")
    hit = F.col("new_caption").isNotNull()
    return rows.select(
        *[c for c in pages.columns if c not in ("caption", "original_caption", "image_status")],
        F.coalesce("new_caption", "caption").alias("caption"), F.when(hit, F.coalesce("original_caption", "caption")).otherwise(F.col("original_caption")).alias("original_caption"),
        F.when(hit, "needs_redraw").otherwise(F.col("image_status")).alias("image_status"), F.when(hit, reason).alias("redraw_reason"), hit.alias("corrected"),
    )


def relabel_captions(pages: DataFrame, lines: DataFrame, languages: list[str], source: Column) -> DataFrame:
    """A line for each page and language: what is there already, else the caption in its own language, else pending.

    lines: spread_id, language, text. The languages are a short list, exploded beside each page.
    """
    wanted = pages.select("spread_id", "caption", source.alias("source_language"), F.posexplode(F.array(*map(F.lit, dict.fromkeys(languages)))).alias("pos", "language"))
    have = lines.where("coalesce(text, '') <> ''").select("spread_id", "language", F.col("text").alias("have")).dropDuplicates(["spread_id", "language"])
    rows = wanted.join(have, ["spread_id", "language"], "left")
    own = F.col("language") == F.col("source_language")
    return rows.select("spread_id", "pos", "language", T.language_name(F.col("language")).alias("label"), F.when(own, F.col("caption")).otherwise(F.coalesce("have", F.lit(""))).alias("text"), F.when(own, "source").when(F.col("have").isNotNull(), "translated").otherwise("pending_translation").alias("source"), (~own & F.col("have").isNull()).alias("needs_translation"))


def pending_translations(lines: DataFrame) -> DataFrame:
    """Lines that wait: flagged and blank, or deferred."""
    return lines.where((F.col("needs_translation") & (T.trim(T.text(F.col("text"))) == "")) | (F.col("source") == "deferred_translation"))


def apply_translations(lines: DataFrame, translations: DataFrame) -> DataFrame:
    """Lines with the last translation by page and language code. translations: pos, spread_id, language, text."""
    said = translations.select("pos", "spread_id", T.language_code(F.col("language")).alias("language"), T.trim(T.text(F.col("text"))).alias("new_text")).where("language <> '' and new_text <> ''")
    rows = lines.join(once(said, ["spread_id", "language"], "pos", "last").drop("pos"), ["spread_id", "language"], "left")
    hit = F.col("new_text").isNotNull() & (F.col("source") != "source")
    return rows.select("spread_id", "pos", "language", "label", F.when(hit, F.col("new_text")).otherwise(F.col("text")).alias("text"), F.when(hit, "translated").otherwise(F.col("source")).alias("source"), (F.col("needs_translation") & ~hit).alias("needs_translation"))


def refresh_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """After a caption changed: its source line follows, and all its other lines wait again. pages: spread_id, caption, corrected."""
    rows = lines.join(pages.select("spread_id", "caption", "corrected"), "spread_id", "left")
    hit, own = F.coalesce("corrected", F.lit(False)), F.col("source") == "source"
    return rows.select("spread_id", "pos", "language", "label", F.when(hit & own, F.col("caption")).when(hit, "").otherwise(F.col("text")).alias("text"), F.when(hit & ~own, "pending_translation").otherwise(F.col("source")).alias("source"), F.when(hit, ~own).otherwise(F.col("needs_translation")).alias("needs_translation"))


def reset_deferred(lines: DataFrame) -> DataFrame:
    """Deferred lines wait again, without text."""
    late = F.col("source") == "deferred_translation"
    return lines.withColumn("text", F.when(late, "").otherwise(F.col("text"))).withColumn("needs_translation", late | F.col("needs_translation")).withColumn("source", F.when(late, "pending_translation").otherwise(F.col("source")))


def line_arrays(lines: DataFrame) -> DataFrame:
    """spread_id and its lines in order."""
    return lines.groupBy("spread_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "language", "label", "text", "source", "needs_translation"))), lambda x: x.dropFields("pos")).alias("lines"))


def localisation_status(batches: DataFrame) -> DataFrame:
    """completed, partial or failed by document, from batches (doc_id, ok)."""
    return batches.groupBy("doc_id").agg(F.count("*").alias("batches"), F.count_if("ok").alias("done")).withColumn("status", F.when(F.col("done") == F.col("batches"), "completed").when(F.col("done") > 0, "partial").otherwise("failed"))


def adaptation_candidates(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Pages with what an adaptation is to read, clipped; a missing passage falls back to the excerpt, that to the caption."""
    first = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit(""))
    out = pages.select("doc_id", "spread_id", "page_number", T.clip(first("caption"), ADAPT_CLIPS["caption"], "…").alias("caption"), T.clip(first("source_excerpt", "caption"), ADAPT_CLIPS["source_excerpt"], "…").alias("source_excerpt"), T.clip(first("source_passage", "source_excerpt", "caption"), ADAPT_CLIPS["source_passage"], "…").alias("source_passage"))
    return out if most is None else out.orderBy("doc_id", "page_number").limit(most)


def polish_candidates(pages: DataFrame) -> DataFrame:
    """Pages whose captions came from OCR, clipped for correction. pages: doc_id, spread_id, chapter_id, chapter_title, caption, source_excerpt, scene_prompt."""
    return pages.select("doc_id", "spread_id", "chapter_id", F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), T.clip(T.text(F.col("caption")), 260, "…").alias("caption"), T.clip(T.text(F.col("source_excerpt")), 900, "…").alias("source_excerpt"), T.clip(T.scene_text(F.col("scene_prompt")), 900, "…").alias("scene_text"))


def is_polished(source_format: Column, method: Column, engine: Column, ocr_status: Column) -> Column:
    """Whether captions are to be polished: a PDF whose text came from OCR."""
    how = F.lower(F.coalesce(F.nullif(T.text(method), F.lit("")), T.text(engine)))
    return (T.text(source_format) == "pdf") & ((T.text(ocr_status) == "ok") | how.rlike("ocr|vision|mineru"))


def is_adapted(source_format: Column, method: Column, engine: Column, ocr_status: Column, n_pages: Column) -> Column:
    """Whether captions are to be adapted from the source: a known format with pages, and none that is polished."""
    return ~is_polished(source_format, method, engine, ocr_status) & F.lower(T.text(source_format)).isin("epub", "txt", "text", "md", "markdown", "pdf") & (F.coalesce(n_pages, F.lit(0)) > 0)


def batches(rows: DataFrame, size: int, order: list[str], by: list[str]) -> DataFrame:
    """``rows`` with the number of their batch of ``size``, from 0, within each group. The first column of ``order`` is a whole number."""
    return numbered(rows, by, order, "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def chapter_narrative(pages: DataFrame) -> DataFrame:
    """Captions of each chapter joined in order, clipped."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "caption"))), lambda x: x["caption"]), " ")
    return pages.groupBy("doc_id", "chapter_idx").agg(T.clip(joined, 420, "…").alias("summary"))


def image_fingerprint(pages: DataFrame) -> DataFrame:
    """A digest of each document's image states, to tell whether a change touched any. pages: spread_id, page_number, asset_path, image_status."""
    return pages.groupBy("doc_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("page_number", "spread_id", "asset_path", "image_status")))), 256).alias("fingerprint"))


def fingerprints(pages: DataFrame, of: list[str]) -> dict[str, DataFrame]:
    """Digests of the columns ``of`` by page (doc_id, chapter_idx, spread_id), by chapter and by book, each of a level made of those below it.

    A chapter's digest is the number and the exclusive or of its pages' digests, which hold their ids, and so is a book's of its chapters': no list of pages is made.
    """
    said = F.sha2(F.to_json(F.struct("spread_id", *of), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    page = pages.select("doc_id", "chapter_idx", "spread_id", said.alias("digest"))
    levels = {"page": page}
    for name, by, key in (("chapter", ["doc_id", "chapter_idx"], "chapter_idx"), ("book", ["doc_id"], "doc_id")):
        below = levels["page" if name == "chapter" else "chapter"]
        summed = below.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(half(1)).alias("a"), F.bit_xor(half(17)).alias("b"))
        levels[name] = summed.select(*by, F.sha2(F.concat_ws(":", F.col(key).cast("string"), "n", "a", "b"), 256).alias("digest"))
    return levels


def changed_pages(old: DataFrame, new: DataFrame, of: list[str]) -> DataFrame:
    """doc_id, chapter_idx, spread_id, change: pages that were added, removed or changed (in the columns ``of``) between two versions, by levels of digests.

    Only chapters of books that differ are compared, and only pages of chapters that differ. Both versions have one row for each page; a page that moves to
    another chapter is removed from one and added to the other.
    """
    was, now = fingerprints(old, of), fingerprints(new, of)

    def differing(level: str, by: list[str], within: DataFrame | None, on: list[str]) -> DataFrame:
        sides = []
        for version, name in ((was, "old_digest"), (now, "new_digest")):
            rows = version[level].withColumnRenamed("digest", name)
            sides.append(rows if within is None else rows.join(within, on, "left_semi"))
        return sides[0].join(sides[1], by, "full").where("NOT old_digest <=> new_digest")

    books = differing("book", ["doc_id"], None, []).select("doc_id")
    chapters = differing("chapter", ["doc_id", "chapter_idx"], books, ["doc_id"]).select("doc_id", "chapter_idx")
    pages = differing("page", ["doc_id", "chapter_idx", "spread_id"], chapters, ["doc_id", "chapter_idx"])
    change = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").otherwise("changed")
    return pages.select("doc_id", "chapter_idx", "spread_id", change.alias("change"))

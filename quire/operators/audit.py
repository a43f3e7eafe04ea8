"""Page audits, import scores, lint rules and reviews of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.numbers import half_up, half_up_int


def content_pages(items: DataFrame) -> DataFrame:
    """Blocks of a layout engine (doc_id, pos, page_idx text, text, bbox) by page; a page that is no number counts as 0."""
    page = F.trim("page_idx").try_cast("double")
    page = F.when(page.isNull() | F.isnan(page) | (F.abs(page) == float("inf")), 0).otherwise(page).cast("int")
    rows = items.withColumn("page_index", page).withColumn("t", T.trim(T.text(F.col("text"))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("pos", "t")))), lambda x: x["t"]), "\n")
    grouped = rows.groupBy("doc_id", "page_index").agg(F.count("*").alias("block_count"), F.count_if(F.size("bbox") >= 4).alias("bbox_count"), joined.alias("page_text"))
    return grouped.select("doc_id", "page_index", F.length("page_text").cast("long").alias("char_count"), F.size(F.filter(F.split("page_text", "\n"), lambda x: x != "")).cast("long").alias("line_count"), F.lit(None).cast("double").alias("confidence"), "block_count", "bbox_count", T.clip(F.col("page_text"), 220).alias("text_preview"))


def content_text(items: DataFrame) -> DataFrame:
    """doc_id, text of all blocks in order, and page_count (largest number of a page, plus one)."""
    rows = items.withColumn("t", T.trim(T.text(F.col("text")))).withColumn("p", F.trim("page_idx").try_cast("double"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("pos", "t")))), lambda x: x["t"]), "\n\n")
    return rows.groupBy("doc_id").agg(joined.alias("text"), (F.max(F.when(F.abs(F.col("p")) < float("inf"), F.col("p"))) + 1).cast("long").alias("page_count"))


def audit_pages(pages: DataFrame) -> DataFrame:
    """Pages with page_number, warnings and status. pages: char_count, confidence, block_count, bbox_count; error (text) is optional."""
    own = F.array(F.col("error")) if "error" in pages.columns else F.array(F.lit(None).cast("string"))
    flags = F.array(
        F.when(F.col("char_count") == 0, "empty_text"),
        F.when((F.col("char_count") > 0) & (F.col("char_count") < 24), "sparse_text"),
        F.when(F.col("confidence") < 0.6, "low_ocr_confidence"),
        F.when((F.col("block_count") > 0) & (F.col("bbox_count") == 0), "missing_bboxes"),
    )
    rows = pages.withColumn("page_number", F.col("page_index") + 1).withColumn("warnings", F.array_compact(F.concat(own, flags)))
    return rows.withColumn("status", F.when(F.array_contains("warnings", "empty_text"), "empty").when(F.size("warnings") > 0, "review").otherwise("ok"))


def audit_summary(pages: DataFrame, has_boxes: bool = True) -> DataFrame:
    """Coverage, sizes and weak pages by document, over audited pages."""
    n, blocks = F.count("*"), F.sum("block_count")
    chars, boxes = F.sum("char_count"), F.sum("bbox_count")
    covered = F.count_if(F.col("char_count") > 0)
    return pages.groupBy("doc_id").agg(
        n.alias("page_count"), covered.alias("pages_with_text"), half_up(covered / F.greatest(n, F.lit(1)), 3).alias("text_coverage_ratio"), half_up_int(chars / F.greatest(n, F.lit(1))).alias("average_chars_per_page"),
        chars.alias("total_text_chars"), blocks.alias("total_blocks"), boxes.alias("total_bboxes"), F.when(blocks > 0, half_up(boxes / blocks, 3)).otherwise(F.lit(0.0 if has_boxes else None).cast("double")).alias("bbox_coverage_ratio"),
        F.count_if(F.col("status") != "ok").alias("weak_pages"), F.count_if(F.array_contains("warnings", "low_ocr_confidence")).alias("low_confidence_pages"), F.array_sort(F.flatten(F.collect_list("warnings"))).alias("page_warnings"),
    )


def import_quality(rows: DataFrame) -> DataFrame:
    """``rows`` with score, level and stop_before_drawing.

    rows: text_chars, page_count, text_coverage_ratio, average_chars_per_page, bbox_coverage_ratio, chapter_confidence, warnings, garbled.
    """
    share = lambda c, most: half_up_int(F.least(F.lit(1.0), c) * most)
    average = F.coalesce(F.nullif("average_chars_per_page", F.lit(0)), F.when(F.col("page_count") > 0, F.col("text_chars") / F.col("page_count")).otherwise(F.col("text_chars")))
    coverage = F.coalesce("text_coverage_ratio", F.when(F.col("text_chars") > 0, 1.0).otherwise(0.0))
    score = F.least(F.lit(30), share(F.col("text_chars") / 1200, 30)) + share(coverage, 25) + share(F.coalesce("chapter_confidence", F.lit(0.0)), 20)
    score = score + F.when(F.col("bbox_coverage_ratio").isNull(), 8).otherwise(share(F.col("bbox_coverage_ratio"), 15)) + share(average / 80, 10)
    score = score - F.least(F.lit(18), F.size(F.array_distinct("warnings")) * 3) - F.when(F.col("garbled"), 35).otherwise(0)
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"))
    return rows.withColumn("level", F.when(F.col("score") >= 78, "high").when(F.col("score") >= 55, "medium").otherwise("low")).withColumn("stop_before_drawing", (F.col("score") < 55) | F.col("garbled"))


def recommendations(score: Column, garbled: Column, weak_pages: Column, boxes: Column, from_layout: Column, chapters: Column) -> Column:
    """What to do about an import, in order."""
    notes = F.array_compact(
        F.array(
            F.when(garbled, "Re-run import with OCR; native PDF text appears garbled."),
            F.when(score < 55, "Review import before drawing; extracted text or chapter split looks weak."),
            F.when(weak_pages > 0, "Open page audit and inspect sparse or low-confidence pages."),
            F.when((F.coalesce(boxes, F.lit(1.0)) < 0.7) & from_layout, "Re-run with image analysis if image-heavy pages need layout grounding."),
            F.when(chapters <= 1, "Provide a chapter map for long books without clear chapter headings."),
        )
    )
    return F.when(F.size(notes) == 0, F.array(F.lit("Import is ready for story planning and image prompts."))).otherwise(notes)


def is_weak_text(text: Column, pages: Column, with_text: Column, least: int = 120, expected: Column | None = None) -> Column:
    """Whether natively extracted text is too poor to use."""
    n = F.length(T.text(text))
    many = F.coalesce(pages, F.lit(0)) >= 4
    return (n == 0) | (n < least) | T.quality(text, expected)["garbled_likely"] | (many & (F.coalesce(with_text, F.lit(0)) > 0) & (with_text / pages < 0.6)) | (many & (n / pages < 24))


def layout_engine(text: Column, weak: Column, pages: Column, with_text: Column, prefer: Column, enabled: Column) -> Column:
    """The layout engine to route to and why, struct(engine, reason); null for none."""
    average = F.when(pages > 0, F.length(text) / pages).otherwise(0.0)
    pick = lambda engine, reason: F.struct(F.lit(engine).alias("engine"), F.lit(reason).alias("reason"))
    routed = (
        F.when((F.length(text) == 0) & pages.between(1, 3), pick("vlm", "native_text_empty"))
        .when(F.length(text) == 0, pick("hybrid", "native_text_empty"))
        .when((pages >= 4) & (with_text / pages < 0.6), pick("hybrid", "many_pages_without_native_text"))
        .when((average > 0) & (average < 40), pick("hybrid", "native_text_sparse"))
        .when(prefer, pick("hybrid", "prefer_layout_requested"))
    )
    return F.when((enabled | prefer) & (weak | prefer), routed)


def image_quality(width: Column, height: Column, refs: Column | None = None) -> Column:
    """struct(status, blocking_issues, ratio): readable, about 3:2, and at least 1024 by 680."""
    ratio = F.when((width > 0) & (height > 0), width / height).otherwise(0.0)
    issues = F.array_compact(
        F.array(
            F.when(F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0)) == 0, "unreadable_dimensions"),
            F.when(~((ratio > 0) & (F.abs(ratio - 1.5) <= 0.08)), "wrong_aspect_ratio"),
            F.when(~((F.coalesce(width, F.lit(0)) >= 1024) & (F.coalesce(height, F.lit(0)) >= 680)), "too_small"),
        )
    )
    notes = F.lit(None).cast("string") if refs is None else F.when(F.size(refs) == 0, "no recurring character refs on this spread")
    return F.struct(F.when(F.size(issues) > 0, "failed").otherwise("basic_passed").alias("status"), issues.alias("blocking_issues"), half_up(ratio, 2).alias("ratio"), notes.alias("warning"))


# ---- rules over whole plans -------------------------------------------------------------------------------------------


def duplicates(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows whose keys came before in this order, with the name of the first row that had them; of rows equal in keys and order, one is first.

    The first row of a key comes from a grouped minimum, so copies are combined before they meet; keys are compared by 128 bits of their digest, and
    whole texts stay where they are.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"}), 256)
    place = F.struct(*order)
    marked = rows.withColumns({"dup_key": F.left(digest, F.lit(32)), "dup_at": place})
    firsts = marked.groupBy("dup_key").agg(F.min_by(F.struct(F.col("dup_at").alias("dup_at_first"), F.col(name).alias("first_id")), "dup_at").alias("dup_first"), F.count("*").alias("dup_n"))
    # only keys that came more than once are looked up: of a column that is never repeated, none
    again = firsts.where("dup_n > 1").select("dup_key", "dup_first.dup_at_first", "dup_first.first_id")
    alike = F.row_number().over(Window.partitionBy("dup_key", "dup_at").orderBy("dup_at"))
    return marked.join(again, "dup_key").withColumn("dup_n", alike).where((F.col("dup_at") > F.col("dup_at_first")) | (F.col("dup_n") > 1)).drop("dup_key", "dup_at", "dup_n", "dup_at_first")


def repeated_captions(pages: DataFrame) -> DataFrame:
    keyed = pages.withColumn("caption_key", T.review_key(F.col("caption")))
    return duplicates(keyed, ["doc_id", "caption_key"], ["page_number"], "spread_id").select("doc_id", "spread_id", "first_id", "page_number")


def review_plan(pages: DataFrame, people: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """One row for each document: status blocked, review or ready, and the counts behind it.

    pages: doc_id, spread_id, page_number, caption, source_excerpt, char_count, character_refs. people: doc_id, id. stops: doc_id of imports not to draw from.
    """
    last = F.max(F.struct("page_number", "source_excerpt"))
    by_caption = pages.groupBy("doc_id", T.review_key(F.col("caption")).alias("caption_key")).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("source_excerpt", F.lit("")) == "").alias("no_excerpt"), F.count_if(F.length("caption") > 100).alias("long"), F.count_if(F.col("char_count") > 3600).alias("high"),
        F.count_if(F.size("character_refs") < 1).alias("nobody"), last.alias("last"),
    )
    # a second, small step: a document's captions, of which a long one has many, were counted apart
    found = by_caption.groupBy("doc_id").agg(
        F.sum("n").alias("spread_count"), F.sum(F.col("n") - 1).alias("duplicate_captions"), F.sum("no_excerpt").alias("without_excerpt"), F.sum("long").alias("long_captions"), F.sum("high").alias("high_density"),
        F.sum("nobody").alias("without_characters"), (F.coalesce(F.max("last")["source_excerpt"], F.lit("")) == "").cast("long").alias("weak_closing"),
    )
    cast = people.groupBy("doc_id").agg(F.count_distinct("id").alias("n_people"))
    found = found.join(cast, "doc_id", "left").withColumn("without_characters", F.when(F.col("n_people") > 1, F.col("without_characters")).otherwise(0)).drop("n_people")
    blocked = F.col("without_excerpt") > 0
    if stops is not None:
        found = found.join(stops.select("doc_id", F.lit(True).alias("stop")).distinct(), "doc_id", "left")
        blocked = blocked | F.coalesce("stop", F.lit(False))
    noted = F.col("duplicate_captions") + F.col("long_captions") + F.col("high_density") + F.col("without_characters") + F.col("weak_closing")
    return found.withColumn("status", F.when(blocked, "blocked").when(noted > 0, "review").otherwise("ready")).drop("stop")


def lint(projects: DataFrame, people: DataFrame, chapters: DataFrame, pages: DataFrame, version: str = "0.1.0") -> DataFrame:
    """doc_id, severity, path, message: a row for each broken rule.

    projects: doc_id, schema_version, title, source_file, art_direction, import_stop, import_level, planning_status, character_status, character_pending.
    people: doc_id, pos, id, name, anchors, prompt_path. chapters: doc_id, chapter_idx, chapter_id, title, anchors, summary.
    pages: doc_id, chapter_idx, spread_idx, spread_id, caption, reader_caption, source_excerpt, scene_prompt, layout, asset_path, image_status, qa_status, anchors.
    Each rule set is one pass that explodes what it finds, so the tables are read once.
    """
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    word = lambda p: F.lit(p) if isinstance(p, str) else p

    def rules(rows: DataFrame, path: Column, *tests) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(s).alias("severity"), F.concat(path, F.lit(p)).alias("path"), word(m).alias("message"))) for t, s, p, m in tests]))
        return rows.select("doc_id", F.explode(found).alias("r")).select("doc_id", "r.*")

    with_chapters = chapters.select("doc_id").distinct().withColumn("has_chapters", F.lit(True))
    heads = rules(
        projects.join(with_chapters, "doc_id", "left"), F.lit(""),
        (F.coalesce("schema_version", F.lit("")) != version, "warning", "schemaVersion", F.concat(F.lit("Unexpected schemaVersion: "), F.coalesce(F.nullif("schema_version", F.lit("")), F.lit("missing")))),
        (none("title"), "error", "book.title", "is required"), (none("source_file"), "warning", "book.sourceFile", "is missing"), (none("art_direction"), "warning", "styleBible.artDirection", "is missing"),
        (F.col("import_stop"), "warning", "source.importQuality", F.concat(F.lit("is "), F.coalesce("import_level", F.lit("low")), F.lit("; review import before drawing"))),
        (F.col("planning_status") == "blocked", "error", "planningReview.status", "is blocked"), (F.col("planning_status") == "review", "warning", "planningReview.status", "is review"),
        (F.col("character_status") == "fallback", "warning", "characterReview.status", "is fallback"),
        ((F.coalesce("character_status", F.lit("")) != "fallback") & ((F.col("character_status") == "review") | (F.col("character_pending") > 0)), "warning", "characterReview", "has candidates to inspect"),
        (F.col("has_chapters").isNull(), "error", "chapters", "must contain at least one chapter"),
    )
    at = lambda name, i: F.concat(F.lit(f"{name}["), F.col(i).cast("string"), F.lit("]"))
    cast = rules(people, at("characters", "pos"), (none("id"), "error", ".id", "is required"), (none("name"), "warning", ".name", "is missing"), (empty("anchors"), "warning", ".visualAnchors", "is empty; character continuity is weak"), (none("prompt_path"), "warning", ".reference.promptPath", "is missing"))
    with_pages = pages.select("doc_id", "chapter_idx").distinct().withColumn("has_pages", F.lit(True))
    parts = rules(chapters.join(with_pages, ["doc_id", "chapter_idx"], "left"), at("chapters", "chapter_idx"), (none("chapter_id"), "error", ".id", "is required"), (none("title"), "warning", ".title", "is missing"), (empty("anchors"), "warning", ".sourceAnchors", "is empty; chapter traceability is weak"), (none("summary"), "warning", ".summary", "is missing"), (F.col("has_pages").isNull(), "error", ".spreads", "must contain at least one spread"))
    leaves = rules(
        pages, F.concat(at("chapters", "chapter_idx"), F.lit("."), at("spreads", "spread_idx")),
        (none("spread_id"), "error", ".id", "is required"), (none("caption"), "warning", ".caption", "is missing"), (none("reader_caption"), "warning", ".readerCaption", "is missing"), (none("source_excerpt"), "warning", ".sourceExcerpt", "is missing"),
        (F.length("caption") > 180, "warning", ".caption", "is long for a picture-book page"), (none("scene_prompt"), "error", ".scenePrompt", "is required"), (none("layout"), "warning", ".layout", "is missing"),
        (none("asset_path"), "warning", ".image.assetPath", "is missing"), ((F.col("image_status") == "ready") & none("qa_status"), "warning", ".image.qa", "is missing for a ready image"), (empty("anchors"), "warning", ".sourceAnchors", "is empty"),
    )
    ids = people.select("doc_id", F.lit(0).alias("a"), F.col("pos").alias("b"), F.lit(0).alias("c"), "id").unionByName(chapters.select("doc_id", F.lit(1).alias("a"), F.col("chapter_idx").alias("b"), F.lit(-1).alias("c"), F.col("chapter_id").alias("id"))).unionByName(pages.select("doc_id", F.lit(1).alias("a"), F.col("chapter_idx").alias("b"), F.col("spread_idx").alias("c"), F.col("spread_id").alias("id")))
    ids = ids.repartition("doc_id", "id")  # stated, as Spark 4.1 may take the union for dealt out by doc_id where its parts are, which it isn't
    twice = duplicates(ids.where("coalesce(id, '') <> ''"), ["doc_id", "id"], ["a", "b", "c"], "id").select("doc_id", F.lit("error").alias("severity"), F.lit("id").alias("path"), F.concat(F.lit("Duplicate id: "), F.col("id")).alias("message"))
    return heads.unionByName(cast).unionByName(parts).unionByName(leaves).unionByName(twice)


def lint_verdict(projects: DataFrame, found: DataFrame) -> DataFrame:
    counts = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return projects.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["errors", "warnings"]).withColumn("valid", F.col("errors") == 0)


def project_summary(pages: DataFrame, people: DataFrame) -> DataFrame:
    """Counts of chapters, pages, images and references by document. pages: chapter_idx, asset_path, image_status, qa_status. people: reference_status."""
    ready = F.count_if(F.col("image_status") == "ready")
    done = pages.groupBy("doc_id").agg(F.count_distinct("chapter_idx").alias("chapter_count"), F.count("*").alias("spread_count"), F.count_if(F.coalesce("asset_path", F.lit("")) != "").alias("image_count"), ready.alias("ready_image_count"), F.greatest(F.lit(0), F.count("*") - ready).alias("pending_image_count"), F.count_if(F.col("qa_status") == "basic_passed").alias("qa_passed_count"), F.count_if(F.col("image_status") == "needs_redraw").alias("needs_redraw_count"))
    cast = people.groupBy("doc_id").agg(F.count("*").alias("character_count"), F.count_if(F.col("reference_status") == "ready").alias("ready_character_count"))
    return done.join(cast, "doc_id", "left").fillna(0, ["character_count", "ready_character_count"])

"""Expressions against small plain models, and fixed results of whole chains."""

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import numbers as N
from quire.functions import text as T
from quire.operators import audit, entities, merge, segments, work
from quire.plans import pages as P
from quire.sources import readers, sinks

WORDS = "alder birch cedar Dogwood elm fir Ginkgo hazel ironwood juniper".split()


def prose(r, n):
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ", ", ". ", "! ", ".\n\n"]) for _ in range(n)).strip()


def model_slices(s, n):
    return [x for x in (s[i : i + n].strip() for i in range(0, len(s), n)) if x]


def model_long(p, target):
    import regex

    if len(p) <= target * 1.15:
        return [p]
    parts = [s for s in (x.strip() for x in regex.split(r"(?<=[.!?。！？][”’\"']?)\s+", p)) if s]
    if len(parts) <= 1:
        return model_slices(p, target)
    out, now, n = [], [], 0
    for s in parts:
        if now and n + len(s) > target:
            out.append(" ".join(now))
            now, n = [], 0
        if len(s) > target * 1.25:
            if now:
                out.append(" ".join(now))
                now, n = [], 0
            out += model_slices(s, target)
        else:
            now.append(s)
            n += len(s)
    return out + ([" ".join(now)] if now else [])


def model_segments(text, count):
    import re

    raw = [x for x in (p.strip() for p in re.split(r"\n{2,}", text)) if x]
    first = max(1, -(-sum(map(len, raw)) // count))
    parts = [x for p in raw for x in model_long(p, first)]
    if len(parts) > count:
        target, groups, now, n = max(1, -(-sum(map(len, parts)) // count)), [], [], 0
        for i, p in enumerate(parts):
            keep = len(parts) - i <= count - len(groups) - 1
            over = now and n + len(p) > target and abs(target - n) <= abs(target - n - len(p))
            if over and not keep and len(groups) < count - 1:
                groups.append("\n\n".join(now))
                now, n = [], 0
            now.append(p)
            n += len(p)
        parts = groups + ["\n\n".join(now)]
    parts = parts or [""]
    return (parts + [parts[-1]] * count)[:count]


def test_page_segments(spark):
    r = random.Random(3)
    rows = [(i, prose(r, r.randrange(0, 260)), r.randrange(1, 9)) for i in range(70)] + [(100, None, 3), (101, "x" * 900, 4), (102, "", 2)]
    got = {x.doc_id: x.segments for x in segments.page_segments(spark.createDataFrame(rows, "doc_id long, text string, spread_count long")).collect()}
    for i, text, n in rows:
        assert got[i] == model_segments(text or "", n), i


def test_pages_are_numbered_without_gaps(spark):
    r = random.Random(5)
    rows = [(d, c, f"ch-0{c + 1}", 1, prose(r, 80), r.randrange(1, 5)) for d in range(4) for c in range(3)]
    pages = segments.spreads(spark.createDataFrame(rows, "doc_id long, chapter_idx int, chapter_id string, anchor_line int, text string, spread_count long")).collect()
    for d in range(4):
        mine = sorted((p.chapter_idx, p.spread_idx, p.page_number) for p in pages if p.doc_id == d)
        assert [p[2] for p in mine] == list(range(1, len(mine) + 1)) and len(mine) == sum(r[5] for r in rows if r[0] == d)
        assert {p.visual_intent for p in pages if p.doc_id == d and p.spread_idx == 0} == {"establishing"}


def test_wrap_and_clip(spark):
    row = spark.range(1).select(T.wrap(F.lit("one three five seventeen a b"), 10).alias("w"), T.clip(F.lit("  a  b c  "), 9).alias("c"), T.clip(F.lit("abcdef ghij"), 8).alias("d"), N.half_up(F.lit(1.005), 2).alias("h")).first()
    assert row.w == ["one three", "five", "seventeen", "a b"] and row.c == "a b c" and row.d == "abcdef..." and row.h == 1.0


def test_headings_rules():
    finder = segments.HeadingFinder(["Chapter 1", "Chapter 2.", "", "The Door", "PART TWO", "An Easy Title", "7", "SHORT BUT CAPITAL", "text"])
    assert finder.heading(0, False) is None
    assert finder.heading(1, False) == (1, "Chapter 2. The Door", 4)
    assert finder.heading(4, False) is None and finder.heading(4, True) == (4, "PART TWO An Easy Title", 6)
    assert finder.heading(6, False) == (6, "7 SHORT BUT CAPITAL", 8)


def test_coarse_map_is_ignored(spark):
    text = "PART ONE\n1\nTHE FIRST CLEAR LESSON\n" + "Long body. " * 1500 + "\n2\nTHE SECOND CLEAR LESSON\n" + "More body. " * 1500
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    maps = spark.createDataFrame([(1, 0, "a", 1, 3, "epub-section"), (1, 1, "b", 4, 9, "epub-section")], "doc_id long, pos int, title string, start_line int, end_line int, method string")
    got = segments.split_chapters(docs, maps).orderBy("chapter_idx").collect()
    assert [c.title for c in got] == ["Chapter 1: THE FIRST CLEAR LESSON", "Chapter 2: THE SECOND CLEAR LESSON"]
    plain = segments.split_chapters(docs, maps.withColumn("method", F.lit("manual"))).orderBy("chapter_idx").collect()
    assert [c.split_method for c in plain] == ["chapter_map"] * 2
    report = segments.chapter_report(segments.split_chapters(docs)).first()
    assert (report.method, report.confidence, report.chapter_count) == ("heading", 0.92, 2)


def test_known_cast_and_references(spark):
    story = "Alice followed the White Rabbit. The Hatter laughed, and the Cheshire Cat smiled. Alice said no. " * 3
    guide = "In New York people read. Let people think. For Carnegie the work was new. New York again. Let it be. For now Carnegie."
    docs = spark.createDataFrame([(1, "Tale", story), (2, "Guide", guide)], "doc_id long, title string, text string")
    reviewed = entities.review(docs).cache()
    names = {(r.doc_id, r["name"]): r for r in reviewed.collect()}
    for name in ("Alice", "White Rabbit", "Hatter", "Cheshire Cat"):
        assert names[1, name].status == "approved"
    assert not any(r.status == "approved" for (d, n), r in names.items() if d == 2 and n in ("New", "York", "New York", "For", "Let"))
    assert sum(r.status == "rejected" for (d, _), r in names.items() if d == 2) >= 2
    people = entities.characters(docs, reviewed).cache()
    assert {r.id for r in people.where("doc_id = 1").collect()} >= {"alice", "white-rabbit"}
    lines = spark.createDataFrame([(1, "a", "Alice was beginning to think."), (1, "b", "The KING arrived.")], "doc_id long, spread_id string, source_passage string")
    king = spark.createDataFrame([(1, 1, "king", "King", ["King"])], "doc_id long, rank int, id string, name string, aliases array<string>")
    assert {r.spread_id: r.character_refs for r in entities.references(lines, king).collect()} == {"a": [], "b": ["king"]}
    summary = {r.doc_id: r for r in entities.review_summary(docs, reviewed, disabled=F.col("doc_id") == 1).collect()}
    assert summary[1].status == "not_used" and summary[1].approved_count == 0 and summary[2].status in ("fallback", "ready", "review")


def test_context_score():
    assert entities.context_score("Mira", "Mira said yes. Then Mira ran.") == 4
    assert entities.context_score("Mira", "Mirabel said.") == 0
    assert entities.context_score("Carroll", "Dr. Carroll met.") == 3


def test_garbled_pair(spark):
    bad = "\\|" * 40 + " x" * 300
    got = spark.createDataFrame([(bad, "zh"), ("A clean English sentence that is read by all of them.", "en"), ("abcd efgh " * 80, "chinese")], "t string, l string").select(T.quality(F.col("t"), F.col("l"))["garbled_likely"].alias("g")).collect()
    assert [r.g for r in got] == [True, False, True]


def png(w, h):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", w, h)


def test_images(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 680, 1024) + b"\x00" * 8
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X" + b"\x0a\x00\x00\x00" + b"\x00" * 4 + (1535).to_bytes(3, "little") + (1023).to_bytes(3, "little")
    files = spark.createDataFrame([("p", png(1536, 1024)), ("j", jpeg), ("w", webp), ("n", b"zz")], "path string, content binary")
    got = {r.path: (r.format, r.width, r.height) for r in readers.image_files(files).collect()}
    assert got == {"p": ("png", 1536, 1024), "j": ("jpeg", 1024, 680), "w": ("webp", 1536, 1024), "n": ("unknown", 0, 0)}
    checks = {r.path: r.c for r in readers.image_files(files).select("path", audit.image_quality(F.col("width"), F.col("height")).alias("c")).collect()}
    assert checks["p"].status == "basic_passed" and checks["n"].blocking_issues == ["unreadable_dimensions", "wrong_aspect_ratio", "too_small"]


def test_sources(spark, tmp_path):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", "<x>no story here at all, really none</x>")
        z.writestr("OEBPS/toc.xhtml", "<h1>Contents</h1><p>a list of the chapters of the book</p>")
        for i in (10, 2):
            z.writestr(f"OEBPS/chapter-{i}.xhtml", f"<html><title>t</title><h1>Story {i}</h1><p>{'It went on &amp; on. ' * 200}</p></html>")
    (tmp_path / "b.epub").write_bytes(book.getvalue())
    (tmp_path / "a.txt").write_text("﻿Hello\r\nworld  \n\n\n\n\n\nend", encoding="utf-8")
    (tmp_path / "empty.md").write_text("  ")
    (tmp_path / "x.docx").write_text("?")
    documents, errors = readers.read_documents(spark, str(tmp_path))
    got = {r.doc_id.rsplit("/", 1)[1]: r.text for r in documents.collect()}
    assert sorted(got) == ["a.txt", "b.epub"] and got["a.txt"] == "Hello\nworld\n\n\nend"
    assert got["b.epub"].index("Story 2") < got["b.epub"].index("Story 10") and "list of the chapters" not in got["b.epub"] and "on & on" in got["b.epub"]
    assert {r.doc_id.rsplit("/", 1)[1] for r in errors.collect()} == {"empty.md", "x.docx"}
    assert readers.list_files(spark, str(tmp_path), "*.txt").count() == 1
    (tmp_path / "map.json").write_text('{"method": "manual", "chapters": [{"title": "A", "startLine": 1, "endLine": 2}, {"start": 3}]}')
    assert [(r.pos, r.title, r.start_line, r.end_line) for r in readers.read_chapter_maps(spark, str(tmp_path / "map.json")).orderBy("pos").collect()] == [(0, "A", 1, 2), (1, None, 3, None)]


def test_section_lines_and_extraction(spark):
    s = spark.createDataFrame([("b", 0, "T", "T\nx"), ("b", 1, "U", "y")], "doc_id string, section_idx int, title string, text string")
    assert [(r.start_line, r.end_line) for r in readers.section_lines(s).orderBy("section_idx").collect()] == [(1, 2), (4, 6)]
    tries = spark.createDataFrame([(1, 0, "native", "abc", True), (1, 1, "ocr", "abcdef", True), (2, 0, "native", "x", True), (2, 1, "layout", "y", False)], "doc_id long, pos int, method string, text string, weak boolean")
    assert {r.doc_id: r.method for r in readers.choose_extraction(tries).collect()} == {1: "ocr", 2: "layout"}
    boxes = spark.createDataFrame([(1, 0, 2.0, 1.0, "c", 0.5), (1, 0, 1.0, 2.0, "b", 1.0), (1, 0, 1.0, 1.0, "a", 0.6)], "doc_id long, page_index int, y double, x double, text string, confidence double")
    assert readers.ocr_lines(boxes).select("text", "confidence").first() == ("a\nb\nc", 0.7)


def test_cache(spark):
    rows = spark.createDataFrame([("t", {"b": "1", "a": "2"}), ("t", {"a": "2", "b": "1"}), ("u", {"a": "2", "b": "1"})], "t string, o map<string,string>")
    keys = [r.k for r in rows.select(readers.cache_key("1", F.col("t").cast("binary"), F.lit(".txt"), F.col("o")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 32
    requests = spark.createDataFrame([(k,) for k in keys], "cache_key string")
    assert sorted(r.cache for r in readers.with_cache(requests, spark.createDataFrame([(keys[2], 5)], "cache_key string, n int")).collect()) == ["hit", "miss", "miss"]


def test_sinks(spark, tmp_path):
    queue = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id long, seq long, id string")
    sinks.write_jobs(queue, str(tmp_path / "jobs"))
    assert spark.read.json(str(tmp_path / "jobs")).count() == 2
    sinks.write_artifacts({"plan": queue}, str(tmp_path / "art"))
    assert spark.read.json(str(tmp_path / "art/plan")).count() == 2
    sinks.snapshot(queue, str(tmp_path / "snap"), "1")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.snapshot(queue, str(tmp_path / "snap"), "1")
    data = sinks.epub_bytes("T", [("One", "<p>x</p>")])
    assert [n for n, _ in readers.zip_entries(data)][0] == "mimetype"
    row = spark.range(1).select(sinks.ascii_fold(F.lit("Élan 漢")).alias("a"), sinks.ascii_fold(F.lit("Élan 漢"), marks="").alias("b"), sinks.placeholder_svg(F.lit("A & B"), F.lit(-3)).alias("s")).first()
    assert row.a == "E?lan ?" and row.b == "Elan ?" and "A &amp; B" in row.s


def test_work_rules(spark):
    files = spark.createDataFrame([("t1", "t1.webp"), ("t1", "t1.png"), ("t2", "t2.txt")], "target string, path string")
    pages = spark.createDataFrame([("t1",), ("t2",)], "target string")
    assert {r.target: r.raster for r in work.best_raster(pages, files).collect()} == {"t1": "t1.png", "t2": None}
    assert [r.target for r in work.missing_assets(pages, spark.createDataFrame([("t1",)], "path string")).collect()] == ["t2"]
    stamped = spark.createDataFrame([(p, i) for i, p in enumerate("abcd")], "path string, mtime int")
    assert [r.path for r in work.newest_files(stamped, 2).orderBy("at").collect()] == ["c", "d"]
    spreads = spark.createDataFrame([("a", "pending"), ("b", "pending"), ("c", "ready")], "spread_id string, image_status string")
    done = work.imported(spreads, spark.createDataFrame([("a", "basic_passed"), ("b", "failed")], "spread_id string, qa_status string"))
    assert {r.spread_id: r.image_status for r in done.collect()} == {"a": "ready", "b": "needs_redraw", "c": "ready"}
    marked = work.mark_redraw(spreads, spark.createDataFrame([("c",), ("c",)], "spread_id string"), "manual", F.current_timestamp())
    assert {r.spread_id: r.redraw_reason for r in marked.collect()} == {"a": None, "b": None, "c": "manual"}


def test_merge_rules(spark):
    lines = spark.createDataFrame([("s", 0, "en", "English", "x", "source", False), ("s", 1, "zh", "中文", "y", "deferred_translation", False)], "spread_id string, pos int, language string, label string, text string, source string, needs_translation boolean")
    assert [(r.text, r.source, r.needs_translation) for r in merge.reset_deferred(lines).orderBy("pos").collect()] == [("x", "source", False), ("", "pending_translation", True)]
    assert [x.language for x in merge.line_arrays(lines).first().lines] == ["en", "zh"]
    status = merge.localisation_status(spark.createDataFrame([(1, True), (1, False), (2, True), (3, False)], "doc_id long, ok boolean"))
    assert {r.doc_id: r.status for r in status.collect()} == {1: "partial", 2: "completed", 3: "failed"}
    pages = spark.createDataFrame([(1, 1, "a", "p", "ready"), (1, 2, "b", None, None)], "doc_id long, page_number int, spread_id string, asset_path string, image_status string")
    before, after = (merge.image_fingerprint(x).first().fingerprint for x in (pages, pages.orderBy(F.desc("page_number"))))
    assert before == after != merge.image_fingerprint(pages.withColumn("asset_path", F.lit("q"))).first().fingerprint
    profile = T.language_profile(F.lit("zh-en"), F.lit("en"))
    made = spark.range(1).select(merge.caption_lines(F.lit("Hi"), profile, F.lit("en")).alias("l")).first().l
    assert [(x.language, x.text, x.needs_translation) for x in made] == [("zh", "", True), ("en", "Hi", False)]


def test_tiny_book(spark):
    """Three short chapters: fixed, automatic and full-coverage plans."""
    text = "\n\n".join(f"# Chapter {i}: Part {i}\n\n" + "\n\n".join(f"Mira walked on and {w} smiled. " * 6 for w in ("Niko", "Grandpa", "Mira")) for i in (1, 2, 3))
    chapters = segments.split_chapters(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [c.split_method for c in chapters.collect()] == ["heading"] * 3
    for mode, most, want in (("fixed", 3, 9), ("heuristic", 3, 3), ("coverage", 3, 6)):
        assert P.plan_totals(P.plan_chapters(chapters, mode, most), "doc_id").first().total_spread_count == want
    pages = segments.spreads(P.plan_chapters(chapters, "fixed", 3))
    assert pages.count() == 9
    w = Window.partitionBy("doc_id")
    assert pages.withColumn("n", F.max("page_number").over(w)).first().n == 9

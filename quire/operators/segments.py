"""Chapters and page segments of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.rows import once

# What a heading, a contents line and a new beat look like.
_NUMERALS = "一二三四五六七八九十百千万零〇○两俩壹贰叁肆伍陆柒捌玖拾佰仟0-9"
CHAPTER = regex.compile(rf"(?i)(?:#{{1,3}}\s+.+|chapter\s+\d+[\s:.-].*|chapter\s+[ivxlcdm]+[\s:.-].*|第[{_NUMERALS}叫下卡]+[章节回].*|卷[{_NUMERALS}]+.*)")
BARE = regex.compile(rf"(?i)(?:chapter\s+(?:\d+|[ivxlcdm]+)\.?|第[{_NUMERALS}叫下卡]+[章节回]|卷[{_NUMERALS}]+)")
PART = regex.compile(r"(?i)part\s+(?:one|two|three|four|five|six|seven|eight|nine|ten|\d{1,2}|[ivxlcdm]+|(?:[a-z]\s*){2,})")
CONTENTS = regex.compile(r"(?i)(?:contents|table of contents|目录|目錄)\s*[:：]?")
TOC_LINE = regex.compile(r"(?i)\.{3,}\s*\d+\s*$|(?:^|\s)(?:page|页码)\s*\d+\s*$|/\s*(?:[ivxlcdm]+|\d{1,4})\s*$")
NOT_TITLE = regex.compile(r"(?i)principle\s+\d+|\d{1,2}\.?|part\s+")
TITLE_CASE = regex.compile("[\\p{Lu}0-9\"“‘'(-][\\p{L}\\p{N}\\s,'’“”\":;-]+")
BEAT_CUES = "later|meanwhile|at night|the next|by morning|soon|then|finally|忽然|后来|夜里|第二天|清晨|最后"
_LONGEST_HEADING, _LONGEST_TITLE = 92, 82


class HeadingFinder:
    """Headings of one text's lines: (line number from 0, title, first line of the body)."""

    def __init__(self, lines: list[str]) -> None:
        self.lines = [x.strip() for x in lines]

    def _skip_blank(self, at: int) -> int:
        while at < len(self.lines) and not self.lines[at]:
            at += 1
        return at

    @staticmethod
    def title_like(line: str, title_case: bool) -> bool:
        """Mostly capitals; or, where asked for, title case without a sentence's end."""
        if not line or len(line) > _LONGEST_TITLE or NOT_TITLE.match(line):
            return False
        letters = [c for c in line if c.isalpha()]
        if len(letters) < 4:
            return False
        if sum(c.isupper() for c in letters) / len(letters) >= 0.62:
            return True
        return title_case and not regex.search(r"[.!?。！？]$", line) and bool(TITLE_CASE.fullmatch(line))

    def title_after(self, at: int, title_case: bool = False, most: int = 4) -> tuple[str, int] | None:
        """Title lines from ``at`` on, up to two blank lines apart, and where the body starts."""
        at, found = self._skip_blank(at), []
        while len(found) < most:
            following = self._skip_blank(at)
            if following == len(self.lines) or (found and following - at > 2) or not self.title_like(self.lines[following], title_case):
                break
            found.append(self.lines[following])
            at = following + 1
        return (regex.sub(r"\s+", " ", " ".join(found)), self._skip_blank(at)) if found else None

    def heading(self, i: int, sections: bool) -> tuple[int, str, int] | None:
        line = self.lines[i]
        if CHAPTER.fullmatch(line):
            at = self._skip_blank(i + 1)
            title = self.lines[at] if at < len(self.lines) else ""
            joins = BARE.fullmatch(line) and title and len(title) <= _LONGEST_HEADING and not CHAPTER.fullmatch(title) and not TOC_LINE.search(title)
            return (i, f"{line} {title}", at + 1) if joins else (i, line, i + 1)
        if regex.fullmatch(r"\d{1,2}\.?", line) and (title := self.title_after(i + 1)):
            return i, f"{line.removesuffix('.')} {title[0]}", title[1]
        if sections and PART.fullmatch(regex.sub(r"\s+", " ", line)):
            title = self.title_after(i + 1, True, 3)
            return (i, f"{line} {title[0]}", title[1]) if title else (i, line, i + 1)
        return None

    def find(self) -> list[tuple[int, str, int]]:
        """Chapters if there are two or more, else parts. Headings inside a table of contents don't count."""
        chapters, parts = [], []
        contents = ""  # "", "open" until its first entry, then "listing" up to a blank line
        for i, line in enumerate(self.lines):
            if CONTENTS.fullmatch(line):
                contents = "open"
            elif contents and not line:
                contents = "" if contents == "listing" else contents
            elif contents and (TOC_LINE.search(line) or self.heading(i, True)):
                contents = "listing"
            elif contents != "listing" and line and len(line) <= _LONGEST_HEADING and not TOC_LINE.search(line):
                if found := self.heading(i, False):
                    chapters.append(found)
                elif found := self.heading(i, True):
                    parts.append(found)
        return chapters if len(chapters) >= 2 else parts


_HEADINGS = "array<struct<line:int,title:string,body:string>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.int32()), ("title", pa.string()), ("body", pa.string())]))
    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            lines = text.split("\n")
            found = HeadingFinder(lines).find()
            ends = [*(h[0] for h in found), len(lines)][1:]
            out.append([{"line": i + 1, "title": title, "body": "\n".join(lines[start:end]).strip()} for (i, title, start), end in zip(found, ends, strict=True)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "headings"])


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, text and the array of headings (line, title, body)."""
    return docs.select("doc_id", T.text(F.col("text")).alias("text")).mapInArrow(_find, f"{docs.select('doc_id').schema[0].simpleString().replace(':', ' ', 1)}, text string, headings {_HEADINGS}")


_NO_PLACES = "cast(array() as array<int>)"


def _joined(parts: Column, starts: Column, mark: str) -> Column:
    """Parts joined into groups that start at these places (from 0)."""
    end = lambda x, i: F.coalesce(F.get(x["starts"], i + 1), F.size(x["parts"]))
    return T.let(F.struct(parts.alias("parts"), starts.alias("starts")), lambda x: F.transform(x["starts"], lambda at, i: F.array_join(F.slice(x["parts"], at + 1, end(x, i) - at), mark)))


def _starts(items: Column, closes) -> Column:
    """Where groups start: a fold over (n: letters, i: place, and what ``closes`` looks at) that carries places and sums, no texts.

    closes(state, item): whether a group ends before the item. state: starts, n (letters of the open group).
    """
    start = F.struct(F.expr(_NO_PLACES).alias("starts"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        again = F.struct(a["starts"].alias("starts"), (a["n"] + p["n"]).alias("n"))
        return F.when((p["i"] == 0) | closes(a, p), F.struct(F.array_append(a["starts"], p["i"]).alias("starts"), p["n"].alias("n"))).otherwise(again)

    return F.aggregate(items, start, step, lambda a: a["starts"])


def pack(parts: Column, budget: int) -> Column:
    """Join parts by blank lines; a chunk closes before the part that would take it over the budget."""
    items = lambda x: F.transform(x, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i")))
    return T.let(parts, lambda x: _joined(x, _starts(items(x), lambda a, p: a["n"] + p["n"] > budget), "\n\n"))


def beats(text: Column, budget: int) -> Column:
    """Paragraphs joined into beats at cue words or once a beat is over the budget; empty with under six paragraphs or two beats."""
    items = lambda x: F.transform(x, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.rlike(f"(?i)^(?:{BEAT_CUES})").alias("cue")))
    none = F.expr("cast(array() as array<string>)")

    def found(x: Column) -> Column:
        return T.let(F.struct(x.alias("parts"), _starts(items(x), lambda a, p: p["cue"] | (a["n"] > budget)).alias("starts")), lambda y: F.when(F.size(y["starts"]) >= 2, _joined(y["parts"], y["starts"], "\n\n")).otherwise(none))

    return T.let(T.paragraphs(text), lambda x: F.when(F.size(x) >= 6, found(x)).otherwise(none))


def first_line(body: Column) -> Column:
    """The first line that isn't blank, trimmed; null without one."""
    return F.get(F.filter(F.transform(F.split(body, "\n"), T.trim), lambda x: x != ""), 0)


def line_places(docs: DataFrame) -> DataFrame:
    """doc_id, line_key, line_no: where each of a text's lines, trimmed, comes first, from 1. An index by digest, as short as the number of different lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("doc_id", "at", line_key(T.trim(F.col("line"))).alias("line_key")).groupBy("doc_id", "line_key").agg((F.min("at") + 1).cast("int").alias("line_no"))


def line_key(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), F.reverse(line)).alias("b"))


def _records(rows: DataFrame, method: Column, confidence: Column) -> DataFrame:
    number = (F.col("chapter_idx") + 1).cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return rows.select(
        "doc_id", "chapter_idx", F.concat(F.lit("ch-"), padded).alias("chapter_id"), F.coalesce("title", F.concat(F.lit("Chapter "), number)).alias("title"), "text", F.col("anchor_line").cast("int").alias("anchor_line"),
        method.alias("split_method"), confidence.alias("split_confidence"), F.length("text").cast("long").alias("char_count"), T.paragraph_count(F.col("text")).alias("paragraph_count"),
    )


def mapped_chapters(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """Chapters by given line ranges: maps (doc_id, pos, title, start_line, end_line). Ranges are clamped; empty bodies go, and their ids with them."""
    lines = F.split("text", "\n")
    start = F.greatest(F.lit(1), F.coalesce("start_line", F.lit(1)))
    end = F.least(F.size(lines), F.coalesce("end_line", F.size(lines)))
    body = T.trim(F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n"))
    rows = docs.select("doc_id", T.text(F.col("text")).alias("text")).join(maps.select("doc_id", "pos", "title", "start_line", "end_line"), "doc_id")
    rows = rows.select("doc_id", F.col("pos").cast("int").alias("chapter_idx"), F.nullif("title", F.lit("")).alias("title"), body.alias("text"), start.alias("anchor_line")).where("text <> ''")
    return _records(rows, F.lit("chapter_map"), F.lit(1.0))


def map_is_coarse(method: Column, entries: Column, chars: Column, headings_found: Column) -> Column:
    """Whether a map of book sections is to be ignored: few long entries, or far more headings than entries."""
    average = chars / entries
    return (F.lower(F.coalesce(method, F.lit(""))) == "epub-section") & (entries > 0) & (((entries <= 6) & (average > 12000)) | ((headings_found >= F.greatest(F.lit(2), entries + 2)) & (average > 6000)))


def split_chapters(docs: DataFrame, maps: DataFrame | None = None, budget: int = 4200) -> DataFrame:
    """Chapters of normalised texts: by a given map, else by two or more headings, else by beats, else by length.

    docs: doc_id, text. maps: as for ``mapped_chapters``, with method. Null texts have no chapters. Text before the first heading is left out.
    """
    found = headings(docs)
    mapped = None
    if maps is not None:
        sizes = maps.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("method", ignorenulls=True).alias("method"))
        coarse = found.join(sizes, "doc_id").where(map_is_coarse(F.col("method"), F.col("n"), F.length("text"), F.size("headings"))).select("doc_id")
        mapped = mapped_chapters(docs, maps.join(coarse, "doc_id", "left_anti"))
        found = found.join(mapped.select("doc_id").distinct(), "doc_id", "left_anti")
    by_heading = F.size("headings") >= 2
    named = F.transform("headings", lambda h: F.struct(T.clean_heading(h["title"]).alias("title"), h["body"].alias("text"), h["line"].alias("anchor_line")))
    found = once(found, beats=F.when(~by_heading, beats(F.col("text"), budget)))
    packed = F.transform(pack(F.when(F.size("beats") > 1, F.col("beats")).otherwise(T.paragraphs(F.col("text"))), budget), lambda b: F.struct(F.lit(None).cast("string").alias("title"), b.alias("text"), F.lit(None).cast("int").alias("anchor_line")))
    rows = found.select("doc_id", F.when(by_heading, "heading").when(F.size("beats") > 1, "semantic_fallback").otherwise("length_fallback").alias("method"), F.posexplode(F.when(by_heading, named).otherwise(packed)).alias("chapter_idx", "c"))
    rows = rows.select("doc_id", "method", "chapter_idx", "c.*").withColumn("line_key", F.when(F.col("method") != "heading", line_key(first_line(F.col("text")))))
    # a chunk without a heading is found again by its first line, in an index of the texts that have such chunks
    places = line_places(found.where(~by_heading).select("doc_id", "text"))
    rows = rows.join(places, ["doc_id", "line_key"], "left").withColumn("anchor_line", F.coalesce("anchor_line", "line_no", F.lit(1)))
    confidence = F.when(F.col("method") == "heading", 0.92).when(F.col("method") == "semantic_fallback", 0.62).otherwise(0.42)
    chapters = _records(rows.withColumn("split_confidence", confidence), F.col("method"), F.col("split_confidence"))
    chapters = repair_ordinals(chapters)
    return chapters if mapped is None else chapters.unionByName(mapped)


def repair_ordinals(chapters: DataFrame) -> DataFrame:
    """Set right misread Chinese chapter numbers, where at least four and 70 % of a text's headings are of that form."""
    form = F.col("title").rlike("^第.{1,6}章") & (F.col("split_method") == "heading")
    doc = Window.partitionBy("doc_id")
    many = (F.count_if(form).over(doc) >= 4) & (F.count_if(form).over(doc) / F.count("*").over(doc) >= 0.7)
    number = F.row_number().over(doc.orderBy("chapter_idx"))
    said = T.chinese_ordinal(F.col("title"))
    wrong = said.isNull() | (said != number) | F.col("title").rlike("第[叫下卡万]")
    fixed = T.trim(F.concat(F.lit("第"), T.chinese_numeral(number), F.lit("章 "), T.trim(F.regexp_replace("title", "^第.{1,6}章", ""))))
    return chapters.withColumn("title", F.when(form & many & wrong, fixed).otherwise(F.col("title")))


def chapter_report(chapters: DataFrame) -> DataFrame:
    """doc_id, method, confidence (two decimals) and count."""
    from quire.functions.numbers import half_up

    return chapters.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("split_method") == "chapter_map", "chapter_map")), F.min_by("split_method", "chapter_idx"), F.lit("unknown")).alias("method"), half_up(F.avg("split_confidence"), 2).alias("confidence"), F.count("*").alias("chapter_count"))


# ---- page segments ---------------------------------------------------------------------------------------------------


def slices(text: Column, size: Column) -> Column:
    """Fixed slices, trimmed, without blank ones."""
    at = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), size)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.filter(F.transform(at, lambda i: T.trim(F.substring(text, i, size))), lambda p: p != "")


def split_long(paragraph: Column, target: Column) -> Column:
    """A paragraph over 1.15 targets in chunks of whole sentences; a sentence over 1.25 targets in slices. 1.15 has no exact double: whole numbers are compared."""
    found = F.filter(F.transform(F.split(paragraph, "(?<=[.!?。！？][”’\"']?)\\s+"), T.trim), lambda s: s != "")
    long = lambda n: n > target * 1.25

    def cut(x: Column) -> Column:
        items = F.transform(x, lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), ((i > 0) & long(F.length(F.get(x, i - 1)))).alias("after_long")))
        starts = _starts(items, lambda a, s: s["after_long"] | long(s["n"]) | (a["n"] + s["n"] > target))
        # a long sentence is a group of its own
        piece = lambda c, at: T.let(F.get(x, at), lambda s: F.when(long(F.length(s)), slices(s, target)).otherwise(F.array(c)))
        return T.let(starts, lambda places: F.flatten(F.zip_with(_joined(x, places, " "), places, piece)))

    chunks = T.let(found, lambda sentences: F.when(F.size(sentences) <= 1, slices(paragraph, target)).otherwise(cut(sentences)))
    return F.when(paragraph == "", F.expr("cast(array() as array<string>)")).when(F.length(paragraph).cast("long") * 100 <= target.cast("long") * 115, F.array(paragraph)).otherwise(chunks)


def pad(segments: Column, count: Column) -> Column:
    """Exactly ``count`` segments: the last one again as often as needed."""
    padded = lambda x: F.slice(F.concat(x, F.array_repeat(F.element_at(x, -1), count.cast("int"))), F.lit(1), count.cast("int"))
    return T.let(segments, lambda x: F.when(F.size(x) > 0, padded(x)).otherwise(F.array_repeat(F.lit(""), count.cast("int"))))


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p))


def _target(parts: Column, count: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(_total(parts) / count).cast("int"))


def balance(parts: Column, count: Column) -> Column:
    """Up to ``count`` groups of neighbouring parts, each about as long as the others."""
    items = lambda x: F.transform(x, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i")))

    def groups(x: Column) -> Column:
        def closes(a: Column, p: Column) -> Column:
            after, done = a["n"] + p["n"], F.size(a["starts"]) - 1
            needed_later = x["size"] - p["i"] <= x["count"] - done - 1
            return (done < x["count"] - 1) & (after > x["target"]) & (F.abs(x["target"] - a["n"]) <= F.abs(x["target"] - after)) & ~needed_later

        return _joined(x["parts"], _starts(x["items"], closes), "\n\n")

    # what a step needs of the whole is worked out once, not at each step
    return T.let(F.struct(parts.alias("parts"), F.size(parts).alias("size"), _target(parts, count).alias("target"), count.alias("count"), items(parts).alias("items")), groups)


def segments_of(paragraphs: Column, count: Column) -> Column:
    """A text's paragraphs in exactly ``count`` segments."""
    cut = lambda raw: T.let(F.struct(raw.alias("raw"), _target(raw, count).alias("target")), lambda x: F.flatten(F.transform(x["raw"], lambda p: split_long(p, x["target"]))))
    grouped = lambda parts: F.when(F.size(parts) <= count, parts).otherwise(balance(parts, count))
    return pad(T.let(T.let(paragraphs, cut), grouped), count)


def page_segments(rows: DataFrame, text: str = "text", count: str = "spread_count") -> DataFrame:
    """``rows`` with ``segments``: the text in ``count`` (one at least) balanced segments."""
    cut = once(rows, parts=T.paragraphs(F.col(text)))
    return cut.withColumn("segments", segments_of(F.col("parts"), F.col(count).cast("int"))).drop("parts")


def spreads(chapters: DataFrame) -> DataFrame:
    """Pages of planned chapters (doc_id, chapter_idx, chapter_id, text, anchor_line, spread_count), numbered through each document."""
    rows = page_segments(chapters)
    rows = rows.select("doc_id", "chapter_idx", "chapter_id", "anchor_line", F.col("spread_count").cast("int").alias("n"), F.posexplode_outer("segments").alias("spread_idx", "segment"))
    number = (F.col("spread_idx") + 1).cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter_idx", "spread_idx"))
    rows = once(rows, source_excerpt=T.source_excerpt(F.col("segment"), F.col("spread_idx") + 1))
    return rows.select(
        "doc_id", "chapter_idx", "spread_idx", F.concat("chapter_id", F.lit("-sp-"), padded).alias("spread_id"), "chapter_id", page.cast("int").alias("page_number"),
        T.visual_intent(F.col("segment"), F.col("spread_idx"), F.col("n")).alias("visual_intent"), T.caption_of(F.col("source_excerpt")).alias("caption"), "source_excerpt",
        T.source_passage(F.col("segment")).alias("source_passage"), F.concat(F.lit("text:line:"), F.col("anchor_line").cast("string"), F.lit(":spread:"), number).alias("source_anchor"),
        F.length("segment").cast("long").alias("char_count"), T.paragraph_count(F.col("segment")).alias("paragraph_count"),
        F.when(F.col("spread_idx") % 2 == 0, "full-bleed-caption-bottom").otherwise("image-left-caption-right").alias("layout"),
    )


def story_arc(pages: DataFrame) -> DataFrame:
    """opening, midpoint and closing excerpts and the number of pages of each document."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    rows = pages.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    at = lambda test: F.coalesce(T.clip(F.max(F.when(test, F.col("source_excerpt"))), 160), F.lit(""))
    return rows.groupBy("doc_id").agg(at(F.col("i") == 0).alias("opening"), at(F.col("i") == F.floor(F.col("n") / 2)).alias("midpoint"), at(F.col("i") == F.col("n") - 1).alias("closing"), F.count("*").alias("scene_count"))

"""Source documents: text, EPUB, PDF where a reader is installed, JSON manifests, images.

Folders are listed and their files read by tasks (``sources.stores``), and in stores that pyarrow can't open by Spark's own readers, whose list the driver
holds, so any store that Spark knows will do; containers are opened from bytes in Arrow tasks.
"""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources import stores
from quire.sources.books import pdf_texts

TEXT_TYPES = (".txt", ".md", ".markdown")
# What marks a section of a book as no part of the story.
_MATTER_FILE = "copyright|cover|titlepage|toc|nav"
_MATTER_TITLE = "(?i)^(?:致謝|致谢|鳴謝|鸣谢|參考書目|参考书目|參考文獻|参考文献|延伸閱讀|延伸阅读|聆賞推薦|聆赏推荐|版權頁|版权页|目錄|目录)|國內.*好評|媒體.*好評|專業盛讚|专业盛赞"
_BACK_MATTER = regex.compile(r"(?i)(?:about\s+the\s+author|acknowledg(?:e)?ments?|bibliography|index|notes|other\s+books|the\s+dale\s+carnegie\s+courses?|版权页|版權頁|参考文献|參考文獻|延伸阅读|延伸閱讀)")


def _few_tasks(files: DataFrame) -> DataFrame:
    """Spark gives a task to each 32 small files; here a core has at most eight tasks."""
    return files.coalesce(stores.tasks(files.sparkSession))


def list_files(spark: SparkSession, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """path, length, mtime of files below a folder; their contents are not read."""
    found = None if any(c in pattern for c in "[{\\") else stores.files_below(spark, path)
    if found:
        named = F.lit("^" + "".join({"*": ".*", "?": "."}.get(c, regex.escape(c)) for c in pattern) + "$")
        rows = found[0].where(F.regexp_like("file_name", named)).select("path", "length", "mtime")
    else:
        rows = _few_tasks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", F.col("modificationTime").alias("mtime")))
    return rows if most is None else rows.orderBy("path").limit(most)


def _sources(spark: SparkSession, path: str):
    """doc_id (the path) and ext of all files below a path, and a function that opens those of some types: doc_id, ext, content."""
    found = stores.files_below(spark, path)
    if found:
        files = found[0].select(F.col("path").alias("doc_id"), T.extension(F.col("file_name")).alias("ext"), "place")
        return files, lambda *kinds: stores.contents(files.where(F.col("ext").isin(*kinds)), found[1])
    # by the name in the file's metadata, files of other types are left out before they are opened
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), T.extension(F.col("_metadata.file_name")).alias("ext"), "content")
    return files, lambda *kinds: _few_tasks(files.where(F.col("ext").isin(*kinds)))


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) for all files below a path: doc_id is the path; text, source_format, extraction_method.

    Files of other types, and files without text, are rows of the errors with their reason.
    """
    files, opened = _sources(spark, path)
    plain = opened(*TEXT_TYPES).select("doc_id", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.substring("ext", 2, 9).alias("source_format"), F.lit("utf8").alias("extraction_method"))
    books = epub_documents(opened(".epub")).withColumn("source_format", F.lit("epub")).withColumn("extraction_method", F.lit("epub-xhtml"))
    prints = pdf_pages(opened(".pdf")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"]), "\n\n").alias("text")).withColumn("source_format", F.lit("pdf")).withColumn("extraction_method", F.lit("native"))
    found = plain.unionByName(books).unionByName(prints).withColumn("text", T.normalize(F.col("text")))
    documents = found.where("text <> ''")
    known = [*TEXT_TYPES, ".epub", ".pdf"]
    unknown = files.where(~F.col("ext").isin(*known)).select("doc_id", F.concat(F.lit("Unsupported source type: "), F.col("ext")).alias("error"))
    empty = files.where(F.col("ext").isin(*known)).select("doc_id").join(documents.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("No text could be extracted.").alias("error"))
    return documents, unknown.unionByName(empty)


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[str, str, str]]:
        for batch in batches:
            for i in range(batch.num_rows):
                for name, body in zip_entries(batch.column(1)[i].as_py()):
                    if posixpath.splitext(name)[1].lower() in (".xhtml", ".html", ".htm", ".xml") and not name.upper().startswith("META-INF/"):
                        yield batch.column(0)[i].as_py(), name, body.decode("utf-8", "replace")

    yield from _handed_on(rows(), pa.schema([("doc_id", pa.string()), ("file", pa.string()), ("html", pa.string())]))


def _handed_on(rows: Iterator[tuple], kind: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a few MB, however many come of one file."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size >= most or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)


def zip_entries(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Stored and deflated entries of an archive; entries that can't be read are skipped. No central directory: an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            if not info.is_dir() and info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                try:
                    yield info.filename, archive.read(info)
                except (zipfile.BadZipFile, OSError, EOFError, ValueError):
                    continue


def reading_order(name: Column) -> Column:
    """Front matter last; else the first number of up to four digits in the name; else 5000."""
    low = F.lower(name)
    number = F.regexp_extract(low, "([0-9]{1,4})", 1)
    return F.when(low.rlike("nav|toc|cover|titlepage|copyright"), 10000).when(number != "", number.try_cast("int")).otherwise(5000).cast("int")


def is_matter(file: Column, title: Column) -> Column:
    return F.lower(T.trim(T.text(file))).rlike(_MATTER_FILE) | F.lower(T.trim(T.text(title))).rlike(_MATTER_TITLE)


def story_sections(sections: DataFrame) -> DataFrame:
    """Without front and back matter, if two sections and enough of the text are left; else all. sections: doc_id, file, title, text."""
    w = Window.partitionBy("doc_id")
    rows = sections.withColumn("matter", is_matter(F.col("file"), F.col("title"))).withColumn("n", F.length("text"))
    story = F.sum(F.when(~F.col("matter"), F.col("n")).otherwise(0)).over(w)
    enough = (F.count_if(~F.col("matter")).over(w) >= 2) & (story >= F.least(F.lit(5000.0), F.sum("n").over(w) * 0.35))
    return rows.withColumn("enough", enough).where("NOT enough OR NOT matter").drop("matter", "n", "enough")


def epub_sections(books: DataFrame) -> DataFrame:
    """doc_id, section_idx, file, title, text, char_count in reading order; sections under 20 letters are left out. books: doc_id, content."""
    raw = books.select("doc_id", "content").mapInArrow(_sections, "doc_id string, file string, html string")
    return ordered_sections(raw.select("doc_id", "file", T.html_title(F.col("html")).alias("title"), T.html_to_text(F.col("html")).alias("text")))


def ordered_sections(rows: DataFrame) -> DataFrame:
    """Sections (doc_id, file, title, text) of 20 letters and more, numbered in reading order."""
    rows = rows.where("length(text) >= 20")
    order = Window.partitionBy("doc_id").orderBy(reading_order(F.col("file")), F.expr("file COLLATE UNICODE"), "file")
    return rows.withColumn("section_idx", F.row_number().over(order) - 1).withColumn("char_count", F.length("text").cast("long"))


def section_lines(sections: DataFrame) -> DataFrame:
    """Sections with body (title, blank line, text) and the lines they take once joined by a blank line."""
    body = F.when(F.coalesce("title", F.lit("")) == "", F.col("text")).when(F.col("text").startswith(F.col("title")), F.col("text")).otherwise(F.concat("title", F.lit("\n\n"), "text"))
    rows = sections.withColumn("body", body).withColumn("n", F.size(F.split("body", "\n")))
    w = Window.partitionBy("doc_id").orderBy("section_idx")
    end = F.sum(F.col("n") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumn("end_line", end.cast("int")).withColumn("start_line", (F.col("end_line") - F.col("n") + 1).cast("int")).drop("n")


def trim_matter(lines: list[str]) -> tuple[int, int]:
    """First and last line (exclusive) of the story: from a heading beyond line 20, to a back matter heading in the last part."""
    from quire.operators.segments import CHAPTER, PART, HeadingFinder

    finder = HeadingFinder(lines)
    short = [i for i, x in enumerate(finder.lines) if x and len(x) <= 92]
    heads = (i for i in short if CHAPTER.fullmatch(finder.lines[i]) or PART.fullmatch(regex.sub(r"\s+", " ", finder.lines[i])) or finder.heading(i, False))
    first = next(heads, 0)
    start = first if first > 20 else 0
    earliest = max(start + 80, int(len(lines) * 0.55))
    end = next((i for i in short if i >= earliest and _BACK_MATTER.fullmatch(finder.lines[i])), len(lines))
    return start, end


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            lines = text.split("\n")
            start, end = trim_matter(lines)
            out.append("\n".join(lines[start:end]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def epub_documents(books: DataFrame) -> DataFrame:
    """doc_id, text of each book's story sections. Line numbers of sections are those of ``section_lines``, before trimming."""
    rows = section_lines(story_sections(epub_sections(books)))
    joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "body"))), lambda x: x["body"]), "\n\n").alias("text"))
    return joined.mapInArrow(_trim, "doc_id string, text string")


def _pdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc_id, i, *page) for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for i, page in enumerate(pdf_texts(content.as_py() or b""))]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "page_index", "text", "error"])


def pdf_pages(files: DataFrame) -> DataFrame:
    """doc_id, page_index, text, error of each page. files: doc_id, content."""
    return files.select("doc_id", "content").mapInArrow(_pdf, "doc_id string, page_index int, text string, error string")


def trim_books(docs: DataFrame) -> DataFrame:
    """doc_id and text of books without what comes before the first heading beyond line 20 and after a late back matter heading. docs: doc_id, text."""
    return docs.select("doc_id", T.text(F.col("text")).alias("text")).mapInArrow(_trim, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def extraction_chain(attempts: DataFrame) -> DataFrame:
    """The steps that are taken for each document and which one is used: steps follow their order until one gives text that isn't weak; later ones aren't tried.

    attempts: doc_id, pos, method, text, weak. Returned by step taken: doc_id, pos, method, status (ok, weak or empty), used. If all are weak, the longest is used.
    """
    blank = T.trim(T.text(F.col("text"))) == ""
    good = ~blank & ~F.coalesce("weak", F.lit(False))
    w = Window.partitionBy("doc_id")
    rows = attempts.withColumn("stop", F.min(F.when(good, F.col("pos"))).over(w)).where("stop IS NULL OR pos <= stop")
    longest = F.row_number().over(w.orderBy(F.desc(F.length(T.text(F.col("text")))), "pos"))
    used = F.when(F.col("stop").isNotNull(), F.col("pos") == F.col("stop")).otherwise((longest == 1) & ~blank)
    return rows.select("doc_id", "pos", "method", F.when(blank, "empty").when(good, "ok").otherwise("weak").alias("status"), used.alias("used"))


def choose_extraction(attempts: DataFrame) -> DataFrame:
    """The attempt to use for each document: the first, by order, whose text isn't weak, else the longest. attempts: doc_id, pos, method, text, weak."""
    rank = F.struct(F.col("weak").cast("int"), F.when(F.col("weak"), -F.length("text")).otherwise(F.col("pos")), "pos")
    return attempts.groupBy("doc_id").agg(F.min_by(F.struct("method", "text", "weak"), rank).alias("a"), F.count("*").alias("attempts")).select("doc_id", "a.*", "attempts")


def ocr_lines(boxes: DataFrame) -> DataFrame:
    """Pages from recognised boxes (doc_id, page_index, y, x, text, confidence): top to bottom, then left to right, and mean confidence."""
    from quire.functions.numbers import half_up

    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda b: b["text"]), "\n")
    return boxes.groupBy("doc_id", "page_index").agg(lines.alias("text"), half_up(F.avg("confidence"), 3).alias("confidence"), F.count("*").alias("line_count"))


def read_chapter_maps(spark: SparkSession, path: str) -> DataFrame:
    """Chapter maps in JSON, bare arrays or objects with chapters: doc_id (path), method, pos, title, start_line, end_line."""
    return chapter_maps(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value"))


def chapter_maps(raw: DataFrame) -> DataFrame:
    """As ``read_chapter_maps``, of maps that are there as text: doc_id, value."""
    entry = "array<struct<title:string,startLine:int,start:int,endLine:int,end:int>>"
    bare = F.ltrim("value").startswith("[")
    entries = F.when(bare, F.from_json("value", entry)).otherwise(F.from_json("value", f"chapters {entry}")["chapters"])
    rows = raw.select("doc_id", F.get_json_object("value", "$.method").alias("method"), F.posexplode(entries).alias("pos", "e"))
    return rows.select("doc_id", "method", "pos", "e.title", F.coalesce("e.startLine", "e.start").alias("start_line"), F.coalesce("e.endLine", "e.end").alias("end_line"))


def json_array(text: Column, *names: str) -> Column:
    """The array (as JSON text) of a reply: bare, or under one of the names; in a fenced block or between other words, too."""
    body = parse_loose(text)
    return F.coalesce(F.when(F.ltrim(body).startswith("["), body), *[F.get_json_object(body, f"$.{n}") for n in names])


def parse_loose(text: Column) -> Column:
    """JSON text out of a reply: all of it, else a fenced block, else the widest pair of braces; null if none of them parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    # the parser reads one value and leaves what follows: a text that stands as an array's element and as an object's value is one value and no more
    parsed = lambda before, c, after: F.try_parse_json(F.concat(F.lit(before), c, F.lit(after))).isNotNull()
    valid = lambda c: F.when(parsed("[", F.trim(c), "]") & parsed('{"v":', F.trim(c), "}"), F.trim(c))
    return F.coalesce(valid(text), valid(fenced), valid(braces))


def image_size(content: Column) -> Column:
    """struct(format, width, height) of PNG, JPEG and extended WebP bytes. PNG and WebP headers are read in expressions; JPEG needs a walk."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    little = lambda at: F.conv(F.hex(F.concat(F.substring(content, at + 2, 1), F.substring(content, at + 1, 1), F.substring(content, at, 1))), 16, 10).cast("int")
    hexed = F.hex(F.substring(content, 1, 16))
    size = lambda f, w, h: F.struct(F.lit(f).alias("format"), w.alias("width"), h.alias("height"))
    zero = F.lit(0)
    return (
        F.when((F.substring(hexed, 3, 6) == "504E47") & (F.length(content) >= 24), size("png", number(17, 4), number(21, 4)))
        .when((F.substring(hexed, 1, 8) == "52494646") & (F.substring(hexed, 17, 8) == "57454250") & (F.substring(hexed, 25, 8) == "56503858") & (F.length(content) >= 30), size("webp", little(25) + 1, little(28) + 1))
        .when((F.substring(hexed, 1, 8) == "52494646") & (F.substring(hexed, 17, 8) == "57454250"), size("webp", zero, zero))
        .otherwise(size("unknown", zero, zero))
    )


def _jpeg(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [jpeg_size(x.as_py() or b"") for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32())], names=["path", "width", "height"])


def jpeg_size(data: bytes) -> tuple[int, int]:
    """Width and height from the first frame header of types 0 to 3; (0, 0) without one."""
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xC3:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return 0, 0


def image_files(files: DataFrame) -> DataFrame:
    """path, format, width, height. files: path, content."""
    is_jpeg = F.hex(F.substring("content", 1, 2)) == "FFD8"
    plain = files.where(~is_jpeg).select("path", image_size(F.col("content")).alias("s")).select("path", "s.*")
    walked = files.where(is_jpeg).select("path", "content").mapInArrow(_jpeg, "path string, width int, height int")
    return plain.unionByName(walked.withColumn("format", F.lit("jpeg")))


def cache_key(version: str, content: Column, extension: Column, options: Column) -> Column:
    """32 hex digits that tell a source and its sorted options apart from any other. options: a map of texts."""
    ordered = F.array_sort(F.map_entries(options))
    return F.left(F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), F.sha2(content, 256).alias("source"), extension.alias("ext"), ordered.alias("options"))), 256), F.lit(32))


def with_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the cached row of their key, and hit or miss."""
    return requests.join(cache.withColumn("found", F.lit(True)), "cache_key", "left").withColumn("cache", F.when(F.col("found"), "hit").otherwise("miss")).drop("found")

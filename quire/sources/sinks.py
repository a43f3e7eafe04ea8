"""Sinks: artifacts as tables, job lines, snapshots, a review text, an EPUB container."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.numbers import hash32
from quire.functions.rows import numbered
from quire.sources import stores

LINES_A_PAGE, LINE_LETTERS = 34, 92
#: Bytes made in a task before they are handed on.
_HELD = 4 << 20


def write_artifacts(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each table as JSON lines below ``path``/name."""
    for name, table in tables.items():
        table.write.mode(mode).json(f"{path}/{name}")


def write_jobs(queue: DataFrame, path: str) -> None:
    """One JSON object a line, in order of the queue within each document."""
    queue.repartition("doc_id").sortWithinPartitions("doc_id", "seq").write.mode("overwrite").json(path)


def _text_files(where: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(where)
        known, n = set(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                folder = f"{root}/{doc_id >> 10}"
                if folder not in known:
                    store.create_dir(folder, recursive=True)
                    known.add(folder)
                # under a name that readers skip until it is whole: an attempt that is stopped leaves no half text
                held = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(held) as out:
                    out.write(text.as_py().encode() + b"\n")
                store.move(held, f"{folder}/doc_id={doc_id}.txt")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def write_texts(docs: DataFrame, path: str) -> None:
    """A file for each text (doc_id, a whole number of its own; text), ended by a line feed, below a new folder: doc_id=<id>.txt, 1024 ids to a folder.

    Each task writes its files where they stay: Spark's writer by partitions makes a folder for each and moves it twice, the second time in the driver.
    It writes to stores that pyarrow can't open.
    """
    name = stores.located(docs.sparkSession, path)[2]
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if name is None:
        rows.write.partitionBy("doc_id").text(path)
        return
    rows.mapInArrow(_text_files(name), "n long").agg(F.sum("n")).collect()


def snapshot(table: DataFrame, path: str, version: str) -> str:
    """A copy below a version of its own, before a change; an existing version is an error."""
    table.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return f"{path}/version={version}"


def ascii_fold(c: Column, marks: str = "?") -> Column:
    """Printable ASCII of the text's NFKD, at most 92 letters: each other UTF-16 unit becomes a question mark, marks of letters too; ``marks=""`` drops these."""
    plain = T.decomposed(c) if marks == "?" else F.regexp_replace(T.decomposed(c), r"\p{M}+", marks)
    return F.substring(F.regexp_replace(F.regexp_replace(plain, r"[\x{10000}-\x{10FFFF}]", "??"), r"[^\x20-\x7E]", "?"), 1, LINE_LETTERS)


def review_pages(lines: DataFrame, by: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Lines (folded to ASCII) with the page of 34 lines each stands on. ``order`` is a whole number or a struct that starts with one."""
    rows = numbered(lines, [by], [order], "review_page")
    return rows.withColumns({"line": ascii_fold(F.col("line")), "review_page": F.floor(F.col("review_page") / LINES_A_PAGE).cast("long")})


#: The palette of a drawing without a style (fixed values).
PALETTE = ("#f7ead7", "#31515f", "#d9634f", "#e0a83f", "#6aa99b")


def placeholder_colours(spread_id: Column, chapter_id: Column, palette: Column | None = None) -> Column:
    """struct(paper, accent, second): the palette's first colour, and those that the hashes of page and chapter pick; the chapter's two places on."""
    colours = F.array(*map(F.lit, PALETTE)) if palette is None else palette
    pick = lambda key, shift: F.element_at(colours, ((F.abs(hash32(T.text(key))) + shift) % F.size(colours) + 1).cast("int"))
    return F.struct(F.element_at(colours, 1).alias("paper"), pick(spread_id, 0).alias("accent"), pick(chapter_id, 2).alias("second"))


def placeholder_svg(caption: Column, spread_id: Column, chapter_id: Column | None = None, palette: Column | None = None) -> Column:
    """A stand-in for a page's picture: two areas in colours picked by the hashes of page and chapter, and the caption's first four lines."""
    colours = placeholder_colours(spread_id, spread_id if chapter_id is None else chapter_id, palette)
    rows = F.transform(F.slice(T.wrap(caption, 38), 1, 4), lambda line, i: F.concat(F.lit('<text x="96" y="'), (780 + i * 44).cast("string"), F.lit('" font-size="34">'), T.escape_xml(line), F.lit("</text>")))
    area = lambda y, height, colour: F.concat(F.lit(f'<rect x="96" y="{y}" width="1344" height="{height}" rx="32" fill="'), T.escape_xml(colour), F.lit('"/>'))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="1536" height="1024" viewBox="0 0 1536 1024" role="img" aria-label="'), T.escape_xml(caption), F.lit('"><rect width="1536" height="1024" fill="'), T.escape_xml(colours["paper"]), F.lit('"/>'))
    return F.concat(head, area(120, 280, colours["accent"]), area(420, 260, colours["second"]), F.array_join(rows, ""), F.lit("</svg>"))


def page_html(title: Column, image: Column, caption: Column) -> Column:
    return F.concat(F.lit("<section><h2>"), T.escape_xml(title), F.lit('</h2><img src="'), T.escape_xml(image), F.lit('" alt=""/><p>'), T.escape_xml(caption), F.lit("</p></section>"))


def render_books(pages: DataFrame) -> DataFrame:
    """doc_id and one HTML text of its pages in order. pages: doc_id, page_number, chapter_title, asset_path, caption."""
    part = page_html(F.col("chapter_title"), F.col("asset_path"), F.col("caption"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", part.alias("h")))), lambda x: x["h"]), "\n")
    return pages.groupBy("doc_id").agg(F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"/></head><body>\n'), body, F.lit("\n</body></html>")).alias("html"))


#: What a caption line without its text says (fixed value).
PENDING = "Translation pending"


def caption_spans(lines: Column, caption: Column, quoted) -> Column:
    """A caption's lines, each in a span with its label; a line without text says that its translation is pending, if it needs one, else the caption itself.

    lines: array<struct<language, label, text, needs_translation>>; null or empty for the caption alone. quoted: how text is escaped.
    """
    alone = F.array(F.struct(F.lit("").alias("language"), F.lit("").alias("label"), T.text(caption).alias("text"), F.lit(False).alias("needs_translation")))
    said = lambda line: F.coalesce(F.nullif(T.text(line["text"]), F.lit("")), F.when(F.coalesce(line["needs_translation"], F.lit(False)), F.lit(PENDING)).otherwise(T.text(caption)))
    label = lambda line: F.when(T.text(line["label"]) != "", F.concat(F.lit('<b class="label">'), quoted(line["label"]), F.lit("</b>"))).otherwise("")
    span = lambda line: F.concat(F.lit('<span class="line" lang="'), quoted(line["language"]), F.lit('">'), label(line), quoted(said(line)), F.lit("</span>"))
    return F.array_join(F.transform(F.when(F.size(lines) > 0, lines).otherwise(alone), span), "")


def _xml(c: Column) -> Column:
    return F.replace(T.escape_xml(c), F.lit("'"), F.lit("&apos;"))


def book_bodies(pages: DataFrame) -> DataFrame:
    """doc_id, title, n_pages and body: the XHTML of each book's pages in order.

    pages: doc_id, title, page_number, chapter_title, caption; and, if there, caption_lines (see ``caption_spans``) and image_href, the place of
    the page's picture in the container, null without one.
    """
    caption = caption_spans(F.col("caption_lines"), F.col("caption"), _xml) if "caption_lines" in pages.columns else _xml(F.col("caption"))
    figure = F.lit("")
    if "image_href" in pages.columns:
        figure = F.when(F.col("image_href").isNotNull(), F.concat(F.lit('<figure><img src="'), _xml(F.col("image_href")), F.lit('" alt="'), _xml(F.col("caption")), F.lit('"/></figure>'))).otherwise("")
    # the classes' names are fixed values of the books' style
    part = F.concat(F.lit('<section class="page">'), figure, F.lit('<p class="chapter">'), _xml(F.col("chapter_title")), F.lit('</p><p class="caption">'), caption, F.lit("</p></section>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", part.alias("h")))), lambda x: x["h"]), "")
    return pages.groupBy("doc_id").agg(F.max("title").alias("title"), F.count("*").alias("n_pages"), body.alias("body"))


def image_href(spread_id: Column, asset_path: Column) -> Column:
    """Where a page's picture stands in its book; null without a picture. Files of unknown types count as PNG."""
    kind = F.lower(F.regexp_extract(T.text(asset_path), r"\.[^./]+$", 0))
    return F.when(T.text(asset_path) != "", F.concat(F.lit("images/"), T.safe_name(spread_id), F.when(kind.isin(".png", ".jpg", ".jpeg", ".webp"), kind).otherwise(".png")))


def book_site(pages: DataFrame, language: str = "en") -> DataFrame:
    """doc_id, path, html: for each book a reader (every page with its picture or a note that it is pending), a studio (what each page still lacks) and an index of its chapters.

    pages: doc_id, title, chapter_idx, chapter_title, page_number, spread_id, caption, asset_path, image_status; and caption_lines if there.
    """
    quoted = T.escape_xml
    lines = F.col("caption_lines") if "caption_lines" in pages.columns else F.lit(None).cast("array<struct<language:string,label:string,text:string,needs_translation:boolean>>")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number, image = F.col("page_number").cast("string"), T.text(F.col("asset_path"))
    shown = F.when(image != "", text('<img src="', quoted(image), '" alt="', quoted(F.col("caption")), '">')).otherwise('<p class="missing">Image pending</p>')
    read = text('<section id="', quoted(F.col("spread_id")), '"><h2>', quoted(F.col("chapter_title")), "</h2>", shown, "<p>", caption_spans(lines, F.col("caption"), quoted), "</p><small>", number, "</small></section>")
    lacks = F.array_join(F.array_compact(F.array(F.when(image == "", "image"), F.when(T.text(F.col("caption")) == "", "caption"))), ", ")
    row = text("<tr><td>", number, "</td><td>", quoted(F.col("spread_id")), "</td><td>", quoted(F.coalesce("image_status", F.lit("missing"))), "</td><td>", lacks, "</td></tr>")
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", c.alias("h")))), lambda x: x["h"]), "")
    books = pages.groupBy("doc_id").agg(F.max("title").alias("title"), ordered(read).alias("reader"), ordered(row).alias("studio"))
    chapters = pages.groupBy("doc_id", "chapter_idx").agg(F.min_by(F.struct("chapter_title", "spread_id"), "page_number").alias("first"), F.count("*").alias("n"))
    entry = text('<li><a href="reader.html#', quoted(F.col("first.spread_id")), '">', quoted(F.col("first.chapter_title")), "</a> (", F.col("n").cast("string"), ")</li>")
    entries = chapters.select("doc_id", "chapter_idx", entry.alias("h"))
    listed = entries.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_idx", "h"))), lambda x: x["h"]), "").alias("index"))
    head = text(f'<!doctype html><html lang="{language}"><head><meta charset="utf-8"><title>', quoted(F.col("title")), "</title></head><body><h1>", quoted(F.col("title")), "</h1>")
    parts = {"reader.html": text(head, F.col("reader"), "</body></html>"), "studio.html": text(head, "<table>", F.col("studio"), "</table></body></html>"), "index.html": text(head, "<ol>", F.col("index"), "</ol></body></html>")}
    rows = F.array(*[F.struct(F.lit(path).alias("path"), html.alias("html")) for path, html in parts.items()])
    return books.join(listed, "doc_id").select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*")


def _made(batches: Iterator[pa.RecordBatch], make, name: str) -> Iterator[pa.RecordBatch]:
    """The first column and the bytes made of the others, row by row: a task holds one row's values and a few MB of what is made."""
    for batch in batches:
        held, size, first = [], 0, 0
        for i in range(batch.num_rows):
            held.append(make(*(batch.column(c)[i].as_py() for c in range(1, batch.num_columns))))
            size += len(held[-1])
            if size >= _HELD or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(held, pa.binary())], names=["doc_id", name])
                held, size, first = [], 0, i + 1


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = lambda identifier, title, language, body, images: epub_bytes(title, [(title, body)], identifier, language, [(i["href"], i["content"]) for i in images or ()])
    yield from _made(batches, make, "epub")


def epub_books(books: DataFrame, language: Column | None = None, images: DataFrame | None = None) -> DataFrame:
    """doc_id and an EPUB of each book, a row for each, made all over the cluster. books: as ``book_bodies`` returns them.

    images: doc_id, href (see ``image_href``), content; a book's pictures come to the task that makes its container, which holds them all. Without content an image is left out.
    """
    spoken = F.lit("en") if language is None else F.coalesce(language, F.lit("en"))
    rows = books.select("doc_id", F.concat(F.lit("urn:book:"), F.sha2(F.concat_ws(" ", F.col("doc_id").cast("string"), "title"), 256)).alias("identifier"), "title", spoken.alias("language"), "body")
    if images is None:
        rows = rows.withColumn("images", F.expr("cast(null as array<struct<href:string,content:binary>>)"))
    else:
        held = images.where("href IS NOT NULL AND content IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("href", "content"))).alias("images"))
        rows = rows.join(held, "doc_id", "left")
    return rows.mapInArrow(_containers, f"doc_id {books.schema['doc_id'].dataType.simpleString()}, epub binary")


_IMAGE_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp"}


def epub_bytes(title: str, chapters: list[tuple[str, str]], identifier: str = "urn:book", language: str = "en", images: list[tuple[str, bytes]] = ()) -> bytes:
    """A stored EPUB 3 with package and navigation; chapters are (title, XHTML body), images (place, content). Names and types are those of its format."""
    named = lambda x: escape(x, {'"': "&quot;"})
    files = [f"chapter-{i + 1:02d}.xhtml" for i in range(len(chapters))]
    kind = lambda name: _IMAGE_TYPES.get(name[name.rfind(".") :].lower(), "image/png")
    items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(files))
    items += "".join(f'<item id="image_{i}" href="{named(n)}" media-type="{kind(n)}"/>' for i, (n, _) in enumerate(images, 1))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(files)))
    package = (
        '<?xml version="1.0" encoding="utf-8"?><package version="3.0" unique-identifier="id" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{named(identifier)}</dc:identifier><dc:title>{named(title)}</dc:title><dc:language>{named(language)}</dc:language><meta property="dcterms:modified">2000-01-01T00:00:00Z</meta></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'
    )
    page = lambda head, body: f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{named(head)}</title></head><body>{body}</body></html>'
    entries = "".join(f'<li><a href="{n}">{named(head)}</a></li>' for n, (head, _) in zip(files, chapters, strict=True))
    container = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    parts = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", container), ("OEBPS/content.opf", package), ("OEBPS/nav.xhtml", page(title, f'<nav epub:type="toc"><ol>{entries}</ol></nav>'))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        pictures = [(f"OEBPS/{n}", content) for n, content in images]
        for name, data in [*parts, *((f"OEBPS/{n}", page(head, body)) for n, (head, body) in zip(files, chapters, strict=True)), *pictures]:
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def pdf_bytes(pages: list[list[str]]) -> bytes:
    """A PDF of plain ASCII lines, a list for each page, in the standard Helvetica."""
    quoted = lambda line: "".join(f"\\{c}" if c in "\\()" else c for c in line)
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, lines in enumerate(pages):
        # size, place and leading are fixed values of the print
        drawn = "BT /F1 12 Tf 54 740 Td 20 TL " + " T* ".join(f"({quoted(line)}) Tj" for line in lines) + " ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
        objects.append(f"<< /Length {len(drawn)} >>\nstream\n{drawn}\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n{body}\nendobj\n".encode("ascii")
    table = "".join(f"{at:010d} 00000 n \n" for at in places)
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode("ascii")
    return bytes(out)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _made(batches, pdf_bytes, "pdf")


def review_pdfs(lines: DataFrame) -> DataFrame:
    """doc_id and a PDF of each book's review lines. lines: doc_id, line_no, line."""
    pages = review_pages(lines).groupBy("doc_id", "review_page").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("text"))
    books = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("review_page", "text"))), lambda x: x["text"]).alias("pages"))
    return books.mapInArrow(_prints, f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, pdf binary")

"""Books as data sources: a partition for each file, opened where it is read; and folders of images as a stream."""

from __future__ import annotations

import io
import posixpath
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from quire.functions import text as T


@dataclass
class Book(InputPartition):
    """A file of a folder."""

    uri: str
    path: str


class _Reader(DataSourceReader):
    """A partition for each file below a folder whose name fits. Conditions on doc_id leave files out before anything is opened."""

    def __init__(self, options: dict[str, str], pattern: str, columns: list[str], read) -> None:
        self.uri, self.pattern, self.columns, self.opened = options["path"], options.get("pattern", pattern), columns, read
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("doc_id",):
                self.tests.append(f)
            else:
                yield f

    def _kept(self, path: str) -> bool:
        said = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value)}
        return all(said[type(f)](f) for f in self.tests)

    def partitions(self) -> Sequence[Book]:
        store, folder = fs.FileSystem.from_uri(self.uri)
        files = [f.path for f in store.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File]
        return [Book(self.uri, p) for p in sorted(files) if fnmatch(posixpath.basename(p).lower(), self.pattern) and self._kept(p)] or [Book(self.uri, "")]

    def read(self, partition: Book) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(partition.uri)
        with store.open_input_file(partition.path) as file:
            content = file.read()
        for row in self.opened(content):
            full = {"doc_id": partition.path, **row}
            yield pa.RecordBatch.from_pylist([{c: full[c] for c in self.columns}], pa.schema([(c, pa.int32() if c == "page_index" else pa.string()) for c in self.columns]))


class _Source(DataSource):
    known, pattern, opened = "", "", None

    def schema(self) -> str:
        """All columns, or those that the option columns names: what isn't named isn't decoded."""
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return ", ".join(c for c in self.known.split(", ") if not asked or c.split()[0] in asked)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), self.pattern, [f.name for f in schema], type(self).opened)


def _entries(content: bytes) -> Iterator[dict]:
    from quire.sources.readers import zip_entries

    for name, body in zip_entries(content):
        if posixpath.splitext(name)[1].lower() in (".xhtml", ".html", ".htm", ".xml") and not name.upper().startswith("META-INF/"):
            yield {"file": name, "html": body.decode("utf-8", "replace")}


def _pages(content: bytes) -> Iterator[dict]:
    for i, (text, error) in enumerate(pdf_texts(content)):
        yield {"page_index": i, "text": text, "error": error}


class BookEntries(_Source):
    """Format book_entries: doc_id (the path), file, html of each page of the EPUBs below a folder."""

    known, pattern, opened = "doc_id string, file string, html string", "*.epub", staticmethod(_entries)

    @classmethod
    def name(cls) -> str:
        return "book_entries"


class PrintPages(_Source):
    """Format print_pages: doc_id (the path), page_index, text, error of each page of the PDFs below a folder."""

    known, pattern, opened = "doc_id string, page_index int, text string, error string", "*.pdf", staticmethod(_pages)

    @classmethod
    def name(cls) -> str:
        return "print_pages"


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, ``spark.read.format("book_entries").load(folder)``, and let conditions reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BookEntries, PrintPages):
        spark.dataSource.register(source)


# ---- texts of PDF pages ----------------------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_ENDS = re.compile(rb"\bendobj\b|\bstream\r?\n")
_STREAM = re.compile(rb"(.*?)\r?\nendstream\b\s*(?:endobj\b)?", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|TJ|Tj|'|Td|TD|BT")
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_MEANT = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2)).decode("cp1252", "replace")

    def meant(m: re.Match) -> bytes:
        c = m.group(1)
        return _MEANT.get(c) or (bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c.endswith(b"\n") else c)

    return _ESCAPE.sub(meant, token[1:-1]).decode("cp1252", "replace")


def _shown(stream: bytes) -> str:
    """The strings that a page shows, a line feed wherever its text moves on to another line."""
    lines, line, held = [], "", ""
    for token in _SHOWN.findall(stream):
        if token[:1] in b"(<":
            held += _string(token)
        elif token in (b"Tj", b"TJ"):
            line, held = line + held, ""
        else:
            lines.append(line)
            line, held = (held, "") if token == b"'" else ("", "")
    return "\n".join([*lines, line]).strip("\n")


def _objects(content: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """Head and stream of each object by its number. What a stream shows may look like any part of a file, so nothing is looked for in it."""
    objects, at = {}, 0
    while (m := _OBJECT.search(content, at)) and (ends := _ENDS.search(content, m.end())):
        stream = None if ends[0] == b"endobj" else _STREAM.match(content, ends.end())
        objects[int(m[1])] = content[m.end() : ends.start()], stream and stream[1]
        at = (stream or ends).end()
    return objects


def pdf_texts(content: bytes) -> list[tuple[str, str | None]]:
    """(text, error) of each page of a PDF: by an installed reader, else of pages whose fonts have a byte for each letter. What can't be read is one row with its error."""
    try:
        from pypdf import PdfReader
    except ImportError:
        PdfReader = None
    try:
        if PdfReader:
            return [_extracted(page) for page in PdfReader(io.BytesIO(content)).pages]
        if not content.lstrip().startswith(b"%PDF"):
            raise ValueError("not a PDF")
        objects = _objects(content)
        heads = {n: head for n, (head, _) in sorted(objects.items())}
        of = {n for n, head in heads.items() if re.search(rb"/Type\s*/Page\b(?!s)", head)}
        order = [int(n) for head in heads.values() for kids in re.findall(rb"/Kids\s*\[(.*?)\]", head, re.S) for n in re.findall(rb"(\d+)\s+\d+\s+R", kids)]
        pages = [heads[n] for n in order if n in of] or [heads[n] for n in sorted(of)]
        if not pages:
            raise ValueError("no page can be read without a PDF reader")
        return [_plain(page, objects) for page in pages]
    except Exception as e:  # noqa: BLE001 a damaged file is a row, not an end
        return [("", str(e) or type(e).__name__)]


def _extracted(page) -> tuple[str, str | None]:
    try:
        return page.extract_text() or "", None
    except Exception as e:  # noqa: BLE001
        return "", str(e)


def _plain(page: bytes, objects: dict[int, tuple[bytes, bytes | None]]) -> tuple[str, str | None]:
    shown = []
    for n in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S) or [b"", b""])[1]):
        head, stream = objects.get(int(n), (b"", None))
        if stream is not None:
            shown.append(zlib.decompress(stream) if b"/FlateDecode" in head else stream)
    if any(b"/Identity-H" in head for head, _ in objects.values()):
        return "", "its fonts need a PDF reader"
    return _shown(b"\n".join(shown)), None


# ---- images as they come ---------------------------------------------------------------------------------------------


def arriving_images(spark: SparkSession, path: str, most: int = 24, since: str | None = None, archive: str | None = None) -> DataFrame:
    """path, length, mtime of image files as they come: a stream that takes the newest first, ``most`` at a time, each once.

    since: a time before which files don't count. archive: a folder, not below the other, to which files go once the batch after theirs is done. Contents are not read.
    """
    options = {"latestFirst": "true", "maxFilesPerTrigger": str(most), "recursiveFileLookup": "true", "pathGlobFilter": "*.{png,jpg,jpeg,webp}"}
    if archive:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    kind = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(kind).options(**options).load(path).select("path", "length", F.col("modificationTime").alias("mtime"))
    return rows if since is None else rows.where(F.col("mtime") >= F.lit(since).cast("timestamp"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, section_idx, file, title, text, char_count of the EPUBs below a folder, read by the format book_entries; as ``readers.epub_sections``."""
    from quire.sources.readers import ordered_sections

    register(spark)
    raw = spark.read.format("book_entries").load(path)
    return ordered_sections(raw.select("doc_id", "file", T.html_title(F.col("html")).alias("title"), T.html_to_text(F.col("html")).alias("text")))

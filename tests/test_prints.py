"""Prints whose lines look like parts of a PDF."""

from quire.sources.books import pdf_texts
from quire.sources.sinks import pdf_bytes


def test_lines_that_look_like_parts_of_a_file():
    lines = ["endobj", "5 0 obj x", "stream", "endstream endobj", "/Identity-H", "<< /Type /Page >>", "/Kids [9 0 R]", "xref (T*) \\ <41> Tj ET"]
    pages = [lines, lines[::-1], *[[line] for line in lines]]
    assert pdf_texts(pdf_bytes(pages)) == [("\n".join(p), None) for p in pages]


def test_an_empty_line_is_printed_as_one():
    assert pdf_texts(pdf_bytes([["a", "", "b"], [""]])) == [("a\n\nb", None), ("", None)]

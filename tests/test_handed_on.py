"""Books are made and opened row by row, and handed on a few MB at a time."""

import pyarrow as pa

from quire.sources import readers, sinks


def prints(n):
    pages = [[["line " * 18] * 34] * 20] * n
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(pages, pa.list_(pa.list_(pa.string())))], names=["doc_id", "pages"])


def test_prints_are_handed_on_before_all_are_made():
    made = list(sinks._prints(iter([prints(200), prints(3)])))
    assert [i for b in made for i in b.column(0).to_pylist()] == [*range(200), *range(3)]
    assert len(made) > 2 and max(b.nbytes for b in made) < 6 << 20
    assert made[0].column(1)[0].as_py() == sinks.pdf_bytes([["line " * 18] * 34] * 20)


def test_books_are_handed_on_before_all_are_made():
    n, body = 30, "x" * 1_000_000
    columns = [range(n), ["i"] * n, ["T"] * n, ["en"] * n, [body] * n, pa.nulls(n, pa.list_(pa.struct([("href", pa.string()), ("content", pa.binary())])))]
    made = list(sinks._containers(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcdef"))])))
    assert [i for b in made for i in b.column(0).to_pylist()] == [*range(n)] and max(b.nbytes for b in made) < 8 << 20


def test_sections_are_handed_on_before_all_are_opened():
    n, page = 30, "<p>" + "x" * 1_000_000 + "</p>"
    book = sinks.epub_bytes("T", [("A", page), ("B", page)])
    opened = list(readers._sections(iter([pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array([book] * n)], names=["doc_id", "content"])])))
    assert [i for b in opened for i in b.column(0).to_pylist()] == [str(i) for i in range(n) for _ in range(3)]
    assert sum(b.num_rows for b in opened) == 3 * n and max(b.nbytes for b in opened) < 8 << 20

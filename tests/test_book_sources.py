"""Data sources with a partition for each book, pages of prints, and folders of images as a stream."""

import os
import zlib

from pyspark.sql import functions as F

from quire.sources import books, readers, sinks


def test_books_are_partitions(spark, tmp_path):
    folder = tmp_path / "books"
    (folder / "more").mkdir(parents=True)
    for i, name in enumerate(["a.epub", "b.EPUB", "more/c.epub"]):
        chapters = [(f"Chapter {k}", f"<h1>Chapter {k}</h1><p>{'word ' * 20}{i}</p>") for k in range(3)]
        (folder / name).write_bytes(sinks.epub_bytes(f"Book {i}", chapters))
    (folder / "notes.txt").write_text("x")
    books.register(spark)
    found = spark.read.format("book_entries").load(str(folder))
    assert found.rdd.getNumPartitions() == 3 and found.columns == ["doc_id", "file", "html"]
    one = found.where(F.col("doc_id") == str(folder / "a.epub"))
    assert one.rdd.getNumPartitions() == 1 and {r.doc_id for r in one.collect()} == {str(folder / "a.epub")}
    assert spark.read.format("book_entries").option("columns", "doc_id").load(str(folder)).columns == ["doc_id"]
    want = readers.epub_sections(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)).where("lower(path) LIKE '%.epub'").select(F.regexp_replace("path", "^file:", "").alias("doc_id"), "content"))
    sections = books.read_sections(spark, str(folder))
    assert sorted(map(tuple, sections.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() >= 9
    os.mkdir(tmp_path / "none")
    assert spark.read.format("book_entries").load(str(tmp_path / "none")).collect() == []


def test_sql_over_books(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sinks.pdf_bytes([["one (1)", "two \\ 2"], ["three"]]))
    (tmp_path / "b.pdf").write_bytes(b"no print")
    books.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW prints USING print_pages OPTIONS (path '{tmp_path}')")
    rows = spark.sql("SELECT reverse(split(doc_id, '/'))[0] AS f, page_index, text, error IS NULL AS fine FROM prints ORDER BY 1, 2").collect()
    assert [tuple(r) for r in rows] == [("a.pdf", 0, "one (1)\ntwo \\ 2", True), ("a.pdf", 1, "three", True), ("b.pdf", 0, "", False)]


def test_prints_with_packed_streams_and_arrays():
    stream = zlib.compress(b"BT /F1 9 Tf 10 10 Td [(He) -20 (llo)] TJ 0 -12 Td (a\\051\\n) Tj T* <E9> Tj ET")
    page = b"%PDF-1.4\n1 0 obj << /Type /Pages /Kids [3 0 R 2 0 R] >> endobj\n2 0 obj << /Type /Page /Contents [4 0 R] >> endobj\n3 0 obj << /Type /Page >> endobj\n4 0 obj << /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nendobj"
    assert books.pdf_texts(page) == [("", None), ("Hello\na)\n\né", None)]
    assert books.pdf_texts(b"")[0][1] and books.pdf_texts(b"%PDF-1.4 nothing")[0][1]


def test_images_as_they_come(spark, tmp_path):
    folder, archive = tmp_path / "in", tmp_path / "done"
    (folder / "sub").mkdir(parents=True)
    archive.mkdir()

    def put(name, at):
        (folder / name).write_bytes(b"x" * (at % 7 + 1))
        os.utime(folder / name, (1_700_000_000 + at, 1_700_000_000 + at))

    for i in range(30):
        put(f"sub/{i:02d}.png" if i % 2 else f"{i:02d}.JPG".lower(), i * 10)
    put("note.txt", 999)

    def run():
        batches = []
        source = books.arriving_images(spark, str(folder), since="2023-11-14 22:13:40", archive=str(archive))
        query = source.writeStream.foreachBatch(lambda rows, n: batches.append(sorted(int(r.path.split("/")[-1][:2]) for r in rows.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(100)
        assert query.exception() is None
        return [b for b in batches if b]

    assert run() == [list(range(6, 30)), [2, 3, 4, 5]]  # the newest 24 first; 0 and 1 are before the time
    put("sub/41.png", 400)
    put("40.webp", 410)
    assert run() == [[40, 41]]  # after a restart only what is new
    put("42.png", 420)
    run()
    assert len(list(archive.rglob("*.*"))) >= 24  # what was read left the folder

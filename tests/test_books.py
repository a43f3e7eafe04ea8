"""Containers and prints that the sinks make, opened by other readers; normal forms; prompts' fallbacks; sketches of rules over small rows."""

import io
import unicodedata
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import functions as F

from quire.functions import prompts
from quire.functions import text as T
from quire.functions.rows import numbered, once, spread
from quire.operators import runs
from quire.sources import readers, sinks

PAGE = "doc_id long, page_number int, title string, chapter_title string, caption string"


def test_epub_of_each_book(spark):
    rows = [(1, 2, 'A & "B"', "Two", "it's <here>"), (1, 1, 'A & "B"', "One", "first"), (2, 1, "Plain", None, None)]
    made = {r.doc_id: bytes(r.epub) for r in sinks.epub_books(sinks.book_bodies(spark.createDataFrame(rows, PAGE))).collect()}
    assert sorted(made) == [1, 2]
    with zipfile.ZipFile(io.BytesIO(made[1])) as z:
        assert z.namelist()[0] == "mimetype" and z.read("mimetype") == b"application/epub+zip" and z.testzip() is None
        trees = {n: ET.fromstring(z.read(n)) for n in z.namelist()[1:]}
    package = trees["OEBPS/content.opf"]
    dc = "{http://purl.org/dc/elements/1.1/}"
    assert [package.find(f".//{dc}{n}").text for n in ("title", "language")] == ['A & "B"', "en"] and package.find(f".//{dc}identifier").text.startswith("urn:book:")
    opf = "{http://www.idpf.org/2007/opf}"
    hrefs = {i.get("id"): i.get("href") for i in package.iter(f"{opf}item")}
    assert {f"OEBPS/{h}" for h in hrefs.values()} <= set(trees) and all(r.get("idref") in hrefs for r in package.iter(f"{opf}itemref"))
    text = "".join(trees["OEBPS/chapter-01.xhtml"].itertext())
    assert text.index("first") < text.index("it's <here>")


def test_pdf_of_each_book(spark):
    lines = [(1, i, f"line {i} (a\\b) é") for i in range(80)] + [(2, 0, "")]
    made = {r.doc_id: bytes(r.pdf) for r in sinks.review_pdfs(spark.createDataFrame(lines, "doc_id long, line_no int, line string")).collect()}
    data = made[1]
    assert data.startswith(b"%PDF-1.4") and data.count(b"/Type /Page /Parent") == 3 and data.count(b"Tj") == 80 and b"(line 7 \\(a\\\\b\\) e?) Tj" in data
    start = int(data.split(b"startxref\n")[1].split()[0])
    assert data[start:].startswith(b"xref\n0 ")
    for n, row in enumerate(data[start:].split(b"trailer")[0].splitlines()[3:], 1):
        assert data[int(row[:10]) :].startswith(f"{n} 0 obj".encode())


def test_normal_forms(spark):
    texts = ["Ａｂｃ", "ﬁne ½", "é", "é", "漢字", "😀", "", None, "ǎ ǆ ㍿"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.compatible(F.col("t")).alias("c"), T.decomposed(F.col("t")).alias("d"), sinks.ascii_fold(F.col("t")).alias("a")).collect()
    for r in rows:
        text = texts[r.i] or ""
        assert r.c == unicodedata.normalize("NFKC", text) and r.d == unicodedata.normalize("NFKD", text)
    assert [r.a for r in sorted(rows)] == ["Abc", "fine 1?2", "e?", "e?", "??", "??", "", "", "a? dz? ????"]


def test_prompts_fill_in_what_is_missing(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(
        prompts.scene_prompt(none, F.array(F.lit("Ann"), F.lit("Bo")), F.lit("art"), F.lit("eye level"), F.array(F.lit("One."), F.lit("Two.")), F.lit("fog")).alias("s"),
        prompts.character_line(F.lit("Ann"), none, F.array(F.lit("hat")), F.lit("a.png"), F.lit("p.md")).alias("c"),
    ).first()
    assert row.s.split("\n") == ["art", "Scene: ", "Characters: Ann, Bo", "Composition: eye level; one emotionally clear action; no visible text.", "Continuity: One. Two.", "Avoid: fog."]
    assert row.c == "Ann:  Visual anchors: hat. Reference image already exists at a.png."


def test_items_go_on_after_a_pause_ends(spark):
    items = spark.createDataFrame([("r", i, i) for i in range(8)] + [("q", 0, 0)], "run_id string, item int, at int")
    flags = spark.createDataFrame([("r", "paused", 2), ("r", "running", 5), ("x", "paused", 0)], "run_id string, status string, at int")
    assert sorted((r.run_id, r.item) for r in runs.runnable_items(items, flags).collect()) == [("q", 0), *(("r", i) for i in (0, 1, 5, 6, 7))]


def test_extraction_stops_at_the_first_good_text(spark):
    rows = [(1, 0, "native", " ", False), (1, 1, "layout", "good", False), (1, 2, "ocr", "better", False), (2, 0, "native", "ab", True), (2, 1, "ocr", "abc", True), (3, 0, "native", None, None)]
    got = readers.extraction_chain(spark.createDataFrame(rows, "doc_id long, pos int, method string, text string, weak boolean")).collect()
    assert sorted((r.doc_id, r.method, r.status, r.used) for r in got) == [(1, "layout", "ok", True), (1, "native", "empty", False), (2, "native", "weak", False), (2, "ocr", "weak", True), (3, "native", "empty", False)]


def test_once_works_a_column_out_once(spark):
    rows = once(spark.range(3).withColumn("a.b", F.lit("k")), text=F.regexp_replace(F.col("id").cast("string"), "1", "one"))
    found = rows.where("length(text) > 2").select(F.length("text").alias("n"), F.upper("text").alias("u"), F.col("`a.b`"))
    assert [tuple(r) for r in found.collect()] == [(3, "ONE", "k")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_spread_leaves_wide_scans_alone(spark, tmp_path):
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "wide"))
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "narrow"))
    spark.conf.set("spark.sql.files.openCostInBytes", "200m")
    try:
        plans = {n: spread(spark.read.parquet(str(tmp_path / n)))._jdf.queryExecution().optimizedPlan().toString() for n in ("wide", "narrow")}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Repartition" not in plans["wide"] and "Repartition" in plans["narrow"]


def test_numbers_of_hot_groups(spark):
    rows = [(None if i % 3 else "hot", i * 7919 % 4001, i % 2) for i in range(4000)]
    docs = spark.createDataFrame(rows, "source string, doc_id long, x int")
    want = {}
    for source in {r[0] for r in rows}:
        want.update({(source, *k): n for n, k in enumerate(sorted(r[1:] for r in rows if r[0] == source))})
    found = numbered(docs, ["source"], ["doc_id", "x"], "n", width=6)
    assert {(r.source, r.doc_id, r.x): r.n for r in found.collect()} == want and found.columns == ["source", "doc_id", "x", "n"]
    assert numbered(docs.limit(0), ["source"], ["doc_id"], "n").count() == 0


def test_epub_with_pictures_and_caption_lines(spark):
    kind = PAGE + ", spread_id string, asset_path string, caption_lines array<struct<language:string,label:string,text:string,needs_translation:boolean>>"
    rows = [
        (1, 1, "T", "C", "one", "sp 1", "a/1.JPG", [("en", "EN", "one", False), ("fr", "FR", "", True)]),
        (1, 2, "T", "C", "two's", "sp-2", None, None),
        (1, 3, "T", "C", "three", "sp-3", "a/3.tif", [("de", "", None, False)]),
    ]
    pages = spark.createDataFrame(rows, kind).withColumn("image_href", sinks.image_href(F.col("spread_id"), F.col("asset_path")))
    images = pages.select("doc_id", F.col("image_href").alias("href"), F.when(F.col("page_number") == 1, F.lit("jpeg").cast("binary")).alias("content"))
    [made] = sinks.epub_books(sinks.book_bodies(pages), images=images).collect()
    with zipfile.ZipFile(io.BytesIO(made.epub)) as z:
        assert z.testzip() is None and z.read("OEBPS/images/sp-1.jpg") == b"jpeg" and not [n for n in z.namelist() if n.endswith("sp-3.png")]
        assert b'media-type="image/jpeg"' in z.read("OEBPS/content.opf")
        body = ET.fromstring(z.read("OEBPS/chapter-01.xhtml"))
    assert ["".join(e.itertext()) for e in body.iter("{http://www.w3.org/1999/xhtml}span")] == ["ENone", "FRTranslation pending", "two's", "three"]
    assert [e.get("src") for e in body.iter("{http://www.w3.org/1999/xhtml}img")] == ["images/sp-1.jpg", "images/sp-3.png"]
    site = {r.path: r.html for r in sinks.book_site(pages.withColumns({"chapter_idx": F.lit(0), "image_status": F.lit(None).cast("string")})).collect()}
    assert set(site) == {"reader.html", "studio.html", "index.html"} and site["reader.html"].count("Image pending") == 1 and "(3)</li>" in site["index.html"]

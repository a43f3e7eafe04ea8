"""Replies around their JSON, and paragraphs at the very limit of a page."""

from pyspark.sql import functions as F

from quire.operators import segments
from quire.sources import readers, sinks, tables


def test_a_value_with_words_after_it_is_no_reply(spark):
    said = {
        '8294846167456848 Inly {"chapters": [5,2]} more': "[5,2]", '12 words\n```json\n{"spreads": [7]}\n``` 12': "[7]", '[1] or {"chapters": [2]}': "[2]", '{"a":1}, {"b":2}': None, "1,2": None, "1] [2": None, '1, "b": 2': None,
        "": None, "]": None, " [3,4] ": "[3,4]", '{"chapters": [9]}': "[9]", "17": None,
    }
    rows = spark.createDataFrame([(t,) for t in said], "text string")
    assert {r.text: r.items for r in rows.select("text", readers.json_array(F.col("text"), "chapters", "spreads").alias("items")).collect()} == said


def test_a_paragraph_of_115_letters_is_not_over_a_target_of_100(spark):
    # 100 * 1.15 is 114.99999999999999 as a double
    fits, over = f"{'a' * 60}. {'b' * 52}.", f"{'a' * 60}. {'b' * 53}."
    rows = spark.createDataFrame([(0, fits, 100), (1, over, 100), (2, "c" * 23, 20), (3, "c" * 24, 20)], "i int, p string, target int")
    got = {r.i: list(r.parts) for r in rows.select("i", segments.split_long(F.col("p"), F.col("target")).alias("parts")).collect()}
    assert got == {0: [fits], 1: [f"{'a' * 60}.", f"{'b' * 53}."], 2: ["c" * 23], 3: ["c" * 20, "cccc"]}
    assert len(fits) == 115 and tables.segments_of(f"{fits}\n\n{'d' * 85}", 2) == [fits, "d" * 85]


def test_texts_become_files_in_few_folders(spark, tmp_path):
    texts = {i: f"text {i} é" for i in range(-3, 2100)} | {5: "", 6: None}
    sinks.write_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), str(tmp_path / "t"))
    found = {p.name: p.read_bytes() for p in (tmp_path / "t").rglob("*") if p.is_file()}
    assert found == {f"doc_id={i}.txt": f"{t}\n".encode() for i, t in texts.items() if t is not None}
    assert len(list((tmp_path / "t").iterdir())) == 4
    listed = readers.list_files(spark, str(tmp_path / "t"), "*.txt")
    assert listed.count() == 2102 and listed.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism


def test_files_of_other_types_are_not_opened(spark, tmp_path):
    (tmp_path / "A.TXT").write_text("hello")
    (tmp_path / "b.bin").write_bytes(b"0")
    documents, errors = readers.read_documents(spark, str(tmp_path))
    # left out by their names, which the scan knows before it opens them
    assert "file_name" in documents._jdf.queryExecution().optimizedPlan().toString()
    assert [r.text for r in documents.collect()] == ["hello"] and [r.error for r in errors.collect()] == ["Unsupported source type: .bin"]

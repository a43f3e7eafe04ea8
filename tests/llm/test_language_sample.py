from quire.llm.language import identify_languages, train_text_model


def test_rare_languages_stay_in_the_model(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CASE WHEN id < 3 THEN 'rare' WHEN id < 180 THEN 'few' WHEN id % 3 = 0 THEN 'fr' ELSE 'en' END AS lang")
    names, logs = train_text_model(docs, train_rows=300)
    assert names == ["en", "few", "fr", "rare"] and len(logs) == 4


def test_two_hundred_languages(spark):
    word = lambda k: "concat_ws(' ', transform(sequence(1, 12), i -> substring(sha2(concat(" + k + ", ':', i % 5), 256), 1, 7)))"
    docs = spark.range(2000).selectExpr("id AS doc_id", f"{word('id % 200')} AS text", "concat('l', lpad(id % 200, 3, '0')) AS lang", "1 AS p", "2 AS held")
    pages = spark.range(600).selectExpr("id AS page_id", f"concat('<html><p>', {word('id % 200')}, '</p></html>') AS html", "concat('http://h', id % 200, '.example/') AS url", "1 AS p", "2 AS s", "3 AS host_n", "4 AS lang")
    found = identify_languages(pages, docs).collect()
    assert len(found) == 600 and all(r.lang == r.text_lang == f"l{r.page_id % 200:03d}" for r in found)


def test_a_very_long_page(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog " * 5 if i % 2 else "le chat et le chien " * 5, "en" if i % 2 else "fr") for i in range(20)], "doc_id long, text string, lang string")
    long = "<html><body>" + "<p>le chat et le chien</p>" * 200_000 + "</body></html>"
    found = identify_languages(spark.createDataFrame([(1, "http://a.example/", long)], "page_id long, url string, html string"), docs).collect()
    assert [r.lang for r in found] == ["fr"]

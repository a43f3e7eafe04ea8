import random

from quire.llm.language import identify_languages, trigrams, visible

WORDS = {"en": "the of and to in that with for this from they have are would there their".split(), "fr": "le la les des une est dans pour que qui avec sur pas nous vous être".split(), "de": "der die das und ist nicht ein eine mit auf für von werden wurde über auch".split()}
PAGE = "page_id long, url string, html string"


def say(lang, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_fusion(spark):
    docs = spark.createDataFrame([(i, say(lang, i, 60), lang) for i, lang in enumerate(list(WORDS) * 20)] + [(900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    truth, rows = {}, []
    for i in range(150):
        lang = list(WORDS)[i % 3]
        wrong = "en" if i % 10 == 0 else lang
        rows.append((i, f"https://www.{lang}site{i % 4}.example.{lang}/p{i}", f'<html lang="{wrong}-XX"><script>var the = "of and to";</script><nav>le la der</nav><p>{say(lang, 500 + i, 40)}</p></html>'))
        truth[i] = lang
    rows += [(1000, "https://frsite1.example.fr/x", ""), (1001, None, None), (1002, "bad url", '<html lang="de">'), (1003, "http://desite0.example.de/", None), (1001, "http://a.b", f"<p>{say('fr', 1, 30)}</p>"), (None, "http://a.b", "x")]
    pages = spark.createDataFrame(rows, PAGE)
    got = identify_languages(pages, docs).collect()
    assert len(got) == len(rows) - 1
    by = {r.page_id: r for r in got}
    assert all(by[i].lang == lang and by[i].text_lang == lang and by[i].confidence > 0.9 for i, lang in truth.items())
    assert by[1000].lang == "fr" and by[1003].lang == "de" and by[1002].lang == "de" and by[1002].declared == "de"
    assert sorted(r.lang for r in got if r.page_id == 1001)[-1] == "fr"


def test_bounds(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.b", '<html lang="FR">')], PAGE)
    assert [tuple(r)[:3] for r in identify_languages(pages, docs).collect()] == [(1, "fr", 0.0)]
    some = spark.createDataFrame([(1, say("en", 1, 9), "en")], docs.schema)
    assert identify_languages(spark.createDataFrame([], PAGE), some).count() == 0


def test_visible_text():
    assert visible(b"<style>p{}</style><p>a&nbsp;b</p><!-- x -->").split() == [b"a", b"b"]
    assert len(trigrams(b"")) in (0, 1) and trigrams(b"AB").tolist() == trigrams(b"ab").tolist()

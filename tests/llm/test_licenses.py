from pyspark.sql import functions as F

from helpers import SCHEMA, frame, odd_texts, prose
from quire.llm.licenses import TEMPLATES, Templates, bigrams, dice, normalise, passages, scan_licenses


def slow(text):
    out = []
    for s, e in passages(text):
        a = bigrams(normalise(text[s:e]))
        scored = [(dice(a, bigrams(normalise(t))), name) for name, texts in TEMPLATES.items() for t in texts]
        top = max(x for x, _ in scored)
        if top >= 0.8:
            name = next(n for x, n in scored if x == top)
            if not any(a <= s and e <= b and n == name for a, b, n, _ in out):
                out.append((s, e, name, top))
    return out


def test_scan(spark):
    notices = [t for texts in TEMPLATES.values() for t in texts]
    texts = odd_texts() + [f"{prose(i, 30)}\n{n}\n{prose(i + 50, 9)}" for i, n in enumerate(notices)] + notices
    texts += [n.upper().replace("LICENSE", "Licence") for n in notices] + ["Licensed under the terms we like. Released under the MIT License. " + prose(3, 8), "the mit released under license", "Licensed under the Apache License\nVersion 2.0"]
    docs = frame(spark, texts).withColumn("license", F.lit("clash")).withColumn("body", F.lit(1))
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        want = slow(text or "")
        assert [tuple(h) for h in got[i].hits] == want, text
        assert (got[i].license is None) == (not want)
    assert sum(r.license is not None for r in got.values()) >= 3 * len(notices)
    assert all(got[i].license is None for i in range(len(odd_texts())))
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_needed_words_lose_nothing():
    known = Templates(TEMPLATES, 0.8)
    for _, _, grams in known.known:
        words = set(known._needed(grams))
        touched = sum(n for g, n in grams.items() if words & set(g))
        lacks = grams.total() - touched
        assert 2 * lacks / (lacks + grams.total()) < 0.8  # what a passage without these words could reach

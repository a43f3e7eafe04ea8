"""Cues that stand only where the letters around a name are cut off within a longer word."""

from quire.operators import entities as E


def test_cues_cut_out_of_longer_words(spark):
    pad = "x" * 38 + " "
    texts = ["eran thwh " + pad + "Thwh ends", "Thwh " + pad[1:] + "thwh saidly", "eran thwh " + pad + " Thwh ends", "zqueen thwh " + pad[2:] + "Thwh ends"]
    docs = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "doc_id long, title string, text string")
    got = {r.doc_id: r.context for r in E.review(docs).collect() if r.name == "Thwh"}
    assert got == {i: E.context_score("Thwh", t) for i, t in enumerate(texts)}
    assert got == {0: 2, 1: 2, 2: 0, 3: 1}

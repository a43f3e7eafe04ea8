"""Names of a cast in one pass, against the rule name by name; and what texts get points from."""

import random
import re

from quire.operators import entities as E


def by_rule(text, names):
    """Longest names first; a place that overlaps one already counted doesn't count."""
    kept = []
    for name in sorted({n for n in names if n}, key=len, reverse=True):
        for m in re.finditer(rf"(?<![^\W_]){re.escape(name)}(?![^\W_])", text, re.I):
            if not any(m.start() < b and m.end() > a for a, b in kept):
                kept.append(m.span())
    return len(kept)


def test_counts_are_those_of_the_rule():
    r = random.Random(7)
    words = ["Mad", "Hatter", "Queen", "of", "Hearts", "hatter's", "MAD", "cat", "Cheshire", "ox"]
    people = [["Mad Hatter", "Hatter", "Hatter Queen"], ["Queen", "Queen of Hearts"], ["Cheshire Cat", "cat", ""], ["zz"], []]
    cast = E.Cast(people)
    for _ in range(800):
        text = "".join(r.choice(words) + r.choice([" ", " ", ", ", "-", "_", ""]) for _ in range(r.randrange(12)))
        assert cast.counts(text) == [by_rule(text, p) for p in people], text
        assert cast.named(text) == [by_rule(text, p) > 0 for p in people]
    assert E.Cast([["İx", "ß"]]).counts("a İx ß SS") == [2] and E.Cast([[]]).named("x") == [False]


def test_references_and_the_known_cast(spark):
    pages = spark.createDataFrame([(1, "s1", "The Mad Hatter met a CAT."), (1, "s2", "concatenate"), (1, "s3", None), (2, "s4", "cat")], "doc_id int, spread_id string, source_passage string")
    people = spark.createDataFrame([(1, 2, "c", "Cat", ["cat", ""]), (1, 1, "h", "Hatter", ["Mad Hatter"])], "doc_id int, rank int, id string, name string, aliases array<string>")
    assert {r.spread_id: r.character_refs for r in E.references(pages, people).collect()} == {"s1": ["h", "c"], "s2": [], "s3": [], "s4": []}
    docs = spark.createDataFrame([(1, "x", "Alice met the Cheshire Cat, the Hatter and the March Hare. Alice asked the Mad Hatter. Rabbit!")], "doc_id int, title string, text string")
    found = {r.name: (r["count"], r.source) for r in E.candidates(docs).where("source = 'canonical'").collect()}
    assert found == {"Alice": (2, "canonical"), "Hatter": (2, "canonical")}  # those named twice at least


def test_only_texts_with_a_cue_get_points(spark):
    texts = ["Ann said so. Ann ran. Ann", "Ann and Ann and Ann", "old Mrs. Ann, Ann, Ann", "Anna said. Ann. Ann Ann"]
    docs = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id int, title string, text string")
    got = {r.doc_id: r.context for r in E.review(docs).where("name = 'Ann'").collect()}
    assert got == {i: E.context_score("Ann", t) for i, t in enumerate(texts)} and got[1] == 0 and got[0] > 0


def test_people_look_as_they_are_told(spark):
    docs = spark.createDataFrame([(1, "t", "Mira said hello. Mira ran. Grandpa laughed. Grandpa and Mira."), (2, "t", "nobody")], "doc_id int, title string, text string")
    rows = {(r.doc_id, r.id): r for r in E.characters(docs, E.review(docs)).collect()}
    assert rows[1, "mira"].visual_anchors[1] == "red hair clip" and rows[1, "grandpa"].description.startswith("Grandpa is a kind elderly figure")
    assert rows[2, "protagonist"].visual_anchors == list(E.GENERIC_ANCHORS) and rows[2, "protagonist"].source_mentions == 0

import hashlib
import re

from pyspark.sql import functions as F

from helpers import SCHEMA, frame, odd_texts, prose
from quire.llm.pii import FEATURES, KINDS, BoostedTrees, joined, personal_data, redacted, threshold

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accepted(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def slow_base(text):
    out = [(m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(BASE[k], text) if accepted(k, m.group())]
    return sorted(out)


TEXTS = [
    "mail bob.smith+x@mail-1.example.co.uk, or a@b.c..d and a@b.com_x@y.com; a@b @c.d x@y. z",
    "hosts 10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 0001.002.3.255 9999999999.1.1.1",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 5500  0000 0000 0004 12345 3782-822463-10005",
    "call +1 (706) 555-3138 or +44 20 7946 0958. +1 5 +123456789012345678 ++12 345 6789-",
    "😀 ünïcode before a@b.co and 10.1.1.1 é +33 1 23 45 67 89 tail",
    "1 " * 5000 + "9" * 30_000 + " " + "a" * 30_000 + "a.b" * 4000 + "x@" + "a." * 9000 + "b",
    "+1 " * 3000 + "(((((" * 3000,
    "phone (706) 555-3138 tel 706-555-3138 order 12345678 bob (at) example.com on 2024-01-02",
]


def test_base_spans(spark):
    texts = odd_texts() + TEXTS + [prose(i, 50) + f" tel +1 (70{i % 9}) 555-{3000 + i} mail u{i}@h{i}.example.org ip 10.{i}.2.3" for i in range(60)]
    docs = frame(spark, texts).withColumn("base", F.lit("clash")).withColumn("t", F.lit(1))
    found = personal_data(docs)
    got = {r.doc_id: r for r in found.select("*", joined(F.col("base")).alias("b"), joined(F.col("spans")).alias("s")).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        want = slow_base(text or "")
        assert [tuple(x) for x in got[i].base] == want, i
        assert got[i].b == ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[1] == j for x in want) for j in range(4)]
        spans = [tuple(x) for x in got[i].spans]
        assert set(want) <= set(spans) and spans == sorted(spans)
        for s, _, e in set(spans) - set(want):
            assert 0 <= s < e <= len(text) and not any(a < e and s < b for a, _, b in want)
    out = {r.doc_id: r.text for r in redacted(docs, found).collect()}
    assert "[phone]" in out[len(texts) - 1] and "555-" not in out[len(texts) - 1] and out[8].startswith(texts[8][:50])
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_empty(spark):
    assert personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    assert personal_data(frame(spark, ["clean", None])).select("spans").collect()[0].spans == []


def test_trees_and_their_sql(spark):
    size = 1 << len(FEATURES)
    cells = {c: ((90, 2) if c & 2 and not c & 16 else (1, 60)) for c in [*range(0, size, 7), *range(3 * size, 4 * size, 5)]}
    trees = BoostedTrees().fit(cells)
    assert len(trees.trees) > 3
    assert all((trees.score(c) > 0) == (p > n) for c, (p, n) in cells.items())
    got = spark.createDataFrame([(c,) for c in cells], "cell int").selectExpr("cell", trees.sql("cell") + " AS score").collect()
    assert all(abs(r.score - trees.score(r.cell)) < 1e-9 for r in got)


def test_threshold():
    assert threshold([(3.0, 9, 0), (2.0, 5, 1), (1.0, 0, 9)], 0.9) == 2.0
    assert threshold([(1.0, 0, 1)], 0.5) == float("inf")

"""Tries that let subtrees go, texts that share a digest, and products beyond a long."""

import numpy as np
from helpers import frame, odd_texts, prose
from pyspark.sql import functions as F

from quire.llm.exact_dedup import PatriciaTrie, exact_duplicates
from quire.llm.topk import products, top_products


def test_the_largest_subtrees_leave_first():
    trie = PatriciaTrie()
    for i, text in enumerate([b"", b"aaaa", b"aab", b"b" * 5000, b"bbb", b"c" * 900, b"aaaa"]):
        trie.insert(text, i, i, 1)
    gone = {k: tuple(v[:3]) for k, v in trie.evict(3000)}
    assert set(gone) == {b"b" * 5000, b"bbb"} and trie.n_bytes < 3000
    assert {k: tuple(v[:3]) for k, v in trie.items()} == {b"": (0, 0, 1), b"aaaa": (1, 6, 2), b"aab": (2, 2, 1), b"c" * 900: (5, 5, 1)}
    assert trie.n_bytes == 0 and list(trie.items()) == []


def brute(texts):
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(t or "", []).append(i)
    return {i: (max(g), len(g), i == max(g)) for g in by.values() for i in g}


def test_small_budgets_and_shared_digests(spark):
    texts = odd_texts() * 3 + [prose(i % 7, 300) for i in range(40)]
    docs = frame(spark, texts).withColumns({n: F.lit(1) for n in ("body", "keep_id", "n_bytes", "own_body")})
    weak = lambda body: F.substring(F.sha2(body, 256), 1, 1)
    for budget, digest in ((2000, None), (48 << 20, weak), (2000, weak), (48 << 20, lambda body: F.lit("x"))):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs, "largest", budget, digest).collect()}
        assert got == brute(texts)


def test_products_beyond_a_long(spark):
    big = np.array([[1 << 40, -(1 << 40)]], np.int64)
    top = np.iinfo(np.int64).max
    assert products(big, np.array([[1 << 40, -(1 << 40)], [-(1 << 40), 1 << 40], [3, 1]], np.int64), 1 << 82).tolist() == [[top, -top, 2 << 40]]
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0]), (4, [2e18, 5.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).collect())
    assert got == [(0, 1, 1, top), (0, 2, 3, top), (0, 3, 4, top)]


def test_products_with_clashing_columns(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4).tolist()) for i in range(50)] + [(7, r.normal(size=4).tolist()), (None, [1.0] * 4), (51, None), (52, [1.0, None, 0.0, 0.0]), (53, []), (54, [float("nan")] * 4)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    names = ("id", "v", "is_query", "place", "group", "dim", "kind", "ids", "vectors", "level", "query_id", "rank", "score", "n", "bytes")
    got = [sorted(map(tuple, top_products(x, F.col("vec_id") % 5 == 0, 6).collect())) for x in (plain, plain.withColumns({n: F.lit("x") for n in names}))]
    assert got[0] == got[1] and len(got[0]) == 10 * 6

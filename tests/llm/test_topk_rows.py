"""Rows that the first version of the search lost: repeated ids, other lengths, large scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.topk import best, products, top_products


def slow(rows, k):
    """Over plain Python numbers: every row a candidate, each query asked once."""
    whole = [(i, tuple(int(64 * x) for x in v)) for i, v in rows]
    out = {}
    for q, v in {r for r in whole if r[0] % 20 == 0}:
        out.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))
    return sorted((q, r + 1, i, -s) for q, found in out.items() for r, (s, i) in enumerate(sorted(found)[:k]))


def got(spark, rows, k=20, **options):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in top_products(docs, F.col("vec_id") % 20 == 0, k, **options).collect())


@pytest.mark.parametrize("options", [{}, {"block": 7, "query_block": 3, "fan_in": 2}, {"group_bytes": 400}])
def test_repeated_ids_and_lengths(spark, options):
    r = random.Random(8)
    rows = [(i % 70, [float(r.randrange(-5, 6)) for _ in range(3 if i % 4 else 5)]) for i in range(300)]
    rows += [(7, [1.0, 1.0, 1.0])] * 40 + rows[:30]  # one vector many times over, and ties
    assert got(spark, rows, 6, **options) == slow(rows, 6)


def test_two_rows_of_one_candidate(spark):
    assert got(spark, [(0, [1.0]), (1, [2.0]), (1, [3.0])]) == [(0, 1, 1, 12288), (0, 2, 1, 8192)]


@pytest.mark.parametrize("size", [2.0**20, 2.0**24])
def test_large_scores(spark, size):
    """Scores of 2 ** 52 and of 2 ** 60: the best is found and the worst isn't."""
    rows = [(0, [size])] + [(i, [size if i == 3 else -size if i == 5 else float(i)]) for i in range(1, 200)]
    found = got(spark, rows, 3)
    assert found == slow(rows, 3) and found[0][2] == 3


def test_products_by_size():
    q, x = np.array([[1 << 30, 3]]), np.array([[1 << 31, -1], [5, 7]])
    for most in (1 << 60, 1 << 70):
        assert products(q, x, most).tolist() == [[(1 << 61) - 3, (5 << 30) + 21]]
    # beyond a long, the nearest one: 2 ** 81 - 3 * 2 ** 20 is, and 5 * 2 ** 50 + 21 * 2 ** 20 isn't
    assert products(q << 20, x, 1 << 90).tolist() == [[(1 << 63) - 1, (5 << 50) + (21 << 20)]]
    assert [c.tolist() for c in best(np.array([[1, 5, 5, 2, 5]]), 2)] == [[0, 0], [1, 2]]

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.llm.topk import top_products


def slow(rows, k):
    kept = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, v in kept.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in kept.items() if i != q)
            out.update({(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored[:k])})
    return out


@pytest.mark.parametrize("k,block", [(5, 16), (20, 8192), (500, 64)])
def test_top_products(spark, k, block):
    r = random.Random(4)
    rows = [(i, [float(f"{r.gauss(0, 0.2):.3f}") for _ in range(6)]) for i in range(230)]
    rows += [(i + 300, rows[i][1]) for i in range(80)]
    rows += [(500, None), (520, [None] * 6), (540, [float("nan")] + [0.1] * 5), (560, [float("inf")] * 6), (None, [0.5] * 6), (580, [0.0] * 6)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(2))
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in top_products(docs, F.col("vec_id") % 20 == 0, k, 4, block, 2).collect()}
    assert got == slow(rows, k)


def test_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_products(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert top_products(spark.createDataFrame([(0, [])], schema), F.col("vec_id") % 20 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in top_products(twice, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]

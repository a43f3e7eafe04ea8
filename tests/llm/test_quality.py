import zlib

import numpy as np
from pyspark.sql import functions as F

from helpers import SCHEMA, frame, odd_texts, prose
from quire.llm.quality import STATS, pool_adjacent, quality_scores, statistics


def corpus():
    good = [prose(i, 60 + i % 90) for i in range(160)]
    bad = [" ".join(w.upper() + "!!" for w in prose(1000 + i, 70).split()) for i in range(40)]
    return good + bad


def test_held_out_accuracy(spark):
    texts = corpus() + odd_texts()
    docs = frame(spark, texts).withColumn("y", F.lit("clash")).withColumn("score", F.lit(9))
    labels = spark.createDataFrame([(i, int(i < 160), 0) for i in range(200)] + [(3, None, 0), (None, 1, 0), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(docs, labels, features=64).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [i for i in range(200) if got[i].held_out]
    assert len(held) > 30
    assert np.mean([got[i].predicted == (i < 160) for i in held]) > 0.95


def test_held_out_labels_change_nothing(spark):
    docs = frame(spark, corpus())
    rows = [(i, int(i < 160)) for i in range(200)]
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in rows]
    a, b = ({r.doc_id: round(r.score, 6) for r in quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int"), features=32).collect()} for x in (rows, other))
    assert a == b


def test_without_labels(spark):
    docs, none = frame(spark, odd_texts()), spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, none).collect()} == {1.0}
    assert quality_scores(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_pool_adjacent():
    assert pool_adjacent(np.array([0.0, 1, 0, 1]), np.ones(4)).tolist() == [0, 0.5, 0.5, 1]


def test_statistics_are_finite():
    for text in odd_texts():
        row = statistics((text or "").encode())
        assert len(row) == len(STATS) and np.isfinite(row).all()

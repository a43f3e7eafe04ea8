import collections

import corpus_pipeline as pipeline
from helpers import SCHEMA, frame, odd_texts, prose
from pyspark.sql import functions as F
from quire.llm.quality import quality_scores
from test_neardup import slow_groups


def table(spark, path, texts, ids=None, labels=()):
    docs = frame(spark, texts, ids)
    docs.withColumn("mix_slot", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_brute_force(spark, tmp_path):
    good = [prose(i, 40 + i) for i in range(60)] + odd_texts() + [prose(5, 45), prose(5, 45) + " x", prose(7, 47).upper(), prose(8, 48) + " and more", prose(9, 49).replace(" ", "  ", 3)]
    bad = [" ".join(w.upper() + "!!" for w in prose(900 + i, 60).split()) for i in range(25)]
    texts = good + bad
    d = table(spark, tmp_path / "d", texts, labels=[(i, int(i < 60), 0) for i in [*range(60), *range(len(good), len(texts))]])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = dict(pipeline.STAGES)
    text = {i: t for i, t in enumerate(texts)}

    def rows(df):
        assert df.columns == list(pipeline.COLUMNS)
        out = [r.doc_id for r in df.collect()]
        assert len(out) == len(set(out))
        return sorted(out)

    first = steps["quality_classifier"](spark, docs, d).persist()
    kept = rows(first)
    want = sorted(r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{d}/labels.parquet")).collect() if r.predicted)
    assert kept == want and set(range(60)) <= set(kept) and not set(kept) & set(range(len(good), len(texts)))

    second = steps["exact_dedup"](spark, first, d).persist()
    best = {}
    for i in kept:
        best.setdefault(text[i] or "", i)
    assert rows(second) == sorted(best.values())

    third = steps["simhash_neardup"](spark, second, d).persist()
    ids = sorted(best.values())
    groups = slow_groups({i: text[i] for i in ids})
    assert rows(third) == sorted(set(groups.values()))

    fourth = steps["source_mixing"](spark, third, d).persist()
    assert rows(fourth) == rows(third)

    ends = collections.Counter()
    packed = steps["best_fit_packing"](spark, fourth, d).collect()
    for r in packed:
        ends[r.sequence_id] += r.length
    assert {r.doc_id for r in packed} == set(groups.values()) and max(ends.values()) <= 2048


def test_odd_tables(spark, tmp_path):
    empty = tmp_path / "empty"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert pipeline.run(spark, str(empty)).count() == 0
    d = table(spark, tmp_path / "odd", odd_texts() * 2, ids=[None, *range(len(odd_texts()) - 1)] * 2)
    rows = pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} <= set(range(len(odd_texts()) - 1)) and len({(r.doc_id, r.piece) for r in rows}) == len(rows)

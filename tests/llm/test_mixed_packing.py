import collections

import corpus_pipeline as pipeline
from helpers import SCHEMA, prose
from pyspark.sql import functions as F
from quire.llm.mixing import mix_sources
from quire.llm.packing import pack_documents


def corpus(spark):
    n = {"a": 1600, "b": 400, "c": 100}
    return spark.createDataFrame([(i, prose(i, 20 + i % 50), "en", s, 3) for i, s in enumerate(s for s, k in n.items() for _ in range(k))], SCHEMA)


def shuffled_files(docs, path):
    """Files of unequal size, which Spark reads largest first."""
    docs.where("doc_id % 9 = 0").coalesce(1).write.mode("append").parquet(path)
    docs.where("doc_id % 9 > 3").coalesce(1).write.mode("append").parquet(path)
    docs.where("doc_id % 9 BETWEEN 1 AND 3").coalesce(1).write.mode("append").parquet(path)
    return docs.sparkSession.read.parquet(path)


def test_sequences_in_order_hold_the_weights(spark, tmp_path):
    docs = shuffled_files(corpus(spark), str(tmp_path / "d"))
    mixed = mix_sources(docs, block_rows=4).persist()
    at = {r.doc_id: (r.mix_slot, r.mix_row) for r in mixed.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    phase0 = {r.doc_id for r in mixed.where("mix_phase = 0").collect()}
    rows = pack_documents(mixed, order=("mix_slot", "mix_row"), problem_rows=100).collect()
    first = collections.defaultdict(lambda: (1 << 40, 0))
    for r in rows:
        first[r.sequence_id] = min(first[r.sequence_id], at[r.doc_id])
    ids = sorted(first)
    assert [first[i] for i in ids] == sorted(first.values()) and len(ids) > 20
    # cut into thirds, phase 0 holds the weights 40 : 20 : 10 in each of them
    place = {i: k for k, i in enumerate(ids)}
    early = [r for r in rows if r.doc_id in phase0]
    last = max(place[r.sequence_id] for r in early) + 1
    parts = [collections.Counter(source[r.doc_id] for r in early if place[r.sequence_id] * 3 // last == k) for k in range(3)]
    for part in parts[:2]:
        n = part.total()
        assert n > 30 and all(abs(part[s] / n - w) < 0.15 for s, w in (("a", 4 / 7), ("b", 2 / 7), ("c", 1 / 7)))


def test_packing_stage_numbers_by_the_schedule(spark, tmp_path):
    docs = corpus(spark)
    steps = dict(pipeline.STAGES)
    mixed = shuffled_files(steps["source_mixing"](spark, docs, ""), str(tmp_path / "m"))
    at = {r.doc_id: (r.mix_slot, r.mix_row) for r in mix_sources(docs).collect()}
    first = collections.defaultdict(lambda: (1 << 40, 0))
    for r in steps["best_fit_packing"](spark, mixed, "").select("sequence_id", F.col("doc_id")).collect():
        first[r.sequence_id] = min(first[r.sequence_id], at[r.doc_id])
    assert [first[i] for i in sorted(first)] == sorted(first.values())

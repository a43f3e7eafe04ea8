from pyspark.sql import functions as F

from helpers import SCHEMA, frame, odd_texts, prose
from quire.llm.mixing import mix_sources


def check(spark, docs, block_rows, **options):
    rows = mix_sources(docs, block_rows=block_rows, bucket_rows=7, **options).collect()
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.mix_slot, []).append(r)
    assert sorted(slots) == list(range(len(slots)))
    for part in slots.values():
        assert len({r.mix_source for r in part}) == 1
        assert sorted(r.mix_row for r in part) == list(range(len(part))) and len(part) <= block_rows
    return rows, slots


def test_mixed_order(spark):
    n = {"a": 300, "b": 120, None: 50, "c": 7}
    data = [(i, prose(i, 5), "en", s, 3) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
    docs = spark.createDataFrame(data, SCHEMA).withColumn("mix_slot", F.lit("clash")).withColumn("count", F.lit(1))
    rows, slots = check(spark, docs, 3, weights={"a": 0.5, "b": 0.25, None: 0.125, "c": 0.125})
    share = {"=a": 32, "=b": 16, "null": 8, "=c": 8}
    assert sorted(r.doc_id for r in rows) == list(range(477))
    done = dict.fromkeys(share, 0)
    for t in range(len(slots)):
        if slots[t][0].mix_phase:
            break
        done[slots[t][0].mix_source] += 1
        assert all(abs(done[s] * 64 - share[s] * (t + 1)) < 64 for s in share)
    assert t > 10 and done["=c"] == 3


def test_odd_rows(spark):
    docs = frame(spark, odd_texts() * 2)
    check(spark, docs.union(docs), 4)
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0

"""Table functions called from SQL, against the operators on whole tables."""

import random

from pyspark.sql import functions as F

from quire.operators import segments
from quire.sources import tables


def texts():
    r = random.Random(5)
    words = ["alder", "birch.", "cedar!", "Meanwhile", "then", "elm,", "fir"]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    plain = ["\n\n".join(sentence(r.randrange(1, 90)) for _ in range(r.randrange(1, 14))) for _ in range(25)]
    headed = ["\n".join(f"CHAPTER {k}. The {sentence(2)}\n{sentence(40)}\n\n{sentence(9)}" for k in range(1, 5)) for _ in range(3)]
    return [*plain, *headed, "", " ", "one", "x" * 9000, "a b. " * 3000, None]


def test_chapters_and_pages_in_sql(spark):
    tables.register(spark)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string")
    docs.createOrReplaceTempView("table_docs")
    got = spark.sql("SELECT * FROM split_chapters(TABLE(table_docs) PARTITION BY (doc_id), 600)")
    want = segments.split_chapters(docs, budget=600).select(F.col("doc_id").cast("string"), "chapter_idx", "text", "anchor_line", "split_method")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    planned = got.withColumns({"chapter_id": F.concat(F.lit("ch-"), "chapter_idx"), "spread_count": (F.col("chapter_idx") % 5 + 1).cast("int")})
    planned.createOrReplaceTempView("table_chapters")
    pages = spark.sql("SELECT * FROM split_spreads(TABLE(table_chapters) PARTITION BY doc_id ORDER BY chapter_idx)").collect()
    cut = segments.page_segments(planned).select("doc_id", "chapter_idx", F.posexplode("segments").alias("spread_idx", "segment")).collect()
    assert sorted((p.doc_id, p.chapter_idx, p.spread_idx, p.segment) for p in pages) == sorted((p.doc_id, p.chapter_idx, p.spread_idx, p.segment) for p in cut)
    for doc_id in {p.doc_id for p in pages}:
        mine = sorted((p.chapter_idx, p.spread_idx, p.page_number) for p in pages if p.doc_id == doc_id)
        assert [n for *_, n in mine] == list(range(1, len(mine) + 1))

"""Running values against a plain fold, with a group that is most of all rows and so falls into many pieces."""

import random

from pyspark.sql import functions as F

from quire.functions.scan import scan

SCHEMA = "k string, at long, id long, v long, s string"


def fold(rows):
    out, state = {}, {}
    for k, at, i, v, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        n, total, top, low, last, x = state.get(k, (0, None, None, None, None, 0))
        if v is not None:
            n, total, top, low, x = n + 1, (total or 0) + v, v if top is None else max(top, v), v if low is None else min(low, v), x ^ v
        last = last if s is None else s
        state[k] = out[i] = (n, total, top, low, last, x)
    return out


def running(frame):
    got = scan(frame, ["k"], ["at", "id"], n=("count", F.col("v")), total=("sum", F.col("v")), top=("max", F.col("v")), low=("min", F.col("v")), last=("last", F.col("s")), x=("xor", F.col("v")))
    return {r.id: (r.n, r.total, r.top, r.low, r["last"], r.x) for r in got.collect()}


def rows(n, seed=3):
    r = random.Random(seed)
    key = lambda: "hot" if r.random() < 0.7 else r.choice([None, "", *"abcdefgh"])
    return [(key(), r.choice([None, *range(20)]), i, r.choice([None, r.randrange(-50, 50)]), r.choice([None, None, None, f"s{i}"])) for i in range(n)]


def test_a_hot_key_is_folded_over_many_pieces(spark):
    given = rows(1500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert running(spark.createDataFrame(given, SCHEMA)) == fold(given)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_group_no_rows_and_equal_rows(spark):
    assert running(spark.createDataFrame([], SCHEMA)) == {}
    got = scan(spark.createDataFrame([("a", 1)] * 300, "k string, at long"), [], ["at"], n=("count", F.lit(1)))
    assert sorted(r.n for r in got.collect()) == list(range(1, 301))


def test_a_column_may_be_replaced(spark):
    got = scan(spark.createDataFrame([("a", 1, 5), ("a", 2, 3)], "k string, at long, `v.x` long"), ["k"], ["at"], at=("count", F.lit(1)), total=("sum", F.col("`v.x`")))
    assert sorted((r["at"], r["v.x"], r.total) for r in got.collect()) == [(1, 5, 5), (2, 3, 8)]

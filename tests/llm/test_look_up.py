"""Joins and components where one key holds most rows."""

from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.staging import look_up


def test_frequent_keys_are_dealt_out(spark):
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("k <> 1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = look_up(rows, table, ["k"], "n", 4000, ["id"])
        assert found.columns == ["id", "k", "n", "top"]
        want = {(i, 0 if i % 3 == 0 else i): (None, None) if i == 1 else (1334, 3999) if i % 3 == 0 else (1, i) for i in range(4000)}
        assert {(r.id, r.k): (r.n, r.top) for r in found.collect()} == want
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r["count"] for r in look_up(rows, table, ["k"], "n", 4000, ["id"]).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1334  # the frequent key's rows are in several tasks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_components_of_stars(spark):
    """A node with very many links, as the smallest and as the largest of its component, and null-free results."""
    edges = [(i, 0) for i in range(10, 900)] + [(5000, i) for i in range(1000, 1900)] + [(1899, 899)]
    found = connected_components(spark.createDataFrame(edges, "high long, low long"))
    assert {r.node: r.component for r in found.collect()} == {n: 0 for n in [*range(10, 900), *range(1000, 1900), 5000]}

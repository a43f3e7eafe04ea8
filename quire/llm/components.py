"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import drop, look_up, stage_at


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (high, low; both long) is connected with.

    Each step is a grouped minimum and a join on the node. No neighbour list is ever built. The minimum is combined before the shuffle, and the join
    deals out the rows of nodes with very many links, so such a node costs no task more than others. The table of edges is staged after
    each round, and the one before it dropped; the loop ends when a round changes nothing, which takes about the logarithm of the longest path.
    """
    spark = edges.sparkSession
    edges, path = stage_at(edges.where("high <> low").select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct(), "edges")
    total = edges.count()
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
        up = both.where("other > node")
        least = both.groupBy("node").agg(F.min("other").alias("m"), F.count_if(F.col("other") > F.col("node")).alias("n")).where("n > 0").select("node", F.least("m", "node").alias("m"), "n")
        large = look_up(up, least, ["node"], "n", total, ["other"]).select(F.col("other").alias("high"), F.col("m").alias("low")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"), F.count("*").alias("n"))
        small = look_up(large, least, ["high"], "n", total, ["low"]).select(F.explode(F.array(F.struct(F.col("high"), F.col("m").alias("low")), F.struct(F.col("low").alias("high"), F.col("m").alias("low")))).alias("e")).select("e.*")
        before_path = path
        edges, path = stage_at(small.where("high <> low").distinct(), "edges")
        drop(spark, before_path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        total = now[0]
        if now == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
        before = now
    raise RuntimeError("components did not settle")

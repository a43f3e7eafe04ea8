"""Small helpers the operators have in common; tables in the shared folder are the library's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.staging import drop, shared_dir, shared_path, stage, stage_at

__all__ = ["drop", "look_up", "partitions", "shared_dir", "shared_path", "stage", "stage_at", "text_or_empty"]


def text_or_empty(docs: DataFrame, column: str = "text"):
    """The whole text, null as the empty string."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, salt: list[str], most: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``table`` (a row for each of their keys); ``weight`` says how many rows have the key, ``total`` how many there are.

    No task gets all rows of a frequent key. Fewer than ``most`` keys can each stand for more than one in ``most`` of all rows, so these few are broadcast,
    and their rows are dealt out by ``salt`` in the join of the others.
    """
    limit = max(64, total // most)
    values = [c for c in table.columns if c not in keys]
    frequent = table.where(F.col(weight) > limit).select(*keys, F.struct(*values).alias("look_hot"))
    marked = rows.join(F.broadcast(frequent), keys, "left")
    missing = reduce(Column.__or__, (F.col(k).isNull() for k in keys))  # null keys find nothing, and are many
    marked = marked.withColumn("look_piece", F.when(F.col("look_hot").isNull() & ~missing, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*salt), F.lit(4096)) + 1))
    # 0 for every row, in a form that isn't folded: a constant would no longer be a key of the join
    others = table.where(F.col(weight) <= limit).select(*keys, F.struct(*values).alias("look_cold"), F.pmod(F.col(weight).cast("long"), F.lit(1)).alias("look_piece"))
    found = marked.join(others, [*keys, "look_piece"], "left")
    return found.select(*rows.columns, *[F.coalesce(F.col(f"look_hot.{c}"), F.col(f"look_cold.{c}")).alias(c) for c in values])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

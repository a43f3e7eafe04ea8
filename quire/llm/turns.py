"""What the operators on conversations have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and tie of all rows with a conv_id; a null role or text is empty.

    tie: the SHA-256 of role and text, by which turns of one number are ordered. Equal ones are interchangeable.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return rows.withColumn("tie", turn_digest(F.col("role"), F.col("text")))


def turn_digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)

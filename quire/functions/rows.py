"""Shapes of rows that keep plans small and tasks even: columns worked out once, small scans dealt out, rows numbered in pieces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with new or replaced columns that are worked out once, however often later columns use them.

    The optimizer merges projections, and so copies a column's expression to each of its uses, into lambdas and filters too. It copies
    nothing over a generator: the columns pass through an array of one struct. Its outer form adds no filter of its own.
    """
    kept = [c for c in rows.columns if c not in columns]
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    order = [*rows.columns, *[n for n in columns if n not in rows.columns]]
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.explode_outer(made).alias("once_made")).select(*[F.col(f"once_made.`{c}`") if c in columns else F.col(f"`{c}`") for c in order])


def spread(rows: DataFrame) -> DataFrame:
    """A scan of fewer tasks than there are cores, dealt out to all of them; others as they are.

    A small file is one group of rows and so one task, whatever is done with its texts. A scan that gives every core a task is never shuffled.
    Rows are dealt out in turn and not by a key: Spark 4.1 takes a union of tables dealt out by one key for dealt out by it as a whole
    (``spark.sql.unionOutputPartitioning``), which left out rows of a window after such a union.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows.repartition(cores) if tasks < cores else rows


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, width: int = 16) -> DataFrame:
    """``rows`` with their number, from 0, within each group of ``by`` in this order.

    The first column of ``order`` is a whole number, or a struct that starts with one. Rows are numbered within pieces of ``2 ** width`` of its values, and a
    piece starts at the sum of the pieces before it. So a group of any size, of which a few may hold all rows, is spread over as many tasks
    as it has pieces; the sums are over a row for each piece.
    """
    kind = rows.schema[order[0]].dataType
    first = F.col(order[0]) if not hasattr(kind, "fields") else F.col(f"{order[0]}.{kind.fields[0].name}")
    pieces = rows.withColumn("num_piece", F.shiftright(first.cast("long"), width))
    sizes = pieces.groupBy(*by, "num_piece").agg(F.count("*").alias("num_rows"))
    before = sizes.select(*[F.col(b).alias(f"num_by_{b}") for b in by], F.col("num_piece").alias("num_of"), (F.sum("num_rows").over(Window.partitionBy(*by).orderBy("num_piece")) - F.col("num_rows")).alias("num_before"))
    inside = pieces.withColumn("num_inside", F.row_number().over(Window.partitionBy(*by, "num_piece").orderBy(*order)) - 1)
    same = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"num_by_{b}")) for b in by], F.col("num_piece").eqNullSafe(F.col("num_of")))
    return inside.join(before, same).select(*rows.columns, (F.col("num_inside") + F.col("num_before")).alias(name))

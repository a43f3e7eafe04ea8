"""Running values within groups of any size: an associative scan over pieces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.staging import stage

#: How a running value is made within a piece, summed up for a whole piece, and put behind the pieces before it.
_KINDS = {
    "count": (F.count, F.count, F.sum, lambda before, inside: F.coalesce(before, F.lit(0)) + inside),
    "sum": (F.sum, F.sum, F.sum, lambda before, inside: F.when(before.isNull() | inside.isNull(), F.coalesce(before, inside)).otherwise(before + inside)),
    "max": (F.max, F.max, F.max, lambda before, inside: F.greatest(before, inside)),
    "min": (F.min, F.min, F.min, lambda before, inside: F.least(before, inside)),
    "xor": (F.bit_xor, F.bit_xor, F.bit_xor, lambda before, inside: F.coalesce(before, F.lit(0)).bitwiseXOR(F.coalesce(inside, F.lit(0)))),
    "previous": (lambda c: F.last(c, ignorenulls=True), lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("scan_row"))), lambda c: F.last(c, ignorenulls=True), lambda before, inside: F.coalesce(inside, before)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("scan_row"))), lambda c: F.last(c, ignorenulls=True), lambda before, inside: F.coalesce(inside, before)),
}


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)], F.lit(True))


def deal(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` dealt out by ranges of the order and sorted, with scan_row, which ascends with it, and scan_part, the piece. To be written before ``carry``.

    A group of any size falls into pieces of about equal rows. Rows that are equal in all of ``order`` are taken in some order.
    """
    given = rows.withColumn("scan_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order, "scan_tie")]
    dealt = given.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("scan_tie").withColumn("scan_row", F.monotonically_increasing_id())
    return dealt.withColumn("scan_part", F.shiftright("scan_row", 33))


def carry(dealt: DataFrame, by: list[str], **columns: tuple[str, Column]) -> DataFrame:
    """What earlier pieces hand on: scan_at, the group as scan_by_0 and so on, and a running value scan_before_NAME for each of ``columns``.

    A row for each piece at most, as only the group that a piece starts with can have begun before it.
    """
    own = [f"scan_by_{i}" for i in range(len(by))]
    starts = F.min(F.col("scan_row")) == F.shiftleft("scan_part", 33)  # whether the piece starts with this group
    whole = dealt.groupBy("scan_part", *[F.col(b).alias(o) for b, o in zip(by, own, strict=True)]).agg(starts.alias("scan_first"), *[_KINDS[kind][1](c).alias(f"scan_of_{n}") for n, (kind, c) in columns.items()])
    firsts = whole.where("scan_first").select(*[F.col(o).alias(f"{o}_f") for o in own]).distinct()
    chain = whole.join(F.broadcast(firsts), _same(own, [f"{o}_f" for o in own]), "left_semi")
    before = Window.partitionBy(*own).orderBy("scan_part").rowsBetween(Window.unboundedPreceding, -1)
    return chain.select(F.col("scan_part").alias("scan_at"), *own, "scan_first", *[_KINDS[kind][2](F.col(f"scan_of_{n}")).over(before).alias(f"scan_before_{n}") for n, (kind, _) in columns.items()]).where("scan_first").drop("scan_first")


def put_behind(values: DataFrame, by: list[str], carried: DataFrame, **columns: str) -> DataFrame:
    """``values`` (with scan_part) whose running values within pieces, in scan_in_NAME, become those of whole groups. columns: name = kind. What ``carry`` found is broadcast."""
    own = [f"scan_by_{i}" for i in range(len(by))]
    found = values.join(F.broadcast(carried), (F.col("scan_part") == F.col("scan_at")) & _same(by, own), "left")
    kept = [c for c in values.columns if c not in columns and not c.startswith("scan_")]
    return found.select(*[F.col(f"`{c}`") for c in kept], *[_KINDS[kind][3](F.col(f"scan_before_{n}"), F.col(f"scan_in_{n}")).alias(n) for n, kind in columns.items()])


def scan(rows: DataFrame, by: list[str], order: list[str], **columns: tuple[str, Column]) -> DataFrame:
    """``rows`` with running values, each over the group's rows up to and including this one in this order.

    columns: name = (kind, column); kinds are count (of non-null values), sum, max, min, xor (whole numbers), last (the last non-null value) and
    previous (the last non-null value of the rows before this one). Nulls come first in the order, and a null key is a group of its own. Rows equal in all of ``order`` are taken in some order, each once.
    Pieces are written and folded by themselves, each behind what the pieces before it hand on. An empty table gives an empty result. Names that
    start with ``scan_`` are taken.
    """
    dealt = stage(deal(rows, by, order), "scan")
    inside = lambda kind: Window.partitionBy("scan_part", *by).orderBy("scan_row").rowsBetween(Window.unboundedPreceding, -1 if kind == "previous" else 0)
    values = dealt.select("*", *[_KINDS[kind][0](c).over(inside(kind)).alias(f"scan_in_{n}") for n, (kind, c) in columns.items()])
    return put_behind(values, by, carry(dealt, by, **columns), **{n: kind for n, (kind, _) in columns.items()})

"""Mixing sources to target weights by Pfair scheduling.

A source with weight w gets block i released at slot floor(i / w), with its deadline at slot ceil((i + 1) / w).
Taking, slot by slot, the released block with the earliest deadline gives every source, at every slot t, within
one block of w * t. Weights are held as whole numbers in their exact proportion, so no error adds up.
When a source has no more blocks, the others go on with their weights scaled up: a new phase.

Everything on rows is DataFrame expressions. The driver walks the slots once, from the number of rows of each source, and writes
the schedule, a row for each block, to a table as it goes; it holds no more than a block of each source.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.staging import look_up, shared_path, stage


def whole_numbers(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    parts = [float(w).as_integer_ratio() for w in weights]
    common = max(d for _, d in parts)  # powers of two
    return [n * (common // d) for n, d in parts]


def exact_slots(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, int]]:
    """(source, block, phase) of every slot in turn. Release and deadline of a block follow from the exact weight, over the whole phase.

    A phase ends before the first slot that its source can't fill. Sources without a weight come after all others, in equal shares.
    """
    left, done, phase = list(blocks), [0] * len(blocks), 0
    while any(left):
        live = [s for s in range(len(left)) if left[s] and weights[s] > 0] or [s for s in range(len(left)) if left[s]]
        share = dict(zip(live, whole_numbers([weights[s] if weights[s] > 0 else 1.0 for s in live]), strict=True))
        total = sum(share.values())
        # the first block of every source is ready in slot 0
        ready = [(-(-total // share[s]), s, 0) for s in live]
        heapq.heapify(ready)
        release: list[tuple[int, int, int]] = []
        for t in itertools.count():
            while release and release[0][0] <= t:
                _, s, i = heapq.heappop(release)
                heapq.heappush(ready, (-(-(i + 1) * total // share[s]), s, i))
            _, s, i = heapq.heappop(ready)
            if not left[s]:
                break
            yield s, done[s], phase
            left[s] -= 1
            done[s] += 1
            heapq.heappush(release, ((i + 1) * total // share[s], s, i + 1))
        phase += 1


def _written(spark: SparkSession, lines: Iterator[str], name: str) -> str:
    """Path of a text file in the shared folder. Lines are written as they come; the driver never holds them all."""
    path = shared_path(spark, name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        while part := "".join(itertools.islice(lines, 50_000)):
            out.write(bytearray(part.encode()))
    finally:
        out.close()
    return path


def mix_sources(docs: DataFrame, weights: dict | Callable[[str | None, int], float] | None = None, power: float = 0.5, block_rows: int = 16, bucket_rows: int = 2048) -> DataFrame:
    """``docs`` with mix_source, mix_phase, mix_slot (the block's place) and mix_row (the row's place in its block).

    Every row stays, once. Rows of a source follow a hash order, in blocks of ``block_rows``; the last may be shorter. Throughout a phase every
    source keeps within one block of its exact weight; each later phase lacks the sources that are through.
    weights: by source, or a function of a source and its number of rows; those not named, and those of no weight, get nothing until the others are through. Default: rows of the source to the ``power``.
    A null source is a source of its own, and null and repeated doc_ids are
    rows like any other. Columns of ``docs`` may have any names; those of the four new ones are replaced. Any number of sources is scheduled; the driver holds a few numbers for each. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("mix_source", "mix_phase", "mix_slot", "mix_row")]
    kept = docs.select(*[F.col(f"`{n}`") for n in names])
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    counts = kept.groupBy(key.alias("mix_source")).count().orderBy("mix_source").collect()
    if not counts:
        return kept.select("*", key.alias("mix_source"), *[F.lit(0).cast(k).alias(n) for n, k in (("mix_phase", "int"), ("mix_slot", "long"), ("mix_row", "int"))])
    name = lambda key: None if key == "null" else key[1:]
    if weights is None:
        weights = lambda _, rows: float(rows) ** power
    weigh = weights if callable(weights) else lambda source, _: weights.get(source, 0.0)
    given = [max(float(weigh(name(c.mix_source), c["count"])), 0.0) for c in counts]
    blocks = [-(-c["count"] // block_rows) for c in counts]
    spark = docs.sparkSession
    named = _written(spark, (json.dumps({"mix_source": c.mix_source, "mix_key": s, "mix_buckets": max(1, c["count"] // bucket_rows), "mix_count": c["count"]}) + "\n" for s, c in enumerate(counts)), "mix-sources")
    sources = spark.read.schema("mix_source string, mix_key int, mix_buckets long, mix_count long").json(named)
    planned = _written(spark, (f"{s},{block},{phase},{slot}\n" for slot, (s, block, phase) in enumerate(exact_slots(blocks, given))), "mix-slots")
    schedule = spark.read.schema("mix_key int, mix_block long, mix_phase int, mix_slot long").csv(planned)

    # a row's number in its source: rows of smaller buckets, and then its place in its own; no window holds a whole source
    shuffled = F.xxhash64(*[F.col(f"`{n}`") for n, kind in kept.dtypes if not kind.startswith(("map", "variant"))])
    # columns stand under numbers here, so that none of their names can be taken for one of these, and unused ones are still left out of the scan
    numbers = {n: f"mix_{i}" for i, n in enumerate(names)}
    rows = kept.select(*[F.col(f"`{n}`").alias(c) for n, c in numbers.items()], key.alias("mix_source"), shuffled.alias("mix_hash"))
    total = sum(c["count"] for c in counts)
    marked = look_up(rows, sources, ["mix_source"], "mix_count", total, ["mix_hash"]).drop("mix_count").withColumn("mix_bucket", F.pmod("mix_hash", "mix_buckets"))
    sizes = marked.groupBy("mix_key", "mix_bucket").count()
    before = sizes.select("mix_key", "mix_bucket", (F.sum("count").over(Window.partitionBy("mix_key").orderBy("mix_bucket")) - F.col("count")).alias("mix_before"))
    number = F.row_number().over(Window.partitionBy("mix_key", "mix_bucket").orderBy("mix_hash", *[numbers[n] for n in ("doc_id",) if n in names])) - 1
    placed = marked.withColumn("mix_number", number).join(stage(before, "mix-buckets"), ["mix_key", "mix_bucket"])
    placed = placed.withColumn("mix_number", F.col("mix_number") + F.col("mix_before")).withColumn("mix_block", F.floor(F.col("mix_number") / block_rows).cast("long"))
    found = placed.join(schedule, ["mix_key", "mix_block"])
    return found.select(*[F.col(c).alias(n) for n, c in numbers.items()], "mix_source", "mix_phase", "mix_slot", (F.col("mix_number") % block_rows).cast("int").alias("mix_row"))

"""Exact top-k inner products by tiles.

Candidates are dealt into groups, each of which one task holds, and stay there. Blocks of queries are copied to the groups and stream
through them: a tile is one block of queries against one part of a group, a matrix product of which only each query's k best scores are
kept. What a group has found for a query leaves it as one list; lists are merged in a tree, first those of neighbouring groups, then
those of the whole. So candidates cross the network once, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.staging import partitions

_EXACT = 1 << 53
_PACKED = "group long, dim int, kind int, ids binary, vectors binary"
_FOUND = "level long, query_id long, vec_id long, score long"
#: Bytes of packed rows that a task holds before it passes them on, and at most in one block.
_HELD, _BLOCK = 32 << 20, 1 << 20


def _narrow(x: np.ndarray) -> np.ndarray:
    """The smallest integers that hold these."""
    most = max(-int(x.min(initial=0)) - 1, int(x.max(initial=0)))
    return x.astype(next(k for k, n in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 1 << n))


def _packed(group: int, dim: int, kind: int, ids: list[np.ndarray], vectors: list[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of at most ``size`` rows; the width of the numbers follows from the lengths."""
    all_ids, all_vectors = np.concatenate(ids), np.concatenate(vectors)
    step = max(1, min(size, _BLOCK // max(1, 8 * dim)))
    for a in range(0, len(all_ids), step):
        cells = [[group], [dim], [kind], [all_ids[a : a + step].tobytes()], [_narrow(all_vectors[a : a + step]).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["group", "dim", "kind", "ids", "vectors"])


def _pack(kind: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}
        n_bytes = 0
        for batch in batches:
            ids, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(2)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            firsts = np.cumsum(dims, dtype=np.int64) - dims
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                vectors = flat[firsts[own][:, None] + np.arange(dim)]
                for place in np.unique(places[own]).tolist():
                    mine = places[own] == place
                    kept = held.setdefault((place, dim), ([], []))
                    kept[0].append(ids[own][mine])
                    kept[1].append(vectors[mine])
            n_bytes += 8 * (len(flat) + len(ids))
            if n_bytes > _HELD:
                for (place, dim), rows in held.items():
                    yield from _packed(place, dim, kind, *rows, size)
                held, n_bytes = {}, 0
        for (place, dim), rows in held.items():
            yield from _packed(place, dim, kind, *rows, size)

    return run


def _unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids) // 8
    wide = len(vectors) // max(1, n * dim) if dim else 8
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, f"<i{wide}").reshape(n, dim) if dim else np.zeros((n, 0), np.int64)


def products(q: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """q @ x.T of whole numbers as int64, or the nearest to it but the smallest. most: what no sum of a product's absolute terms exceeds."""
    if most < _EXACT:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = q.astype(object) @ x.astype(object).T
    bound = np.iinfo(np.int64).max
    return np.minimum(np.maximum(exact, -bound), bound).astype(np.int64)


_NONE = np.iinfo(np.int64).min


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores above _NONE; ties go to the smaller column."""
    n = score.shape[1]
    if n > k:
        least = np.partition(score, n - k, axis=1)[:, n - k, None]
        over, tie = score > least, score == least
        # of the scores that tie for the last places, the first columns
        keep = over | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - over.sum(1, keepdims=True)))
    else:
        keep = np.ones(score.shape, bool)
    return np.nonzero(keep & (score != _NONE))


class Group:
    """The candidates of one group, of one length, in parts of a bounded number of rows; ids ascend over all parts."""

    def __init__(self, ids: list[np.ndarray], vectors: list[np.ndarray], part: int) -> None:
        all_ids, all_vectors = np.concatenate(ids), np.concatenate(vectors)
        order = np.argsort(all_ids, kind="stable")
        self.ids, self.vectors = all_ids[order], all_vectors[order]
        self.largest, self.part = _largest(self.vectors), part

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vec_id, score) of each query's k best here."""
        most = _largest(q) * self.largest * max(1, q.shape[1])
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # row of the query, place of the candidate, score
        for a in range(0, len(self.ids), self.part):
            score = products(q, self.vectors[a : a + self.part], most)
            score[q_ids[:, None] == self.ids[None, a : a + self.part]] = _NONE
            row, column = best(score, k)
            row, place, value = (np.concatenate(x) for x in zip(held, (row, column + a, score[row, column]), strict=True))
            order = np.lexsort((place, -value, row))
            row, place, value = row[order], place[order], value[order]
            first = np.searchsorted(row, row)
            keep = np.arange(len(row)) - first < k
            held = row[keep], place[keep], value[keep]
        return q_ids[held[0]], self.ids[held[1]], held[2]


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def _search(k: int, part: int, tile: int, fan_in: int):
    """Rows come by group and length, candidates before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, group = None, [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["group"], row["dim"]) != key:
                    key, ids, vectors, group = (row["group"], row["dim"]), [], [], None
                own_ids, own = _unpacked(row["ids"], row["vectors"], row["dim"])
                if row["kind"] == 0:
                    ids.append(own_ids)
                    vectors.append(own)
                    continue
                if not ids:
                    continue
                group = group or Group(ids, vectors, part)
                for a in range(0, len(own_ids), tile):
                    found = group.search(own_ids[a : a + tile], own[a : a + tile], k)
                    level = np.full(len(found[0]), row["group"] // fan_in)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (level, *found)], names=["level", "query_id", "vec_id", "score"])

    return run


def whole_numbers(vector: Column) -> Column:
    """floor(64 x) of each component as a long, or the nearest long; null unless all are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 64).cast("long")))


def top_products(vectors: DataFrame, queries: Column, k: int = 20, query_block: int = 1024, block: int = 8192, fan_in: int = 16, group_bytes: int = 64 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with rows of another vec_id.

    vectors: vec_id and embedding; other columns are not read. queries: which rows are queries. Ties go to the smaller vec_id. Rows with a null
    vec_id, a null vector, or a null or non-finite component take no part. Vectors are compared with those of their own length, and empty ones
    with none. Every row is a candidate, repeated ones too, each for itself; rows that repeat a query word for word ask once, and rows of one vec_id with
    different vectors share one list, of the best of all their pairs. With fewer than k others, all are returned. Products are exact where they, and
    the components times 64, are longs; others are the nearest long, and so tie. Names of other columns don't matter. An empty table gives an empty result.

    query_block: queries to a block and to a tile. block: candidates to a tile. group_bytes: of a group's vectors as 8-byte numbers, at most about.
    """
    spark = vectors.sparkSession
    is_query = F.coalesce(queries, F.lit(False)).alias("is_query")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), whole_numbers(F.col("embedding")).alias("v"), is_query).where("id is not null and size(v) > 0")
    known = rows.agg(F.count("*").alias("n"), F.sum(F.size("v").cast("long") * 8).alias("bytes")).first()
    if not known.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # as many groups as their size asks for, and no fewer than keep the tasks busy, while each has work for a tile
    groups = max(1, -(-known.bytes // group_bytes), min(partitions(spark), -(-known.n // block)))
    group = F.pmod(F.xxhash64("id", F.col("v"), F.lit(5)), F.lit(groups)).cast("long")
    candidates = rows.select("id", group.alias("place"), "v").mapInArrow(_pack(0, block), _PACKED)
    # a query's copies go to every group; blocks are made first, so that what is copied is packed
    asked = rows.where("is_query").groupBy("id", "v").agg(F.lit(0).cast("long").alias("place")).select("id", "place", "v").mapInArrow(_pack(1, query_block), _PACKED)
    sent = asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    dealt = candidates.unionByName(sent.select(*candidates.columns)).repartition(F.col("group")).sortWithinPartitions("group", "dim", "kind")
    found = dealt.mapInArrow(_search(k, block, min(query_block, 256), fan_in), _FOUND)
    order = [F.desc("score"), "vec_id"]
    merged = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "level").orderBy(*order))).where(F.col("rank") <= k)
    merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")

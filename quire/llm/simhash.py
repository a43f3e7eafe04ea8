"""Near duplicates by SimHash fingerprints and BK-trees.

Fingerprints are cut into ``blocks`` blocks. Two of them that differ in at most ``radius`` bits agree on at least
``blocks - radius`` whole blocks, so every link is inside a shard of fingerprints that share that many blocks.
Each shard gets a BK-tree whose edges are integer Hamming distances; it goes to the task that holds the shard's
queries, and a search follows only edges within the radius. Shards over ``shard_rows`` are split into chunks, and
every pair of chunks becomes a shard of its own, so that no task holds more than two chunks of one key.
A shard returns a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.staging import look_up, stage, text_or_empty

_STEP = 1 << 16


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of the XXH64 values of the word shingles; no words: 0."""
    tokens = text.lower().split()
    n = len(tokens) - words + 1
    if not tokens:
        return 0
    body = b" ".join(tokens)
    if n <= 1:
        return xxhash.xxh64_intdigest(body, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for a in range(0, n, _STEP):
        b = min(n, a + _STEP)
        part = [digest(body[s:e], 42) for s, e in zip(starts[a:b].tolist(), (ends[a + words - 1 : b + words - 1] - 1).tolist(), strict=True)]
        ones += np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


class BKForest:
    """BK-trees of many shards at once; node i is row i. Rows of a shard are neighbours and their prints differ."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray) -> None:
        self.prints = prints
        new = np.concatenate(([True], shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.root = first[np.cumsum(new) - 1] if len(shard) else np.zeros(0, np.int64)
        rest = np.flatnonzero(~new)
        at, edges, children = self.root[rest], [], []
        while len(rest):
            edge = at * 65 + np.bitwise_count(prints[rest] ^ prints[at])
            order = np.argsort(edge, kind="stable")
            edge, rest = edge[order], rest[order]
            new = np.concatenate(([True], edge[1:] != edge[:-1]))
            child = rest[np.flatnonzero(new)]
            edges.append(edge[new])
            children.append(child)
            at, rest = child[np.cumsum(new) - 1][~new], rest[~new]
        edges_all = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(edges_all)
        self.edge, self.child = edges_all[order], (np.concatenate(children)[order] if edges else np.zeros(0, np.int64))

    def within(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, row) within the radius of each other; each once, larger row first."""
        at = self.root[query]
        while len(query):
            d = np.bitwise_count(self.prints[query] ^ self.prints[at]).astype(np.int64)
            hit = (d <= radius) & (at < query)
            yield query[hit], at[hit]
            low = np.searchsorted(self.edge, at * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge, at * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            query = np.repeat(query, n)
            at = self.child[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(query))]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the smallest row it is connected with."""
    label = np.arange(n)
    for a, b in pairs:
        a, b = label[a], label[b]
        while True:
            live = a != b
            if not live.any():
                break
            a, b = a[live], b[live]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            a, b = label[high], label[low]
    return label


def _edges(cells: np.ndarray, prints: np.ndarray, ids: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges of whole shards."""
    order = np.lexsort((ids, *cells))
    cells, prints, ids = cells[:, order], prints[order].view(np.uint64), ids[order]
    shard = np.concatenate(([0], np.cumsum((cells[:, 1:] != cells[:, :-1]).any(0))))
    forest, n = BKForest(shard, prints), len(ids)
    pairs = (pair for a in range(0, n, 1 << 14) for pair in forest.within(np.arange(a, min(n, a + (1 << 14))), radius))
    low = spanning(n, pairs)
    moved = np.flatnonzero(low != np.arange(n))
    if len(moved):
        edges = np.unique(np.stack([ids[moved], ids[low[moved]]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(edges.max(0)), pa.array(edges.min(0))], names=["high", "low"])


def _link(radius: int, held: int = 1 << 18):
    """Edges of shards that come one after another. A task holds about ``held`` rows, and never less than the one shard that they belong to, whose size is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= held:
                whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
                cells = np.stack(whole[:-2])
                other = np.flatnonzero((cells != cells[:, -1:]).any(0))
                cut = int(other[-1]) + 1 if len(other) else 0  # where the last shard, which may go on, begins
                if cut:
                    yield from _edges(cells[:, :cut], whole[-2][:cut], whole[-1][:cut], radius)
                parts, n = [[c[cut:] for c in whole]], n - cut
        if n:
            whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield from _edges(np.stack(whole[:-2]), whole[-2], whole[-1], radius)

    return run


def _shards(prints: DataFrame, radius: int, blocks: int, shard_rows: int) -> DataFrame:
    """(combo, value, chunk pair, print, rep): a row for each shard in which a print stands."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    cut = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.struct(F.lit(i).alias("combo"), F.col("print").bitwiseAND(F.lit(signed(sum(c))).cast("long")).alias("value")) for i, c in enumerate(combinations(cut, blocks - radius))]
    keyed = prints.select("print", "rep", F.explode(F.array(*keys)).alias("k")).select("print", "rep", "k.combo", "k.value")
    large = keyed.groupBy("combo", "value").count().where(F.col("count") > shard_rows).select("combo", "value", F.ceil(F.col("count") / shard_rows).cast("int").alias("chunks"))
    keyed = keyed.join(large, ["combo", "value"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("print", F.lit(7)), F.col("chunks")).cast("int")
    keyed = keyed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return keyed.select(F.col("combo").cast("long").alias("combo"), "value", F.least("mine", "other").cast("long").alias("i"), F.greatest("mine", "other").cast("long").alias("j"), "print", "rep")


def link_prints(prints: DataFrame, radius: int = 4, blocks: int = 6, shard_rows: int = 8192) -> DataFrame:
    """Edges (high, low) between representatives whose components are those of all links within ``radius``.

    prints: distinct (print long, rep long). Any larger ``blocks`` gives smaller shards and more copies of a row.
    """
    if not radius < blocks <= 16:
        raise ValueError("blocks must exceed the radius")
    shards = _shards(prints, radius, blocks, shard_rows)
    cells = ["combo", "value", "i", "j"]
    linked = shards.repartition(*cells).sortWithinPartitions(*cells).mapInArrow(_link(radius), "high long, low long")
    return linked.distinct()


def simhash_components(docs: DataFrame, radius: int = 4, words: int = 4, blocks: int = 6, shard_rows: int = 8192) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of anything but ASCII white space, in the whole text with A-Z lower-cased; a bit is set if more
    than half of the shingles' hashes have it (a tie leaves 0). Null and empty texts have the fingerprint zero and
    link like any other. component_id is the smallest doc_id that links of at most ``radius`` bits reach. Rows without a
    doc_id take no part; repeated rows are returned as often. Other columns are not read, whatever their names, and texts of any length are read
    to their end. A block's value that very many different prints share is the dear case: all pairs of its chunks are shards, so that no task holds more
    than two, and its work is the square of its prints. An empty table gives an empty result.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).cast("binary").alias("body"))
    marked = stage(rows.mapInArrow(_fingerprints(words), "doc_id long, print long"), "prints")
    prints = stage(marked.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    labels = connected_components(link_prints(prints, radius, blocks, shard_rows))
    found = prints.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"), "copies")
    return look_up(marked, found, ["print"], "copies", marked.count(), ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

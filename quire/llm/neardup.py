"""Near duplicates by SimHash with a checked similarity: groups of documents whose sets of word shingles are alike.

The rule is the Jaccard similarity of two documents' sets of shingles, held against a threshold. SimHash and BK-trees propose, the sets decide. Two
documents as alike as the threshold asks differ in about ten of 64 SimHash bits, too many for blocks that agree. So shards are
made by bands of smallest shingle hashes, in one of which such documents nearly surely meet; each shard has a BK-tree of its fingerprints, a search follows
the edges within a wide radius, and every link that it proposes between groups not yet joined is checked on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.simhash import BKForest
from quire.llm.staging import look_up, stage, text_or_empty

_STEP = 1 << 16


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """XXH64 values of the word shingles, each once, in order; A-Z count as a-z. Fewer words are one shingle, none is the empty set."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    body, n = b" ".join(tokens), len(tokens) - words + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(body, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(body[s:e], 42) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets, as ordered arrays, have at least this Jaccard similarity. Two empty sets are alike."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _sketch(shingles: np.ndarray, factors: np.ndarray) -> tuple[int, np.ndarray]:
    """(SimHash, smallest values under each factor) of a set."""
    ones, least = np.zeros(64, np.int64), np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), _STEP):
        part = shingles[a : a + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        mixed = part[:, None] * factors
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(0))
    return int.from_bytes(np.packbits(2 * ones > len(shingles), bitorder="little").tobytes(), "little"), least


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_MARKED = "doc_id long, high long, low long, n long, print long, bands array<long>"


def _mark(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(bands * rows)
        for batch in batches:
            found = []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                whole, (simhash, least) = xxhash.xxh128_intdigest(s.tobytes()), _sketch(s, factors)
                keys = [xxhash.xxh64_intdigest(part.tobytes()) for part in least.reshape(bands, rows)]
                found.append((whole >> 64, whole & (1 << 64) - 1, len(s), simhash, keys))
            signed = lambda i: pa.array(np.array([f[i] for f in found], np.uint64).view(np.int64))
            keys = np.array([f[4] for f in found], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(0), signed(1), signed(2), signed(3), lists], names=[f.split()[0] for f in _MARKED.split(", ")])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "shingles"])

    return run


def links(prints: list[int], sets: list[np.ndarray], least: float, radius: int) -> list[tuple[int, int]]:
    """Pairs of rows that are alike, enough of them to connect all that are: pairs within a group that is connected already aren't checked."""
    label = np.arange(len(sets))
    out = []
    forest = BKForest(np.zeros(len(sets), np.int64), np.array(prints, np.int64).view(np.uint64))
    for a in range(0, len(sets), 256):
        for x, y in forest.within(np.arange(a, min(len(sets), a + 256)), radius):
            apart = label[x] != label[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                if label[i] != label[j] and similar(sets[i], sets[j], least):
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
                    out.append((i, j))
    return out


def _link(least: float, radius: int):
    """Rows of (band, key, i, j, rep, print, shingles) come shard by shard; one shard is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reps, prints, sets, edges = None, [], [], [], []

        def close() -> None:
            edges.extend((max(reps[i], reps[j]), min(reps[i], reps[j])) for i, j in links(prints, sets, least, radius))
            for held in (reps, prints, sets):
                held.clear()

        def out() -> pa.RecordBatch:
            high, low = zip(*edges, strict=True) if edges else ((), ())
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["high", "low"])

        for batch in batches:
            heads = zip(*[batch.column(c).to_pylist() for c in ("band", "key", "i", "j", "rep", "print")], strict=True)
            for (*shard, rep, simhash), shingles in zip(heads, batch.column("shingles"), strict=True):
                if shard != last:
                    close()
                    last = shard
                reps.append(rep)
                prints.append(simhash)
                sets.append(np.frombuffer(shingles.as_py(), np.uint64))
            yield out()
        close()
        yield out()

    return run


def near_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 6, rows: int = 3, radius: int = 16, shard_rows: int = 1024) -> DataFrame:
    """One row for each document: doc_id, component_id.

    Documents link where the Jaccard similarity of their sets of ``words``-word shingles is at least ``similarity``; words are runs of anything but ASCII
    white space, in the whole text, A-Z as a-z. component_id is the smallest doc_id that found links reach. No link is wrong; a pair is found if its sets
    agree on ``rows`` smallest hashes in one of ``bands`` bands and its SimHashes differ in at most ``radius`` bits, which at a similarity
    of 0.8 is so for 97 in 100. Texts of fewer words are one shingle; those without words are alike. Null texts count as empty. Rows
    without a doc_id take no part; repeated rows are returned as often, and a doc_id that stands for several sets joins what they link. Other columns are not read. An empty table gives an empty result.

    Documents of one set stand for each other before anything else. Sets are made again for those documents alone that share a band with another. Bands of
    over ``shard_rows`` sets are split into chunks, of which every pair is a shard: a task holds two chunks of one band, and pairs within a
    group that is connected already are not checked.
    """
    text = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).cast("binary").alias("body"))
    marked = stage(text.mapInArrow(_mark(words, bands, rows), _MARKED), "marked")
    same = ["high", "low", "n"]
    reps = marked.groupBy(*same).agg(F.min(F.struct("doc_id", "print", "bands")).alias("first"), F.count("*").alias("copies"))
    reps = stage(reps.select(*same, "copies", F.col("first.doc_id").alias("rep"), F.col("first.print").alias("print"), F.col("first.bands").alias("bands")), "reps")
    keyed = reps.select("rep", "print", F.posexplode("bands").alias("band", "key"))
    shared = stage(keyed.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    total = reps.count()
    met = look_up(keyed, shared, ["band", "key"], "size", total, ["rep"]).where("size > 1").withColumn("chunks", F.ceil(F.col("size") / shard_rows).cast("int"))
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = stage(met.select("band", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep", "print"), "met")
    wanted = text.join(met.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = wanted.mapInArrow(_sets(words), "rep long, shingles binary")
    shard = ["band", "key", "i", "j"]
    linked = met.join(sets, "rep").repartition(*shard).sortWithinPartitions(*shard, "rep").select(*shard, "rep", "print", "shingles").mapInArrow(_link(similarity, radius), "high long, low long")
    labels = connected_components(linked.distinct())
    found = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"), "copies")
    return look_up(marked.select("doc_id", *same), found, same, "copies", marked.count(), ["doc_id"]).select("doc_id", "component_id")

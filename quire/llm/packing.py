"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Pieces as long as a sequence stand alone. The others are dealt into problems of a bounded number of pieces that follow each
other in the input, so that documents which were mixed well before are packed with their neighbours.
Each problem is evolved on several islands, which are rows of a table and so tasks of their own. A chromosome is a list
of bins. Crossover injects whole well-filled bins of one parent into another, removes the bins that then hold a
piece twice, and puts their other pieces back by best fit. After each epoch every island sends its best
packing to the next island of its ring. A problem stops as soon as it reaches the lower bound on bins.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.staging import stage, text_or_empty
from quire.llm.tokens import WordEncoder, default_path

_PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            if rows:
                a, b, c, d, e = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), *(pa.array(x, pa.int64()) for x in (c, d, e))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Bin(list):
    """Piece numbers, with the sum of their lengths."""

    __slots__ = ("full",)

    def __init__(self, items=(), full: int = 0) -> None:
        super().__init__(items)
        self.full = full

    def copy(self) -> Bin:
        return Bin(self, self.full)


class Problem:
    """Pieces by length and packings of them; a packing is a list of bins."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.bound = -(-sum(lengths) // capacity)

    def bin(self, part: list[int]) -> Bin:
        return Bin(part, sum(map(self.lengths.__getitem__, part)))

    def fill(self, part: Bin) -> int:
        return part.full

    def best_fit(self, bins: list[Bin], loose: list[int], noise: random.Random | None = None, strength: float = 0.0) -> list[Bin]:
        """Put the loose pieces, longest first, into the fullest bins that have room; a bit set holds the rooms there are."""
        n = self.lengths
        rooms: dict[int, list[int]] = {}
        mask = 0
        for i, part in enumerate(bins):
            room = self.capacity - part.full
            rooms.setdefault(room, []).append(i)
            mask |= 1 << room
        key = (lambda i: -n[i]) if noise is None else (lambda i: -n[i] * (1 + strength * noise.random()))
        for i in sorted(loose, key=key):
            fits = mask >> n[i]
            if fits:
                room = n[i] + (fits & -fits).bit_length() - 1
                have = rooms[room]
                at = have.pop()
                if not have:
                    mask ^= 1 << room
                bins[at].append(i)
                bins[at].full += n[i]
            else:
                room, at = self.capacity, len(bins)
                bins.append(Bin([i], n[i]))
            room -= n[i]
            if not rooms.get(room):
                rooms[room] = []
                mask |= 1 << room
            rooms[room].append(at)
        return bins

    def fitness(self, bins: list[Bin]) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean square of the fill)."""
        return -len(bins), sum(b.full**2 for b in bins) / max(1, len(bins))

    def crossover(self, into: list[Bin], other: list[Bin], noise: random.Random) -> list[Bin]:
        """Inject whole well-filled bins of ``other``; bins that hold one of their pieces go, and what else they held is put back by best fit."""
        full = sorted(other, key=self.fill, reverse=True)[: max(1, len(other) * 2 // 3)]
        injected = [b.copy() for b in noise.sample(full, max(1, len(full) // 3))]
        taken = {i for b in injected for i in b}
        kept, loose = [], []
        for part in into:
            if taken.isdisjoint(part):
                kept.append(part.copy())
            else:
                loose += [i for i in part if i not in taken]
        return self.best_fit(kept + injected, loose)

    def mutate(self, bins: list[Bin], noise: random.Random) -> list[Bin]:
        """Empty the emptiest bins and a few others, and put their pieces back."""
        order = sorted(bins, key=self.fill)
        few = 1 + len(order) // 50
        out = order[:few] + noise.sample(order[few:], min(len(order) - few, few))
        gone = {id(b) for b in out}
        return self.best_fit([b.copy() for b in bins if id(b) not in gone], [i for b in out for i in b], noise, 0.3)

    def evolve(self, start: list[list[list[int]]], noise: random.Random, population: int, generations: int) -> list[Bin]:
        every = list(range(len(self.lengths)))
        judged = lambda bins: (self.fitness(bins), bins)  # noqa: E731  a packing never changes, and is judged once
        people = [judged(p) for p in [*([self.bin(b) for b in packing] for packing in start), self.best_fit([], every)]]
        best = max(people, key=lambda p: p[0])
        if len(best[1]) <= self.bound:
            return best[1]
        while len(people) < population:
            people.append(judged(self.best_fit([], every, noise, 0.05 * len(people))))
        for _ in range(generations):
            people.sort(key=lambda p: p[0], reverse=True)
            a, b = people[0][1], noise.choice(people[1:])[1]
            child = self.crossover(b, a, noise)
            if noise.random() < 0.7:
                child = self.mutate(child, noise)
            people[-1] = judged(child)
            best = max(best, people[-1], key=lambda p: p[0])
            if len(best[1]) <= self.bound:
                break
        return best[1]


def _bins(slots: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(slots):
        bins.setdefault(b, []).append(i)
    return list(bins.values())


def _evolve(capacity: int, population: int, generations: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                problem = Problem(row["lengths"], capacity)
                start = [_bins(s) for s in (row["elite"], row["migrant"]) if s]
                best = problem.evolve(start, random.Random(f"{seed}:{row['problem']}:{row['island']}:{len(start)}"), population, generations)
                slots = [0] * len(row["lengths"])
                for b, part in enumerate(best):
                    for i in part:
                        slots[i] = b
                n, full = problem.fitness(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["problem"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([row["lengths"]], pa.list_(pa.int32())), pa.array([slots], pa.list_(pa.int32())), pa.array([n], pa.int32()), pa.array([full], pa.float64())],
                    names=["problem", "island", "lengths", "elite", "n", "full"],
                )

    return run


_ISLAND = "problem long, island int, lengths array<int>, elite array<int>, n int, full double"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at: dict[int, int] = {}
            offsets = []
            for b, n in zip(row["elite"], row["lengths"], strict=True):
                offsets.append(at.get(b, 0))
                at[b] = offsets[-1] + n
            # a sequence is named after its first piece, so ids follow the order of the pieces, across problems too
            first: dict[int, int] = {}
            for b, item in zip(row["elite"], row["items"], strict=True):
                first[b] = min(item, first.get(b, item))
            names = [first[b] for b in row["elite"]]
            yield pa.RecordBatch.from_arrays([pa.array(row["items"], pa.int64()), pa.array(names, pa.int64()), pa.array(offsets, pa.int64())], names=["item", "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = 2048, problem_rows: int = 6000, islands: int = 3, epochs: int = 2, population: int = 5, generations: int = 12, seed: int = 3) -> DataFrame:
    """(item, sequence_id, offset) for pieces (item long, unique; length from 1 to capacity).

    The upper bits of an item, from 33 on, name the partition it was in; below, items count up. Neighbours share a problem.
    """
    alone = pieces.where(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("length"))
    part = F.shiftright("item", 33)
    sizes = pieces.groupBy(part.alias("part")).agg((F.max("item").bitwiseAND((1 << 33) - 1) + 1).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    place = F.col("before") + F.col("item").bitwiseAND((1 << 33) - 1)
    short = short.withColumn("part", part).join(before, "part")
    dealt = short.groupBy(F.floor(place / problem_rows).cast("long").alias("problem")).agg(F.sort_array(F.collect_list(F.struct("length", "item")), asc=False).alias("p"))
    problems = stage(dealt.select("problem", F.col("p.length").alias("lengths"), F.col("p.item").alias("items")), "problems")
    ring = F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
    none = F.lit(None).cast("array<int>")
    state = problems.select("problem", ring.alias("island"), "lengths", none.alias("elite"), none.alias("migrant"))
    for epoch in range(epochs):
        if epoch:
            moved = state.select("problem", ((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("migrant"))
            state = state.select("problem", "island", "lengths", "elite").join(moved, ["problem", "island"])
        state = stage(state.repartition("problem", "island").mapInArrow(_evolve(capacity, population, generations, seed), _ISLAND), "islands")
    best = state.groupBy("problem").agg(F.max_by("elite", F.struct("n", "full", "island")).alias("elite"))
    return alone.unionByName(problems.join(best, "problem").select("problem", "lengths", "items", "elite").mapInArrow(_place, "item long, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, order: tuple[str, ...] = (), **options) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then id 0, so a null or empty text is one piece of one id. Only documents longer than
    ``capacity`` are cut, into pieces of that length and a shorter last one. Sequences are filled without gaps. Pieces
    are numbered by the columns in ``order``, or else as the rows are read; a sequence's id is the number of its first piece. Rows
    without a doc_id take no part; repeated rows are packed as often. Columns but those in ``order`` are not read, whatever their names; texts of any length
    are encoded whole. Pieces of one length are interchangeable: which of them goes where is decided by their number. An empty table gives an empty result.
    """
    docs = docs.where(F.col("doc_id").isNotNull())
    # sorted and numbered in one job: written files would be read back in another order
    rows = (docs.orderBy(*order) if order else docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("body"))
    cut = rows.mapInArrow(_cut(path or default_path(), capacity), _PIECES.split(", ", 1)[1])
    pieces = stage(cut.select(F.monotonically_increasing_id().alias("item"), "*"), "pieces")
    return pieces.join(pack(pieces, capacity, **options), "item").drop("item")

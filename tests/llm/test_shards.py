"""Shards that come one after another: a task holds few of them, and finds the same links; buckets follow the bytes."""

import numpy as np
import pyarrow as pa
from helpers import frame, prose

from quire.llm import simhash
from quire.llm.suffixes import repeated_strings


def batches(shards, prints, ids, size):
    names = ["combo", "value", "i", "j", "print", "rep"]
    zero = np.zeros(len(ids), np.int64)
    for a in range(0, len(ids), size):
        cut = slice(a, a + size)
        yield pa.RecordBatch.from_arrays([pa.array(c[cut]) for c in (zero, shards, zero, zero, prints.view(np.int64), ids)], names=names)


def edges(found):
    return {(int(a), int(b)) for batch in found for a, b in zip(*[c.to_numpy() for c in batch.columns], strict=True)}


def test_shards_are_released_when_they_end(monkeypatch):
    r = np.random.default_rng(1)
    shards = np.sort(r.integers(0, 400, 6000))
    centres = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    prints = centres[shards] ^ (np.uint64(1) << r.integers(0, 64, 6000).astype(np.uint64))
    ids = np.arange(6000)
    held = []
    whole = simhash._edges
    monkeypatch.setattr(simhash, "_edges", lambda cells, *rest: held.append(cells.shape[1]) or whole(cells, *rest))
    want = edges(simhash._link(4, 1 << 30)(batches(shards, prints, ids, 1000)))
    assert held == [6000] and len(want) > 4000
    for size in (7, 64, 1000):
        held.clear()
        assert edges(simhash._link(4, 100)(batches(shards, prints, ids, size))) == want
        assert max(held) <= 100 + max(size, np.bincount(shards).max()) and sum(held) == 6000
    assert edges(simhash._link(4)(iter([]))) == set()


def test_one_shard_longer_than_what_is_held():
    prints = np.zeros(500, np.uint64)
    assert len(edges(simhash._link(4, 50)(batches(np.zeros(500, np.int64), prints, np.arange(500), 20)))) == 499


def test_many_buckets_find_what_few_do(spark):
    texts = [prose(i % 4, 120) + prose(100 + i, 40) for i in range(12)]
    few, many = (sorted(map(tuple, repeated_strings(frame(spark, texts), bucket_bytes=n).collect())) for n in (1 << 30, 50))
    assert few == many and sum(r[2] for r in few) > 0

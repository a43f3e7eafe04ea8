"""Near duplicates against every pair of sets, recall on simulated copies, hot groups and odd rows."""

import random

import numpy as np
from helpers import SCHEMA, WORDS, frame, odd_texts, prose
from pyspark.sql import functions as F

from quire.llm.neardup import links, near_components, shingle_set, similar


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return not a and not b or bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def slow_groups(texts):
    """doc_id -> smallest doc_id of its group, by all pairs."""
    sets, group = {i: slow_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and group[i] != group[j] and alike(sets[i], sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


def got(docs, **options):
    return {r.doc_id: r.component_id for r in near_components(docs, **options).collect()}


def copy_of(words, changed, r):
    words = list(words)
    for at in r.sample(range(len(words)), changed):
        words[at] = f"{r.choice(WORDS)}{r.randrange(1000)}"
    return words


def test_recall_and_precision(spark):
    r, texts = random.Random(4), []
    for k in range(400):
        words = [f"{r.choice(WORDS)}{r.randrange(400)}" for _ in range(r.randrange(60, 400))]
        texts += [" ".join(words), " ".join(copy_of(words, max(1, int(len(words) * r.choice([0.005, 0.01, 0.02, 0.03, 0.06]))), r))]
    texts += [prose(i, 100) for i in range(100)]
    docs = frame(spark, texts)
    found, sets = got(docs), [slow_set(t) for t in texts]
    pairs = [(2 * k, 2 * k + 1) for k in range(400)]
    true = {p for p in pairs if alike(sets[p[0]], sets[p[1]])}
    hit = {p for p in pairs if found[p[0]] == found[p[1]]}
    assert 100 < len(true) < 390 and hit <= true and len(hit) >= 0.95 * len(true)
    close = [p for p in true if len(sets[p[0]] & sets[p[1]]) < 0.87 * len(sets[p[0]] | sets[p[1]])]
    assert len(close) >= 20 and len([p for p in close if p in hit]) >= 0.9 * len(close)
    assert all(found[i] == i for i in range(800, 900))


def test_odd_rows_and_clashing_columns(spark):
    texts = odd_texts() + [prose(1, 120) + " x", prose(1, 121).upper(), "one  two\tthree", "ONE two three", "one two", " "]
    docs = frame(spark, texts)
    assert got(docs) == slow_groups(dict(enumerate(texts)))
    more = frame(spark, texts + texts[:9], [None, *range(1, len(texts)), *range(9)]).withColumns({n: F.lit(1) for n in ("rep", "band", "key", "print", "body", "size", "component", "i")})
    rows = near_components(more).collect()
    assert len(rows) == len(texts) + 8 and all(r.component_id <= r.doc_id for r in rows)
    assert near_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_hot_group_falls_into_chunks(spark):
    base, r = prose(3, 400).split(), random.Random(6)
    texts = [" ".join(copy_of(base, 2, r)) for _ in range(150)] + [prose(50 + i, 80) for i in range(40)] + [" ".join(base)] * 20
    found = got(frame(spark, texts), shard_rows=16)
    assert {found[i] for i in [*range(150), *range(190, 210)]} == {0} and all(found[i] == i for i in range(150, 190))


def test_links_connect_what_is_alike_without_all_pairs():
    r = np.random.default_rng(2)
    chain = [np.unique(np.concatenate((np.arange(k, k + 60), [1000])).astype(np.uint64)) for k in range(0, 120, 6)]
    sets = chain + [np.unique(r.integers(0, 1 << 60, 50).astype(np.uint64)) for _ in range(10)] + [np.zeros(0, np.uint64)] * 2
    found = links([0] * len(sets), sets, 0.8, 0)
    group = list(range(len(sets)))
    for a, b in found:
        group = [min(group[a], group[b]) if g == max(group[a], group[b]) else g for g in group]
    assert group == [0] * 20 + list(range(20, 30)) + [30, 30] and len(found) == 20
    assert similar(chain[0], chain[1], 0.8) and not similar(chain[0], chain[4], 0.8) and len(shingle_set(b"a b c d e a b c d e f", 5)) == 6

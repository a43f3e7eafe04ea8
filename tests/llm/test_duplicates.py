import collections
import hashlib
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import SCHEMA, frame, odd_texts, prose
from quire.llm.components import connected_components
from quire.llm.exact_dedup import PatriciaTrie, exact_duplicates
from quire.llm.simhash import fingerprint, link_prints, simhash_components


@given(st.lists(st.binary(max_size=6).map(lambda b: b.replace(b"\x03", b"\x00")), max_size=40))
@settings(max_examples=80, deadline=None)
def test_trie_holds_what_was_inserted(keys):
    trie, want = PatriciaTrie(), {}
    for i, key in enumerate(keys):
        trie.insert(key, i, i, 1)
        low, high, n = want.get(key, (i, i, 0))
        want[key] = (low, i, n + 1)
    assert {k: tuple(v[:3]) for k, v in trie.items()} == want


@pytest.mark.parametrize("keep,budget", [("smallest", 1 << 20), ("largest", 1)])
def test_exact_duplicates(spark, keep, budget):
    texts = odd_texts() * 2
    docs = frame(spark, texts).withColumn("keep_id", F.lit("clash")).withColumn("n_bytes", F.lit(1)).withColumn("body", F.lit(None))
    got = {r.doc_id: r for r in exact_duplicates(docs, keep, budget).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        group = groups[t or ""]
        best = min(group) if keep == "smallest" else max(group)
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best, len(group), i == best)
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(none).count() == 0
    assert simhash_components(none).count() == 0


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in zip(ids, prints, strict=True):
        for j, b in zip(ids, prints, strict=True):
            if j < i and (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint():
    for text in odd_texts():
        assert fingerprint((text or "").encode()) == slow_print(text or "")


def test_simhash_components(spark):
    texts = odd_texts() + [" ".join(prose(9, 200).split()[i:]) for i in range(8)] + [prose(i, 40) for i in range(40)]
    docs = frame(spark, texts).withColumn("print", F.lit("clash")).withColumn("body", F.lit(0))
    got = {r.doc_id: r for r in simhash_components(docs).collect()}
    prints = [slow_print(t or "") for t in texts]
    want = slow_components(prints, list(range(len(texts))))
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == dict(enumerate(prints))
    assert len(set(want.values())) < len(texts) - 5


@pytest.mark.parametrize("shard_rows", [8192, 16])
def test_links_of_close_prints(spark, shard_rows):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = list({b ^ sum(1 << k for k in r.sample(range(64), r.randrange(7))) for b in base for _ in range(25)})
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "print long, rep long")
    labels = {r.node: r.component for r in connected_components(link_prints(rows, shard_rows=shard_rows)).collect()}
    want = slow_components(prints, list(range(len(prints))))
    assert {i: labels.get(i, i) for i in want} == want


def test_components_of_a_path(spark):
    edges = spark.range(300).selectExpr("id + 1 as high", "id as low").where("high % 100 <> 0")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(c == n // 100 * 100 for n, c in got.items()) and len(got) == 297

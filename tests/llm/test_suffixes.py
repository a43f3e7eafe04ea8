import collections
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import SCHEMA, frame, odd_texts, prose
from quire.llm.suffixes import Run, anchors, common_prefix, encode_run, merge_runs, repeated_strings


def slow(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                hit[i : i + length] = b"\x01" * length
        kept = bytes(c for c, h in zip(d, hit, strict=True) if not h)
        spans = sum(h and not p for h, p in zip(hit, b"\x00" + bytes(hit), strict=False))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n):
    r = random.Random(seed)
    parts = [prose(100 + i, r.randrange(20, 60)) for i in range(8)]
    return [" ".join(r.choice([prose(r.random(), r.randrange(1, 30)), r.choice(parts), r.choice(parts)[r.randrange(40) :]]) for _ in range(r.randrange(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("length,gram,budget", [(200, 64, 64 << 20), (200, 64, 1), (40, 16, 5000)])
def test_repeated_strings(spark, length, gram, budget):
    texts = odd_texts() + passages(length, 60) + ["ab" * 400, "x" * 199, "y" * 200, "z" * 201, prose(7, 100)[:200], prose(7, 100)[:199]]
    docs = frame(spark, texts).repartition(5).withColumn("body", F.lit("clash")).withColumn("at", F.lit(1)).withColumn("once", F.lit(1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_strings(docs, length, gram, budget).collect()}
    want = slow(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(0 < w[1] < w[0] for w in want) > 20


def test_repeated_ids_and_kept_text(spark):
    texts = [prose(1, 90), prose(2, 90), prose(1, 90), None]
    docs = frame(spark, texts, ids=[1, 1, 2, None])
    rows = sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in repeated_strings(docs, with_text=True).collect())
    assert rows == sorted([(1, len(texts[0]), b""), (1, 0, texts[1].encode()), (2, len(texts[0]), b"")])
    assert repeated_strings(spark.createDataFrame([], SCHEMA)).count() == 0


@given(st.lists(st.lists(st.binary(max_size=5).map(lambda b: bytes(c % 3 for c in b)), max_size=8), min_size=1, max_size=7))
@settings(max_examples=150, deadline=None)
def test_merge_gives_sorted_order_and_prefixes(lists):
    runs = [Run(encode_run([(x, b"l" + x, [(1, 2, i)]) for i, x in enumerate(sorted(part))])) for part in lists]
    got = list(merge_runs(runs))
    words = [runs[r].right[e] for r, e, _ in got]
    assert words == sorted(x for part in lists for x in part)
    assert [n for *_, n in got][1:] == [common_prefix(a, b) for a, b in zip(words, words[1:], strict=False)]


def test_every_window_has_an_anchor():
    texts = [t.encode() for t in passages(1, 20)] + [b"", b"a" * 500]
    found = {i: (at, h) for i, at, h in anchors(texts, 200, 64)}
    for i, text in enumerate(texts):
        if len(text) < 200:
            assert i not in found
            continue
        at = set(found[i][0].tolist())
        assert all(any(x in at for x in range(p, p + 137)) for p in range(len(text) - 199))

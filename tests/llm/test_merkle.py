"""Manifests against plain Python: digests, proofs, tampering, and odd tables."""

import hashlib

import pytest
from helpers import SCHEMA, frame, odd_texts, prose
from pyspark.sql import functions as F

from quire.llm.merkle import check_proofs, leaf_digest, merkle_manifest, proof_digest


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def climb(nodes):
    """Root of a list of digests, and for each of them the list of (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, place in enumerate(at):
            run, own = runs[place // 8], place % 8
            paths[k].append(("".join(run[:own]), "".join(run[own + 1 :])))
        nodes, at = [H("".join(r)) for r in runs], [p // 8 for p in at]
    return nodes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["doc_id"], leaf(r)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    roots, found = [], []
    for lang in langs:
        leaves = sorted(by[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, paths = climb([h for _, h in leaves])
        roots.append(root)
        found.append((leaves, paths))
    top, over = climb(roots)
    return sorted(((d, h, sub, top, H("".join(b + a for b, a in path + up))) for (leaves, paths), sub, up in zip(found, roots, over, strict=True) for (d, h), path in zip(leaves, paths, strict=True)), key=repr)


def got(docs):
    return sorted((tuple(r) for r in merkle_manifest(docs).proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof"))).collect()), key=repr)


def many(n):
    langs = ["en"] * 6 + ["de", "fr", None, "", "Ünï"]
    return [{"doc_id": (i * 37) % 1009, "text": None if i % 11 == 0 else prose(i, 5), "lang": langs[i % 11] if i else "alone", "source": None if i % 3 else f"s{i}", "n_chars": i} for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 9, 150])
def test_trees(spark, n):
    rows = many(n)
    assert got(spark.createDataFrame([tuple(r[f.name] for f in SCHEMA) for r in rows], SCHEMA)) == brute(rows)


def test_odd_rows_repeated_rows_and_more_columns(spark):
    texts = odd_texts()
    docs = frame(spark, texts + texts, [None, *range(1, len(texts))] * 2)
    rows = [r.asDict() for r in docs.collect()]
    more = docs.withColumns({n: F.lit(1) for n in ("node", "leaf", "place", "tree", "scan_row", "kids", "ord", "grp")})
    assert got(more) == brute(rows)


def test_no_rows(spark):
    none = merkle_manifest(spark.createDataFrame([], SCHEMA))
    assert none.root is None and none.proofs.collect() == [] and none.trees.collect() == []


def test_tampering_is_seen_and_nothing_else(spark):
    docs = frame(spark, [prose(i, 6) for i in range(70)]).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    changed = leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.lower("text")])
    seen = check_proofs(merkle_manifest(docs, also={"now": changed}).proofs, "now")
    assert {r.doc_id for r in seen.where("NOT verified").collect()} == {i for i in range(70) if i % 5 == 0}
    assert seen.where("verified AND folded_root <> root").count() == 0

"""Exact duplicates by compressed radix tries.

Rows are dealt by length and content digest. Each task inserts whole byte strings into a Patricia trie
whose terminal nodes hold the identifiers' extremes and the number of copies. Two passes run the same trie:
one before the shuffle, so that a text with a million copies crosses the network once per task, and one after.
Texts are compared byte by byte in the trie; the digest only decides which task sees a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import look_up, stage, text_or_empty

_PARTIAL = "n_bytes long, text_sha256 string, body binary, low long, high long, copies long"
_OWNERS = "n_bytes long, text_sha256 string, low long, high long, copies long, body binary"


class PatriciaTrie:
    """Byte strings with their owners. A node is [label, children by first byte, terminal or None]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.sizes: dict[int, int] = {}  # bytes below each of the root's children
        self.n_bytes = 0

    def insert(self, key: bytes, low: int, high: int, copies: int, tag: object = None) -> bool:
        """Add a string; a terminal holds [smallest id, largest id, copies, tag]. Whether it is new."""
        node, at, grown = self.root, 0, 0
        while True:
            if at == len(key):
                break
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
                grown += len(key) - at + 200
                node = child
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            upper = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = upper
            grown += 200
            node, at = upper, at + same
        if grown:
            self.n_bytes += grown
            self.sizes[key[0]] = self.sizes.get(key[0], 0) + grown
        if node[2] is None:
            node[2] = [low, high, copies, tag]
            return True
        owner = node[2]
        owner[0], owner[1], owner[2] = min(owner[0], low), max(owner[1], high), owner[2] + copies
        return False

    def evict(self, budget: int) -> Iterator[tuple[bytes, list]]:
        """Strings and terminals of the largest subtrees below the root, until the others fit into the budget."""
        while self.n_bytes > budget and self.sizes:
            first = max(self.sizes, key=lambda b: (self.sizes[b], b))
            self.n_bytes -= self.sizes.pop(first)
            yield from _walk(self.root[1].pop(first))

    def items(self) -> Iterator[tuple[bytes, list]]:
        """All strings and terminals; the trie is empty then."""
        root = self.root
        self.__init__()
        yield from _walk(root)


def _walk(top: list) -> Iterator[tuple[bytes, list]]:
    """Strings and terminals of a subtree, which is freed as it is walked."""
    stack = [(b"", top)]
    while stack:
        before, node = stack.pop()
        whole = before + node[0]
        if node[2] is not None:
            yield whole, node[2]
        stack.extend((whole, child) for child in node[1].values())
        node[1] = {}


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, which differ or end before label does."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _combine(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            ids, sha = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc_id, body, digest in zip(ids, batch.column(1), sha, strict=True):
                trie.insert(body.as_py(), doc_id, doc_id, 1, digest)
            if trie.n_bytes > budget:
                yield from _partial(trie.evict(budget // 2))
        yield from _partial(trie.items())

    return run


def _partial(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for body, (low, high, copies, digest) in found:
        rows.append((len(body), digest, body, low, high, copies))
        size += len(body)
        if size > 4 << 20:
            yield _batch(rows, _PARTIAL)
            rows, size = [], 0
    if rows:
        yield _batch(rows, _PARTIAL)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _own(budget: int):
    """Merge partial owners. Rows come sorted by length and digest, so whatever is below the current row is whole.

    A tag is [length, digest, number of texts that share them]: the texts of one digest have it in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, tag = PatriciaTrie(), [None, None, 0]
        for batch in batches:
            head = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
            for n, digest, low, high, copies, body in zip(*head, batch.column(2), strict=True):
                if [n, digest] != tag[:2]:
                    if trie.n_bytes > budget:
                        yield from _owners(trie.evict(budget // 2))
                    tag = [n, digest, 0]
                tag[2] += trie.insert(body.as_py(), low, high, copies, tag)
        yield from _owners(trie.items())

    return run


def _owners(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
    """Owners; those that share a digest with another text keep their body, by which their members find them."""
    rows, size = [], 0
    for body, (low, high, copies, (n, digest, texts)) in found:
        rows.append((n, digest, low, high, copies, body if texts > 1 else None))
        size += 100 + (len(body) if texts > 1 else 0)
        if size > 4 << 20:
            yield _batch(rows, _OWNERS)
            rows, size = [], 0
    if rows:
        yield _batch(rows, _OWNERS)


def exact_duplicates(docs: DataFrame, keep: str = "smallest", budget: int = 48 << 20, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each document with the owner of its text.

    Columns: doc_id, keep_id (smallest or largest doc_id with this text, as ``keep`` says), group_size, kept,
    text_sha256. A null text counts as empty, and all empty texts are copies of each other. Rows without a
    doc_id take no part. If a doc_id comes twice, each of its rows is returned and counted; kept is true for
    all rows that carry the keep_id. Other columns of ``docs`` are not read. An empty table gives an empty result.

    budget: bytes of text a trie may hold. Beyond it, the largest subtrees leave, until half of it is free: the trie before the shuffle passes on
    what they have, the one after it emits them, as what it holds is whole by then. digest: of a text's bytes, SHA-256 unless given; different texts that share one
    are told apart by their bytes.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).cast("binary").alias("body"))
    rows = rows.withColumn("text_sha256", F.sha2("body", 256) if digest is None else digest(F.col("body")))
    partial = rows.mapInArrow(_combine(budget), _PARTIAL)
    keys = ["n_bytes", "text_sha256"]
    owners = partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_own(budget), _OWNERS)
    owners = stage(owners.select(*keys, F.col("low" if keep == "smallest" else "high").alias("keep_id"), F.col("copies").alias("group_size"), F.col("body").alias("own_body")), "owners")
    total, shared = owners.agg(F.sum("group_size"), F.count("own_body")).first()
    members = rows.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), "text_sha256")
    found = look_up(members, owners.where("own_body IS NULL").drop("own_body"), keys, "group_size", total or 0, ["doc_id"])
    if shared:  # texts of one length and digest: by their bytes too
        named = rows.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), "text_sha256", F.col("body").alias("own_body"))
        found = found.where("keep_id IS NOT NULL").unionByName(named.join(owners.where("own_body IS NOT NULL"), [*keys, "own_body"]).drop("own_body"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")

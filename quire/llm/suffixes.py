"""Repeated byte strings by a distributed suffix sort.

Sorting the suffix at every byte would cost many times the input. Only suffixes at anchors are sorted: of the
``gram``-byte strings in every window of ``length`` bytes the one with the smallest hash is an anchor, so two equal windows have
an anchor at the same place. A grouped count over all anchors leaves out those whose string occurs once.

Each task sorts the suffixes at its anchors and sends front-coded runs: for each suffix the length of the prefix it shares
with the one before, the bytes that follow, and the bytes to the left of the anchor. The receiver merges runs with
a loser tree whose nodes know the common prefix of each loser with the last winner; bytes known to be equal are not compared
again, and the lengths of common prefixes fall out of the merge.

A window that starts ``a`` bytes left of an anchor occurs again where another anchor agrees on ``a`` bytes to the left and on
``length - a`` to the right. Both are read from the prefix lengths, of the merged order to the right and of the same
order of the reversed bytes to the left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import partitions, text_or_empty

_CHUNK = 1 << 18
_RANDOM = np.random.default_rng(20)
_LETTER = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _RANDOM.integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all strings of ``gram`` bytes, a power of two, by doubling."""
    out, size = _LETTER[data], 1
    while size < gram:
        out = out[:-size] * _FACTOR[size.bit_length()] + out[size:]
        size *= 2
    return out


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the text, anchors' places, hashes of their strings) for texts of at least ``length`` bytes.

    Short texts are joined and worked on together; strings over a seam are left out, and windows over a seam can only add anchors.
    """
    group: list[int] = []
    size = 0
    for i, text in chain(enumerate(texts), [(-1, b"")]):
        if group and (i < 0 or size + len(text) > _CHUNK):
            yield from _group_anchors(group, texts, length, gram)
            group, size = [], 0
        if len(text) >= length:
            group.append(i)
            size += len(text)


def _group_anchors(group: list[int], texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data = np.frombuffer(b"".join([texts[i] for i in group]), np.uint8)
    width = length - gram + 1
    hashes = _gram_hashes(data, gram)
    least = _slide(hashes, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate((pad, least, pad)), width, np.maximum)
    at = np.flatnonzero(most == hashes)
    sizes = np.fromiter((len(texts[i]) for i in group), np.int64, len(group))
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, at, side="right")
    whole = at + gram <= ends[owner]
    at, owner = at[whole], owner[whole]
    found = hashes[at].view(np.int64)
    at = at - (ends - sizes)[owner]
    cuts = np.searchsorted(owner, np.arange(len(group) + 1))
    for j, i in enumerate(group):
        yield i, at[cuts[j] : cuts[j + 1]], found[cuts[j] : cuts[j + 1]]


def _count_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, at, h in anchors([x.as_py() for x in batch.column(2)], length, gram):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), ids[i])), pa.array(np.full(len(h), keys[i])), pa.array(at.astype(np.int32))], names=["h", "doc_id", "body_key", "at"])

    return _gathered(run)


def _gathered(run, rows: int = 100_000):
    """Join the many small batches that ``run`` yields."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += len(batch)
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


# ---- runs -----------------------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if known >= n:
        return n
    differ = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differ.bit_length() + 7) // 8


def encode_run(entries: list[tuple[bytes, bytes, list]]) -> bytes:
    """Front-code sorted (right, left, owners); owners are (doc_id, body_key, at)."""
    shared, rest, last = [], [], b""
    for right, _, _ in entries:
        n = common_prefix(last, right)
        shared.append(n)
        rest.append(right[n:])
        last = right
    lefts, owners = [e[1] for e in entries], [e[2] for e in entries]
    flat = [x for o in owners for x in o]
    parts = [
        np.array([len(entries), len(flat)], "<i8").tobytes(),
        *(np.array(x, "<i4").tobytes() for x in (shared, list(map(len, rest)), list(map(len, lefts)), list(map(len, owners)))),
        np.array(flat, "<i8").reshape(-1, 3).T.tobytes(),
        b"".join(rest),
        b"".join(lefts),
    ]
    return b"".join(parts)


class Run:
    """A decoded run: suffixes, their common prefixes with the one before, bytes to the left, owners."""

    def __init__(self, data: bytes) -> None:
        n, m = np.frombuffer(data, "<i8", 2).tolist()
        at = 16
        columns = []
        for _ in range(4):
            columns.append(np.frombuffer(data, "<i4", n, at).tolist())
            at += 4 * n
        self.shared, rest, lefts, n_owners = columns
        self.owners = np.frombuffer(data, "<i8", 3 * m, at).reshape(3, m)
        at += 24 * m
        self.first = np.concatenate(([0], np.cumsum(n_owners)))
        self.right, last = [], b""
        for same, more in zip(self.shared, rest, strict=True):
            last = last[:same] + data[at : at + more]
            self.right.append(last)
            at += more
        self.left = []
        for more in lefts:
            self.left.append(data[at : at + more])
            at += more


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, entry, common prefix with the one before) in order of the suffixes, by a loser tree.

    A node holds the loser's run and the prefix it shares with the winner that passed it. A challenger that shares more with the last winner is
    smaller, without a look at its bytes; only on a tie are bytes compared, and only beyond what is known.
    """
    k = len(runs)
    texts, shared = [r.right for r in runs], [r.shared for r in runs]
    place, ends = [0] * k, [len(t) for t in texts]

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix; prefixes are with the last winner, for the loser then with the new one."""
        if place[a] >= ends[a]:
            return b, lb, a, -1
        if place[b] >= ends[b]:
            return a, la, b, -1
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        x, y = texts[a][place[a]], texts[b][place[b]]
        n = common_prefix(x, y, la)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            return a, la, b, n
        return b, lb, a, n

    nodes: list[tuple[int, int]] = [(0, 0)] * k  # losers; node 0 holds the winner

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        (a, la), (b, lb) = build(2 * node), build(2 * node + 1)
        w, lw, loser, ll = play(a, la, b, lb)
        nodes[node] = (loser, ll)
        return w, lw

    winner, prefix = build(1) if k > 1 else (0, 0)
    while place[winner] < ends[winner]:
        yield winner, place[winner], prefix
        place[winner] += 1
        a = winner
        la = shared[a][place[a]] if place[a] < ends[a] else -1
        node = (a + k) // 2
        while node:
            b, lb = nodes[node]
            if lb < la:  # what play() would say, without the call
                pass
            else:
                a, la, *loser = play(a, la, b, lb)
                nodes[node] = (loser[0], loser[1])
            node //= 2
        winner, prefix = a, la


# ---- what occurs again ----------------------------------------------------------------------------------------------


def repeated_reach(rights: list[bytes], lcp: np.ndarray, lefts: list[bytes], copies: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct (right, left) in order of right: the first and last byte, from the anchor, that its repeated windows cover.

    lcp: common prefix of each right with the one before. copies: how often each pair occurs. Nothing repeated: (0, 0).
    """
    n, most = len(rights), length - gram
    start, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    group = np.cumsum(lcp < gram)
    # reversed left bytes, sorted within each group
    order = sorted(range(n), key=lambda i: (group[i], lefts[i]))
    llcp = np.zeros(n, np.int64)
    for p, q, at in zip(order, order[1:], range(1, n), strict=False):
        llcp[at] = common_prefix(lefts[p], lefts[q]) if group[p] == group[q] else -1
    order = np.array(order)
    n_right, n_left = np.fromiter(map(len, rights), np.int64, n), np.fromiter(map(len, lefts), np.int64, n)
    for a in range(most, -1, -1):
        ok = np.flatnonzero((n_right >= length - a) & (n_left >= a))
        if len(ok) == 0:
            continue
        by_right = np.cumsum(lcp < length - a)
        by_left = np.empty(n, np.int64)
        by_left[order] = np.cumsum(llcp < a)
        key = by_right[ok] * (n + 1) + by_left[ok]
        place = np.argsort(key)
        key = key[place]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total = np.add.reduceat(copies[ok][place], first)
        again = ok[place[np.repeat(total > 1, np.diff(np.append(first, len(key))))]]
        end[again] = length - a
        fresh = again[start[again] == 0]
        start[fresh] = -a
    return start, end


def _runs(length: int, gram: int, buckets: int, budget: int):
    def flush(held: dict[int, dict]) -> Iterator[pa.RecordBatch]:
        for bucket, entries in held.items():
            ordered = sorted((right, left, owners) for (right, left), owners in entries.items())
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([encode_run(ordered)], pa.binary())], names=["bucket", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        size = 0
        for batch in batches:
            ids, keys = (batch.column(i).to_pylist() for i in (0, 1))
            texts, single = [x.as_py() for x in batch.column(2)], batch.column(3)
            for i, at, h in anchors(texts, length, gram):
                once = single[i].values
                if once is not None and len(once):
                    keep = ~np.isin(at, once.to_numpy(zero_copy_only=False))
                    at, h = at[keep], h[keep]
                text, doc_id, key = texts[i], ids[i], keys[i]
                for x, bucket in zip(at.tolist(), (h.view(np.uint64) % np.uint64(buckets)).tolist(), strict=True):
                    pair = (text[x : x + length], text[max(0, x - length + gram) : x][::-1])
                    held.setdefault(bucket, {}).setdefault(pair, []).append((doc_id, key, x))
                size += len(at) * 2 * length
                if size > budget:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return run


def _merge(length: int, gram: int):
    def bucket(data: list[bytes]) -> Iterator[pa.RecordBatch]:
        runs = [Run(x) for x in data]
        rights, lefts, lcps, owners = [], [], [], []
        same: dict[bytes, int] = {}
        for r, e, prefix in merge_runs(runs):
            run = runs[r]
            right, left = run.right[e], run.left[e]
            if not rights or prefix < len(right) or len(rights[-1]) != len(right):
                same = {}
                carried = prefix
            if left in same:
                owners[same[left]].append((r, e))
            else:
                lcps.append(carried if not same else len(right))
                same[left] = len(rights)
                rights.append(right)
                lefts.append(left)
                owners.append([(r, e)])
        copies = np.array([sum(int(runs[r].first[e + 1] - runs[r].first[e]) for r, e in o) for o in owners], np.int64)
        lcp = np.array(lcps, np.int64)
        start, end = repeated_reach(rights, lcp, lefts, copies, length, gram)
        parts, reach = [], []
        for i in np.flatnonzero(end > 0).tolist():
            for r, e in owners[i]:
                run = runs[r]
                part = run.owners[:, run.first[e] : run.first[e + 1]]
                parts.append(part)
                reach.append((start[i], end[i], part.shape[1]))
        if parts:
            ids, keys, at = np.concatenate(parts, axis=1)
            s, e, n = np.array(reach).T
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array((at + np.repeat(s, n) << 32) | at + np.repeat(e, n))], names=["doc_id", "body_key", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data = None, []
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != last and data:
                    yield from bucket(data)
                    data = []
                last = b
                data.append(x.as_py())
        if data:
            yield from bucket(data)

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, body, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text, spans = body.as_py(), spans.values
                runs: list[list[int]] = []
                if spans is not None:
                    for span in np.unique(spans.to_numpy(zero_copy_only=False)).tolist():
                        s, e = span >> 32, span & 0xFFFFFFFF
                        if runs and s <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], e)
                        else:
                            runs.append([s, e])
                kept = text
                if runs:
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if with_text else row)
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _RESULT.split(", ")] + ["kept"] * with_text)

    return run


def repeated_strings(docs: DataFrame, length: int = 200, gram: int = 64, budget: int = 64 << 20, with_text: bool = False, bucket_bytes: int = 16 << 20) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) if ``with_text``.

    Removed is every byte that a string of ``length`` bytes covers which also starts anywhere else, in the same document or
    another, judged on the input as UTF-8; overlaps count. Null texts count as empty. Rows without a doc_id take no part. Rows
    that repeat a doc_id are documents of their own. Texts shorter than ``length`` stay whole. An empty table gives an empty result.

    gram: bytes of an anchor's string, a power of two below ``length``. budget: bytes of suffixes that a task gathers before it sends runs.
    bucket_bytes: bytes of text for each bucket of anchors at most; what a task holds when it merges is a part of that, but for anchors with very many contexts.
    Columns of other names are not read, and texts of any length are read to their end. Of equal strings none is preferred: all are removed.
    """
    body = text_or_empty(docs).cast("binary")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("body_key"), body.alias("body"))
    key = ["doc_id", "body_key"]
    counted = rows.mapInArrow(_count_anchors(length, gram), "h long, doc_id long, body_key long, at int")
    once = counted.groupBy("h").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in (*key, "at")]).where("n = 1")
    once = once.groupBy(*key).agg(F.collect_list("at").alias("once"))
    # a task merges a bucket at a time, so buckets follow the bytes there are
    n_bytes = rows.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    buckets = max(4 * partitions(docs.sparkSession), -(-n_bytes // bucket_bytes))
    runs = rows.join(once, key, "left").select("doc_id", "body_key", "body", "once").mapInArrow(_runs(length, gram, buckets, budget), "bucket long, run binary")
    spans = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge(length, gram), "doc_id long, body_key long, span long")
    spans = spans.groupBy(*key).agg(F.collect_set("span").alias("spans"))
    return rows.join(spans, key, "left").select("doc_id", "body", "spans").mapInArrow(_cut(with_text), _RESULT + ", kept binary" * with_text)

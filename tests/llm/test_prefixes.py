"""The prefix trie against a trie in memory."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from quire.llm.prefixes import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def shared(c):
    return zlib.crc32(str(c).encode()) % 4


def paths(rows, group, take):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}
    first = lambda c: c - (abs(c) % group) * (1 if c >= 0 else -1)
    return {c: own.get(first(c), [])[: take(c)] + turns[take(c) :] for c, turns in own.items()}


def brute(rows, group=20, take=shared):
    built = paths(rows, group, take)
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    saved, leaves, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * words
            leaves[node[:d]] += children[node] == 0
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(frame, **more):
    return sorted((tuple(r) for r in prefix_trie(frame, **more).collect()), key=repr)


def crc():
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4


def test_random_conversations(spark):
    r = random.Random(3)
    texts = [None, "", "a", "a  b", "naïve x 漢字\tc", "a"]
    rows = [(c, r.choice([None, *range(i + 2)]) if r.random() < 0.1 else i, r.choice(["user", "user", None, "assistant"]), r.choice(texts)) for c in r.sample(range(-60, 200), 120) for i in range(r.randrange(1, 6))]
    rows += rows[:15] + [(None, 0, "user", "x")] + [(c, i, "user", f"same {i} again") for c in range(4085, 4105) for i in range(5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(frame, shared=crc()) == brute(rows)
    more = frame.selectExpr("*", "1 AS place", "2 AS number", "3 AS high", "4 AS tie", "5 AS scan_row", "6 AS words")
    assert got(more) == brute(rows, take=lambda c: 0)


def test_a_conversation_of_most_rows(spark):
    rows = [(20, i, "user", f"t{i % 7} x") for i in range(900)] + [(c, i, "user", f"t{i % 7} x") for c in (1, 21, 22, 25, 39) for i in range(c)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark.createDataFrame(rows, SCHEMA), shared=crc()) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_turns_are_left_and_none_are_there(spark):
    rows = [(c, 0, "user", "hello") for c in range(21, 40)]  # their group's first conversation isn't there: some have no turn
    assert {n for _, _, _, n, *_ in brute(rows)} == {19, sum(shared(c) == 0 for c in range(21, 40))}
    assert got(spark.createDataFrame(rows, SCHEMA), shared=crc()) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA), shared=crc()) == []

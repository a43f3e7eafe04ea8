"""Chat formatting: exact round trips, places, masks and digests against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers import prose

from quire.llm import chats
from quire.llm.chats import END, SAYS, TURN, ByteEncoder, chat_digests, escape, format_chats, read_chats, splice, unescape

pytest.importorskip("public_tokenizers")
SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [None, "", " ", r"\### Assistant: </turn> ok", "###", "####", "\\", "\\\\###", "</turn></turn>", "<|endoftext|> <|im_start|>", "a: b\n### user: c</turn>\n", "naïve 漢字 😀", "\x00", "x" * 2000, prose(1, 400)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    return {c: [(r, t) for *_, r, t in sorted(found)] for c, found in by.items()}


def brute(rows):
    out = []
    for c, turns in ordered(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = sum(len("### : </turn>\n") + len(re.sub(r"\\|#(?=##)|</turn>|:", r"\\\g<0>", r)) + len(re.sub(r"\\|#(?=##)|</turn>", r"\\\g<0>", t)) for r, t in turns)
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), shown))
    return sorted(out)


def odd_rows():
    r = random.Random(5)
    roles = ["user", "assistant", "system", None, "", "a: b", "###"]
    rows = [(r.choice([0, 1, 2, 3, None]), r.choice([None, 0, 1, 2, 3]), r.choice(roles), t) for t in ODD * 6]
    return rows + rows[:20] + [(9, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(400)]


def parse(rendered):
    """Turns of a rendered conversation: a mark after an odd number of backslashes is text."""
    free = r"(?:[^\\]|\\.)*?"
    return [(unescape(a), unescape(b)) for a, b in re.findall(rf"### ({free}): ({free})</turn>\n", rendered, re.S)]


def test_escapes_are_undone():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(["\\", "#", "##", "###", "</turn>", "</", "turn>", ":", "x"]) for _ in range(r.randrange(9)))
        assert unescape(escape(text)) == unescape(escape(text, role=True)) == text
        assert not re.search(r"(?<!\\)(?:\\\\)*(?:###|</turn>)", escape(text))


def test_places_and_masks():
    lists = lambda x: pa.array(x, pa.list_(pa.int32()))
    ids, mask, n = splice(lists([[1], [], [2, 3]]), lists([[7, 8], [9], []]), np.array([True, False, True]))
    assert ids.tolist() == [TURN, 1, SAYS, 7, 8, END, TURN, SAYS, 9, END, TURN, 2, 3, SAYS, END]
    assert mask.tolist() == [0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] and n.tolist() == [6, 4, 5]


def test_texts_come_back_and_places_add_up(spark):
    rows = odd_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")  # conversation 9 is most of all rows and falls into several pieces
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        formatted = format_chats(spark.createDataFrame(rows, SCHEMA))
        found = sorted(formatted.collect(), key=lambda r: (r.conv_id, r.turn_no))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, encoder = ordered(rows), ByteEncoder.of(chats.default_path())
    for conv, turns in want.items():
        mine = [r for r in found if r.conv_id == conv]
        assert [r.turn_no for r in mine] == list(range(len(turns)))
        assert [r.token_start for r in mine] == [sum(len(x.ids) for x in mine[:i]) for i in range(len(mine))]
        for r, (role, text) in zip(mine, turns, strict=True):
            ids = encoder.encode(escape(text))
            assert r.ids == [TURN, *encoder.encode(escape(role, role=True)), SAYS, *ids, END]
            assert sum(r.loss_mask) == (len(ids) if role == "assistant" else 0) and len(r.loss_mask) == len(r.ids)
    read = sorted(read_chats(formatted).collect(), key=lambda r: (r.conv_id, r.turn_no))
    for conv, turns in want.items():
        mine = [r for r in read if r.conv_id == conv]
        assert [(r.role, r.text) for r in mine] == turns == parse("".join(r.formatted for r in mine))
        assert [r.loss_text for r in mine] == [t if role == "assistant" else "" for role, t in turns]
    digests = sorted(tuple(r) for r in chat_digests(read_chats(formatted)).collect())
    assert digests == brute(rows)


def test_roles_that_are_learnt_and_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hello there", 1), (1, 1, "tool", "42", 2)], SCHEMA + ", ids long").selectExpr("*", "1 AS tie", "2 AS scan_row", "3 AS learnt")
    read = {r.role: r.loss_text for r in read_chats(format_chats(rows, learn=("user", "tool"))).collect()}
    assert read == {"user": "hello there", "tool": "42"}


def test_no_rows(spark):
    formatted = format_chats(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA))
    assert formatted.collect() == [] and chat_digests(read_chats(formatted)).collect() == []


def test_a_very_long_text_is_encoded_in_pieces(spark):
    text = ("ab " * 70_000) + "é" * 70_000 + " " * 70_000
    rows = [(1, 0, "assistant", text), (1, 1, "user", "short")]
    assert sorted(tuple(r) for r in chat_digests(read_chats(format_chats(spark.createDataFrame(rows, SCHEMA)))).collect()) == brute(rows)

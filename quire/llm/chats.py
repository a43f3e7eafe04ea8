"""Conversations as token ids with a loss mask, and back.

A turn is ``### role: text</turn>``. The three marks are reserved ids, spliced between the ids of role and text, which are encoded
separately; so no text can make a mark, whatever it holds. What would read as a mark in the rendered form is escaped by a backslash, and
so is a backslash, so that the rendered form can be read back too. A byte-level vocabulary loses nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scan import carry, deal, put_behind
from quire.llm.staging import stage
from quire.llm.turns import turn_rows

#: Reserved ids, above the vocabulary's own, and what they read as.
TURN, SAYS, END = 50257, 50258, 50259
RENDERED = {TURN: "### ", SAYS: ": ", END: "</turn>\n"}
_IN_TEXT = re.compile(r"\\|#(?=##)|</turn>")
_IN_ROLE = re.compile(r"\\|#(?=##)|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|#|</turn>|:)")
#: Code points that are encoded at a time. Longer texts are encoded in pieces, which join to the same bytes.
_PIECE = 1 << 16
#: Characters after which an output batch is passed on.
_BATCH = 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class ByteEncoder:
    """Ids of texts by a file of byte-level merges, and texts of ids. Special strings in a text are ordinary text."""

    _of: dict[str, ByteEncoder] = {}

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {rank: token for token, rank in ranks.items()}

    @classmethod
    def of(cls, path: str) -> ByteEncoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def encode(self, text: str) -> list[int]:
        if len(text) <= _PIECE:
            return self.encoding.encode_ordinary(text)
        return [i for at in range(0, len(text), _PIECE) for i in self.encoding.encode_ordinary(text[at : at + _PIECE])]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()


def _encode(path: str, learn: tuple[str, ...]):
    """Ids of role and text, each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, roles = ByteEncoder.of(path), {}
        for batch in batches:
            ends = np.cumsum([len(t) for t in batch.column("text").to_pylist()]) if batch.num_rows else []
            cuts = [0, *(np.flatnonzero(np.diff(np.asarray(ends) // _BATCH)) + 1), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                said = part.column("role").to_pylist()
                for role in said:
                    if role not in roles:
                        if len(roles) > 10_000:  # roles are few; where they aren't, they aren't kept
                            roles.clear()
                        roles[role] = encoder.encode(escape(role, role=True))
                texts = [encoder.encode(escape(t)) for t in part.column("text").to_pylist()]
                kept = ["conv_id", "turn", "scan_row", "scan_part"]
                columns = [*[part.column(c) for c in kept], pa.array([r in learn for r in said]), pa.array([roles.get(r) or encoder.encode(escape(r, role=True)) for r in said], pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "learnt", "role_ids", "text_ids"])

    return run


_TURNS = "conv_id long, turn long, ids array<int>, loss_mask array<byte>, n_tokens long, scan_in_turn_no long, scan_in_token_start long, scan_row long, scan_part long"


def splice(role_ids: pa.ListArray, text_ids: pa.ListArray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of turns one after another, their loss mask, and the number of ids of each turn.

    Segments' places are running sums of their lengths; the mask is the running sum of 1 where a learnt text begins and -1 where it ends.
    """
    n_role, n_text = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (role_ids, text_ids))
    n = 3 + n_role + n_text
    starts = np.cumsum(n) - n
    ids = np.empty(int(n.sum()), np.int32)
    ids[starts], ids[starts + 1 + n_role], ids[starts + n - 1] = TURN, SAYS, END
    for segment, count, at in ((role_ids, n_role, starts + 1), (text_ids, n_text, starts + 2 + n_role)):
        before = np.cumsum(count) - count
        ids[np.repeat(at - before, count) + np.arange(int(count.sum()))] = segment.flatten().to_numpy()
    steps = np.zeros(len(ids) + 1, np.int8)
    np.add.at(steps, (starts + 2 + n_role)[learnt], 1)
    np.add.at(steps, (starts + n - 1)[learnt], -1)
    return ids, np.cumsum(steps[:-1], dtype=np.int8), n


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of sorted rows; where a turn starts, and its number, are counted within the piece."""
    last, tokens, turns = None, 0, 0  # of the conversation so far
    for batch in batches:
        if not batch.num_rows:
            continue
        role_ids, text_ids = batch.column("role_ids"), batch.column("text_ids")
        ids, mask, n = splice(role_ids, text_ids, batch.column("learnt").to_numpy(zero_copy_only=False).astype(bool))
        conv = batch.column("conv_id").to_numpy()
        new = np.concatenate(([conv[0] != last], conv[1:] != conv[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))  # where the row's conversation begins in this batch; -1: before it
        ends = np.cumsum(n)
        token_end = ends - np.where(first >= 0, (ends - n)[first], -tokens)
        turn_no = np.arange(1, len(conv) + 1) - np.where(first >= 0, first, -turns)
        last, tokens, turns = conv[-1], int(token_end[-1]), int(turn_no[-1])
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        columns = [batch.column("conv_id"), batch.column("turn"), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask)), pa.array(n), pa.array(turn_no), pa.array(token_end), batch.column("scan_row"), batch.column("scan_part")]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _TURNS.split(", ")])


def format_chats(conversations: DataFrame, learn: tuple[str, ...] = ("assistant",), vocabulary: str | None = None) -> DataFrame:
    """conv_id, turn, turn_no (from 0), token_start (ids of the conversation before it), ids and loss_mask: a row for each turn.

    A conversation's sequence is the ids of its turns by turn_no. loss_mask is 1 for the ids of the texts, no marks, of the roles in ``learn``.
    vocabulary: a file of byte-level merges of fewer than 50257 ids.

    Rows are ordered by turn, null first, then by the digest of role and text; repeated rows are turns of their own. A null role or text is
    empty, and an empty text is a turn without text. Rows without a conv_id belong to no conversation and are left out. Other columns are not read.
    An empty table gives an empty result. Texts over 65536 code points are encoded in pieces of so many.

    Turns are dealt out by ranges of conversation and turn, so that a conversation of any length is split, and encoded there; places within a
    conversation are added up over pieces.
    """
    encode = _encode(vocabulary or default_path(), learn)
    dealt = deal(turn_rows(conversations), ["conv_id"], ["turn", "tie"])
    turns = stage(dealt.mapInArrow(lambda batches: _assemble(encode(batches)), _TURNS), "turns")
    before = carry(turns, ["conv_id"], turn_no=("count", F.col("n_tokens")), token_start=("sum", F.col("n_tokens")))
    found = put_behind(turns, ["conv_id"], before, turn_no="count", token_start="sum")
    return found.select("conv_id", "turn", (F.col("turn_no") - 1).alias("turn_no"), (F.col("token_start") - F.col("n_tokens")).alias("token_start"), "ids", "loss_mask")


_READ = "conv_id long, turn_no long, role string, text string, loss_text string, formatted string"


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.of(path)
        for batch in batches:
            rows = []
            for ids, mask in zip(batch.column("ids"), batch.column("loss_mask"), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False).astype(bool)
                says, end = np.flatnonzero(ids == SAYS), np.flatnonzero(ids == END)
                if ids[0] != TURN or len(says) != 1 or len(end) != 1 or end[0] != len(ids) - 1:
                    raise ValueError("not the ids of one turn")
                role, text = encoder.decode(ids[1 : says[0]].tolist()), encoder.decode(ids[says[0] + 1 : -1].tolist())
                rows.append((unescape(role), unescape(text), unescape(encoder.decode(ids[mask].tolist())), RENDERED[TURN] + role + RENDERED[SAYS] + text + RENDERED[END]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn_no"), *[pa.array(c, pa.string()) for c in columns]], names=[f.split()[0] for f in _READ.split(", ")])

    return run


def read_chats(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, turn_no, role, text, loss_text (what the mask covers, unescaped) and formatted (as it is rendered) of what ``format_chats`` returns."""
    return formatted.select("conv_id", "turn_no", "ids", "loss_mask").mapInArrow(_read(vocabulary or default_path()), _READ)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sorted turns, one conversation after another; nothing but the hashes' states is kept."""
    last, done = None, []
    turns = loss = None
    counts = [0, 0, 0]

    def close() -> None:
        if last is not None:
            done.append((last, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done, strict=True)) or [[]] * 6, kinds, strict=True)], names=[f.split()[0] for f in _DIGESTS.split(", ")])
        done.clear()
        return batch

    for batch in batches:
        for conv, role, text, learnt, formatted in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "formatted")], strict=True):
            if conv != last:
                close()
                last, turns, loss, counts = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            turns.update(f"{role}\n{text}\n".encode())
            loss.update(learnt.encode())
            counts[0], counts[1], counts[2] = counts[0] + 1, counts[1] + len(learnt), counts[2] + len(formatted)
        if done:
            yield out()
    close()
    yield out()


def chat_digests(read: DataFrame) -> DataFrame:
    """A row for each conversation of what ``read_chats`` returns: n_turns, turns_sha256 (of role and text, a line feed after each), loss_chars and loss_sha256 (of the learnt
    texts), formatted_chars.

    A digest is made of bytes in order, so a conversation's turns stream through one task, sorted; its memory holds a batch of them.
    """
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").mapInArrow(_digest, _DIGESTS)

"""The cache of tokens is bounded in bytes, and long pieces come out the same without it."""

import pyarrow as pa

from quire.llm.tokens import WordEncoder, default_path


def test_long_pieces_are_not_kept():
    encoder = WordEncoder(default_path())
    texts = ["short words here", *("q" * n + "x" * n for n in (40, 33, 500, 20_000))]
    got = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in got] == [encoder.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, encoder.pieces)) <= 64 and "short" in encoder.pieces

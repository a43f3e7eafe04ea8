"""Token ids of whole texts, word by word.

The vocabulary drops white space and never merges across it, so a text's ids are those of its words in turn. Each
distinct word of a slice is put together once, and each piece of a word encoded once for as long as the cache lasts. Words with
anything but plain Latin letters, digits and marks go through the tokenizer itself.
"""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What the vocabulary's own splitting does to plain words (fixed values of the tokenizer's file).
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_ODD = re.compile(r"[^\x21-\x7e\xa1-\xac\xae-ȳ]|[²³¹¼½¾İ]|<\|")
_SLICE = 4 << 20
#: Entries of the cache's newer half. A Python worker keeps the cache for as long as it lives, so it must stay small beside the executor's heap.
_PIECES_KEPT = 250_000
#: Longer pieces are encoded each time, so that the cache's bytes are bounded as its entries are.
_LONGEST_KEPT = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes: printable ones for themselves, others from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Halves(dict):
    """A cache of two halves. When the newer one is full it becomes the older one, whose entries go unless they are asked for again."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def find(self, key: str) -> bytes | None:
        found = self.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids by the tokenizer file at ``path``, without special tokens added."""

    _of: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.pieces = Halves(_PIECES_KEPT)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder for each process, as its caches are worth keeping between tasks."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        return ids if len(piece) > _LONGEST_KEPT else self.pieces.put(piece, ids)

    def _word(self, word: str) -> bytes:
        known = self.pieces.find
        if word and word.isascii():  # most words are letters, or letters and a mark
            if word.isalpha():
                low = word.lower()
                return known(low) or self._piece(low)
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                low, mark = word[:-1].lower(), word[-1]
                return (known(low) or self._piece(low)) + (known(mark) or self._piece(mark))
        if _ODD.search(word):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([known(p) or self._piece(p) for p in _PIECES.findall(word.lower())])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """An array of ids for each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        out: list[np.ndarray] = []
        collects, a = gc.isenabled(), 0
        gc.disable()  # nothing here makes cycles, and each collection would walk the caches
        try:
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _SLICE, side="right")))
                out += self._slice(texts.slice(a, b - a))
                a = b
        finally:
            if collects:
                gc.enable()
        return out

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        table = list(map(self._word, coded.dictionary.to_pylist()))
        n_ids = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), "<u4")
        starts = np.cumsum(n_ids) - n_ids
        words = coded.indices.to_numpy(zero_copy_only=False)
        n = n_ids[words] if len(words) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(n)))
        take = np.repeat(starts[words] - ends[:-1], n) + np.arange(ends[-1]) if len(words) else np.zeros(0, np.int64)
        ids = flat[take]
        bounds = ends[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))]
        return [ids[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

"""Table functions for SQL: a book's chapters, and the pages of its planned chapters.

They are for calls in SQL, book by book: ``SELECT * FROM split_chapters(TABLE(docs) PARTITION BY doc_id)``. A call takes one book at a time; whole tables are
better served by ``operators.segments``, whose rules these follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import regex
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from quire.functions import text as T
from quire.operators.segments import BEAT_CUES, HeadingFinder

_PARTS = regex.compile(r"\n{2,}")
_CUE = regex.compile(f"(?i)^(?:{BEAT_CUES})")
_SENTENCE = regex.compile("(?<=[.!?。！？][”’\"']?)\\s+")


def paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip(T._WS_CHARS) for x in _PARTS.split(text)) if p]


def joined(parts: list[str], closes, mark: str) -> list[str]:
    """Neighbouring parts in groups; ``closes(letters of the open group, part, place)`` says that a group ends before a part."""
    groups: list[list[str]] = []
    n = 0
    for i, part in enumerate(parts):
        if not groups or closes(n, part, i):
            groups.append([])
            n = 0
        groups[-1].append(part)
        n += len(part)
    return [mark.join(g) for g in groups]


def chunks_of(text: str, budget: int) -> tuple[str, list[str]]:
    """The method and chunks of a text without headings: by beats where there are any, else by length."""
    parts = paragraphs(text)
    beats = joined(parts, lambda n, p, i: bool(_CUE.match(p)) or n > budget, "\n\n") if len(parts) >= 6 else []
    method, parts = ("semantic_fallback", beats) if len(beats) >= 2 else ("length_fallback", parts)
    return method, joined(parts, lambda n, p, i: n + len(p) > budget, "\n\n")


class SplitChapters:
    """split_chapters(TABLE (doc_id, text) PARTITION BY (doc_id) [, budget])."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def eval(self, row: Row, budget: int = 4200) -> None:
        self.rows.append((str(row["doc_id"]), row["text"] or "", budget))

    def terminate(self) -> Iterator[tuple]:
        for doc_id, text, budget in self.rows:
            lines = text.split("\n")
            found = HeadingFinder(lines).find()
            if len(found) >= 2:
                ends = [*(h[0] for h in found), len(lines)][1:]
                for i, ((line, title, start), end) in enumerate(zip(found, ends, strict=True)):
                    yield doc_id, i, title, "\n".join(lines[start:end]).strip(), line + 1, "heading"
                continue
            places: dict[str, int] = {}
            for n, line in enumerate(lines, 1):
                places.setdefault(line.strip(T._WS_CHARS), n)
            method, chunks = chunks_of(text, budget)
            for i, chunk in enumerate(chunks):
                first = next((x for x in (y.strip(T._WS_CHARS) for y in chunk.split("\n")) if x), "")
                yield doc_id, i, f"Chapter {i + 1}", chunk, places.get(first, 1), method


def slices(text: str, size: int) -> list[str]:
    return [p for p in (text[i : i + size].strip(T._WS_CHARS) for i in range(0, len(text), size)) if p]


def _cut(paragraph: str, target: int) -> list[str]:
    """A paragraph over 1.15 targets in chunks of whole sentences; a sentence over 1.25 targets in slices."""
    if len(paragraph) * 100 <= target * 115:
        return [paragraph]
    sentences = [s for s in (x.strip(T._WS_CHARS) for x in _SENTENCE.split(paragraph)) if s]
    if len(sentences) <= 1:
        return slices(paragraph, target)
    out, held = [], []
    for s in sentences:
        long = len(s) > target * 1.25
        if held and (long or sum(map(len, held)) + len(s) > target):
            out.append(" ".join(held))
            held = []
        if long:
            out += slices(s, target)
        else:
            held.append(s)
    return out + ([" ".join(held)] if held else [])


def segments_of(text: str, count: int) -> list[str]:
    """A text in exactly ``count`` segments of about one length; the last one again where there are fewer."""
    raw = paragraphs(text)
    target = max(1, ceil(sum(map(len, raw)) / count))
    parts = [c for p in raw for c in _cut(p, target)]
    if len(parts) > count:
        size, aim, done = len(parts), max(1, ceil(sum(map(len, parts)) / count)), [0]

        def closes(n: int, part: str, i: int) -> bool:
            after = n + len(part)
            ends = done[0] < count - 1 and after > aim and abs(aim - n) <= abs(aim - after) and size - i > count - done[0] - 1
            done[0] += ends
            return ends

        parts = joined(parts, closes, "\n\n")
    return (parts + [parts[-1] if parts else ""] * count)[:count]


class SplitSpreads:
    """split_spreads(TABLE (doc_id, chapter_idx, chapter_id, text, spread_count) PARTITION BY doc_id ORDER BY chapter_idx): pages numbered through the book."""

    def __init__(self) -> None:
        self.page = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        for i, segment in enumerate(segments_of(row["text"] or "", max(1, int(row["spread_count"] or 1)))):
            self.page += 1
            yield str(row["doc_id"]), int(row["chapter_idx"]), i, f"{row['chapter_id']}-sp-{i + 1:02d}", self.page, segment


def register(spark: SparkSession) -> None:
    """Make split_chapters and split_spreads known to a session's SQL."""
    spark.udtf.register("split_chapters", udtf(SplitChapters, returnType="doc_id string, chapter_idx int, title string, text string, anchor_line int, split_method string"))
    spark.udtf.register("split_spreads", udtf(SplitSpreads, returnType="doc_id string, chapter_idx int, spread_idx int, spread_id string, page_number int, segment string"))

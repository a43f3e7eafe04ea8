"""Licence scans: normalised passages against templates by the Dice coefficient of their word bigrams.

A passage is the whole text, a paragraph, a line or a sentence. Dice of at least t between a passage of p and a template of q
bigrams needs p between q * t / (2 - t) and q * (2 - t) / t, so most templates, and most passages, are ruled out by size. A
passage that reaches t also lacks only few of the template's bigrams; from that follows, for each template, a small
set of words one of which the passage must have. Texts without any such word are not cut into passages at all.

What is wrapped, marked as a comment or part of a longer paragraph is no passage. So runs of words, wherever they start, are held
against all templates and against whole licence texts too, if the text as a whole has as many of a template's bigrams as a match needs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources
from itertools import islice
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import text_or_empty

#: Notices of licences, as their stewards word them (fixed values). A number stands for any number.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0": ("Dedicated to the public domain under CC0 1.0.",),
    "ARR": ("All rights reserved. No part of this publication may be reproduced.",),
}
_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"[0-9]+")
_COMMON = frozenset("a all an and any at be by for free in is it may no not of on or part source the this to under use with work you".split())


def normalise(text: str, most: int | None = None) -> list[str]:
    """The first ``most`` words, in lower case; marks are dropped, a number becomes 0, British licence becomes license."""
    words = (m.group().lower().replace("licence", "license") for m in islice(_WORD.finditer(text), most))
    return ["0" if _NUMBER.fullmatch(w) else w for w in words]


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


@lru_cache(maxsize=4096)
def _whole(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<![^\W_])(?:" + "|".join(words) + r")(?![^\W_])")


#: File of a whole text, its name in the results.
FULL = {"Apache-2.0": "Apache-2.0", "MIT": "MIT", "GPL-2": "GPL", "GPL-3": "GPL", "LGPL-2.1": "LGPL", "LGPL-3": "LGPL", "BSD": "BSD", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0"}
_HEAD = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version 3 of the License, or (at your option) any later version."
_TAIL = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
#: Standard notices of several sentences, by name in the results.
NOTICES = (
    ("GPL", _HEAD.format("program", ":", "", ",")),
    ("GPL", _HEAD.format("program", ":", "", ",") + _TAIL.format("program", "")),
    ("LGPL", _HEAD.format("library", ";", "Lesser ", ";")),
    ("LGPL", _HEAD.format("library", ";", "Lesser ", ";") + _TAIL.format("library", "Lesser ")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
)


def whole_texts() -> list[tuple[str, str]]:
    """(name in the results, text) of whole licences; BSD with two clauses is cut from the one with three."""
    folder = resources.files("quire.llm") / "license_texts"
    out = [(name, (folder / f"{file}.txt").read_text("utf-8")) for file, name in FULL.items()]
    bsd = dict(out)["BSD"]
    third, rest = bsd.index("3. Neither"), bsd.index("THIS SOFTWARE IS")
    return [*out, ("BSD", bsd[:third] + bsd[rest:])]


class Runs:
    """Templates against runs of words that start and end anywhere."""

    def __init__(self, templates: list[tuple[str, str]], least: float) -> None:
        self.least = least
        self.known = [(name, bigrams(normalise(t))) for name, t in templates]
        self.bounds = [(ceil(n.total() * least / (2 - least) - 1e-9), floor(n.total() * (2 - least) / least + 1e-9)) for _, n in self.known]
        self.having: dict[tuple[str, str], list[int]] = {}
        for i, (_, grams) in enumerate(self.known):
            for g in grams:
                self.having.setdefault(g, []).append(i)

    def scan(self, text: str, found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
        """Matches that overlap no larger one, by words in common.

        None lies inside one of ``found`` of the same licence and as high a score, or overlaps one of as high a score that has half its length or more.
        """
        words = normalise(text)
        grams = list(zip(words, words[1:], strict=False))
        held: Counter = Counter()
        for g, n in Counter(g for g in grams if g in self.having).items():
            for i in self.having[g]:
                held[i] += min(n, self.known[i][1][g])
        # a match has at least as many of the template's bigrams as the shortest run that can match
        near = [i for i, n in held.items() if n >= self.bounds[i][0]]
        if not near:
            return []
        places = [m.span() for m in _WORD.finditer(text)]
        hits = []
        for i in near:
            for score, a, b in self._best(grams, 0, len(grams), i):
                hits.append((score * (b - a + 1 + self.known[i][1].total()), -i, places[a][0], places[b + 1][1], self.known[i][0], score))
        out: list[tuple[int, int, str, float]] = []
        for _, _, s, e, name, score in sorted(hits, reverse=True):
            better = any((x <= s and e <= y and n == name and v >= score) or (x < e and s < y and v >= score and 2 * (y - x) >= e - s) for x, y, n, v in found)
            if not better and not any(x < e and s < y for x, y, _, _ in out):
                out.append((s, e, name, score))
        return out

    def _best(self, grams: list, low: int, high: int, i: int) -> Iterator[tuple[float, int, int]]:
        """(Dice, first bigram, last bigram) of the best run, then of the best before and after it; of equal ones the first start and then the shortest.

        Runs start and end with bigrams of the template, and every such start is tried that has enough of them within the longest run that can match. A
        place adds to what a run has in common unless the run has the template's number of that bigram already, that is, unless it starts at or before the place as
        many of them back; so each start is one comparison and one running sum over the places.
        """
        parts = [(low, high)]
        template, size, (least, most) = self.known[i][1], self.known[i][1].total(), self.bounds[i]
        while parts:
            low, high = parts.pop()
            places = [k for k in range(low, high) if grams[k] in template]
            if len(places) < least:
                continue
            seen: dict[tuple[str, str], list[int]] = {}
            full = np.empty(len(places), np.int64)
            for j, k in enumerate(places):
                before = seen.setdefault(grams[k], [])
                n = template[grams[k]]
                full[j] = before[-n] if len(before) >= n else -1
                before.append(j)
            at = np.array(places)
            ends = np.searchsorted(at, at + most)
            best = (0.0, 0, 0)
            for x in np.flatnonzero(ends - np.arange(len(at)) >= least).tolist():
                e = ends[x]
                scores = 2 * np.cumsum(full[x:e] < x) / (at[x:e] - at[x] + 1 + size)
                k = int(scores.argmax())
                if scores[k] > best[0]:
                    best = (float(scores[k]), places[x], places[x + k])
            if best[0] >= self.least:
                yield best
                parts += [(low, best[1]), (best[2] + 1, high)]


class Templates:
    """Templates with their size bounds and the words that a match must have one of."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float) -> None:
        self.least = least
        self.known = [(name, i, bigrams(normalise(t))) for name, texts in templates.items() for i, t in enumerate(texts)]
        self.bounds = [(ceil(n.total() * least / (2 - least) - 1e-9), floor(n.total() * (2 - least) / least + 1e-9)) for _, _, n in self.known]
        self.most = max(b for _, b in self.bounds)
        self.few = min(a for a, _ in self.bounds)
        self.needed = sorted({w for _, _, n in self.known for w in self._needed(n)})

    def _needed(self, grams: Counter) -> list[str]:
        """Words that touch more bigrams than a match may lack; long words are taken first and common ones last."""
        may_lack = grams.total() - ceil(grams.total() * self.least / (2 - self.least) - 1e-9)
        left, out = Counter(grams), []
        while grams.total() - left.total() <= may_lack:
            touched = Counter()
            for gram, n in left.items():
                for w in set(gram):
                    touched[w] += n
            word = max(touched, key=lambda w: (w not in _COMMON and len(w) > 3, touched[w], len(w), w))
            out.append(word)
            left = Counter({g: n for g, n in left.items() if word not in g})
        return out

    def may_match(self, text: str) -> bool:
        """Whether a text has one of the needed words. Plain searches come first; few words get as far as the pattern."""
        low = text.lower()
        if "licence" in low:
            low = low.replace("licence", "license")
        near = tuple(w for w in self.needed if w in low)
        return bool(near) and _whole(near).search(low) is not None

    def best(self, words: list[str]) -> tuple[float, str, int] | None:
        size = len(words) - 1
        if not self.few <= size <= self.most:
            return None
        near = [i for i, (a, b) in enumerate(self.bounds) if a <= size <= b]
        grams = bigrams(words)
        scored = [(dice(grams, self.known[i][2]), -i) for i in near]
        score, at = max(scored, default=(0.0, 0))
        return (score, *self.known[-at][:2]) if score >= self.least else None

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, Dice) of matching passages, widest first; none lies inside another match of the same licence."""
        if not self.may_match(text):
            return []
        found: list[tuple[int, int, str, float]] = []
        for start, end in passages(text):
            # one word more than any template allows is enough to know that a passage is too long
            hit = self.best(normalise(text[start:end], self.most + 2))
            if hit and not any(s <= start and end <= e and n == hit[1] for s, e, n, _ in found):
                found.append((start, end, hit[1], hit[0]))
        return found


_CUTS = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"[.!?;](?=\s)|\n"))


def passages(text: str) -> Iterator[tuple[int, int]]:
    """Places of the whole text, its paragraphs, lines and sentences."""
    yield 0, len(text)
    for cut in _CUTS:
        at = 0
        for m in cut.finditer(text):
            yield at, m.end()
            at = m.end()
        if 0 < at < len(text):
            yield at, len(text)


_DDL = "doc_id long, license string, score double, hits array<struct<start:int,end:int,license:string,score:double>>"


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = 0.8) -> DataFrame:
    """One row for each document: doc_id, license and score of its best passage (null without one), and all hits.
    Without ``templates`` TEMPLATES, NOTICES and whole licence texts are looked for.

    Hits are (start, end, license, score), in code points of the whole text. Ties go to the template named first. Null texts count as empty and have no hits. Rows without a doc_id take no part;
    repeated rows are returned as often. Of runs with one score the first start counts, then the shortest. Other columns are not read, whatever their names. Texts of any
    length are scanned whole; a text's time grows with the places of a template's bigrams in it times those within one match. An empty table gives an empty result.
    """
    known = Templates(templates or TEMPLATES, least)
    order = {name: i for i, name in enumerate(templates or TEMPLATES)}
    runs = Runs([(name, t) for name, texts in (templates or TEMPLATES).items() for t in texts] + ([] if templates else [*NOTICES, *whole_texts()]), least)

    def hits_of(text: str) -> list[tuple[int, int, str, float]]:
        found = known.scan(text)
        more = sorted(runs.scan(text, found))
        return [h for h in found if not any(n == h[2] and (s <= h[0] and h[1] <= e or h[0] <= s and e <= h[1]) for s, e, n, _ in more)] + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            hits = [[dict(zip(("start", "end", "license", "score"), h, strict=True)) for h in hits_of(x.as_py())] for x in batch.column(1)]
            best = [max(h, key=lambda x: (x["score"], -order[x["license"]]), default={"license": None, "score": None}) for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b["license"] for b in best], pa.string()), pa.array([b["score"] for b in best], pa.float64()), pa.array(hits, kind)], names=["doc_id", "license", "score", "hits"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("body"))
    return rows.mapInArrow(run, _DDL)

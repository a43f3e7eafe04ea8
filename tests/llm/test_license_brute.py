"""Licence hits against an independent search over all runs of words, and recall on notices as they stand in files."""

import random
import re
import textwrap
from collections import Counter

from helpers import frame, prose
from quire.llm.licenses import NOTICES, scan_licenses, whole_texts

KNOWN = {"A": ("permission to copy alder birch cedar files is granted to any person", "all alder rights reserved"), "B": ("licensed under terms of cedar version 2 only", "granted to any person without licence fee 10")}


def words_of(text):
    out = []
    for w in re.findall(r"[^\W_]+", text):
        w = w.lower().replace("licence", "license")
        out.append("0" if w.isdecimal() and w.isascii() else w)
    return out


def dice(a, b):
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))  # noqa: B905
    n = sum(x.values()) + sum(y.values())
    return 2 * sum(min(c, y[g]) for g, c in x.items()) / n if n else 0.0


def best_run(text):
    """Highest Dice of any run of words with any template."""
    words = words_of(text)
    return max((dice(words[i:j], words_of(t)) for texts in KNOWN.values() for t in texts for i in range(len(words)) for j in range(i + 2, len(words) + 1)), default=0.0)


def test_against_all_runs(spark):
    r, texts = random.Random(12), [None, "", "licence", "\n\n", "x " * 300]
    for i in range(90):
        parts = [prose(i, r.randrange(8))]
        for _ in range(r.randrange(3)):
            t = r.choice([x for texts_ in KNOWN.values() for x in texts_]).split()
            for _ in range(r.randrange(4)):  # some words go, change or come
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], ["oak"], [t[k], "fir"], [t[k].upper()]])
            parts.append(r.choice([" ", "\n", "\n# "]).join(t))
            parts.append(prose(i + 500, r.randrange(6)))
        texts.append(r.choice([" ", "\n", "\n\n", ". "]).join(parts))
    got = {x.doc_id: x for x in scan_licenses(frame(spark, texts), KNOWN).collect()}
    assert len(got) == len(texts)
    n = 0
    for i, text in enumerate(texts):
        most = best_run(text or "")
        assert (got[i].license is not None) == (most >= 0.8), (i, most, got[i])
        for h in got[i].hits:
            own = max(dice(words_of(text[h.start : h.end]), words_of(t)) for t in KNOWN[h.license])
            assert abs(own - h.score) < 1e-9 and 0.8 <= h.score <= most + 1e-9
        n += got[i].license is not None
    assert 20 < n < 80


def test_recall_as_found_in_files(spark):
    r, cases = random.Random(6), []
    known = [*NOTICES, *[(n, t) for n, t in whole_texts() if len(t) < 14_000]]
    for i in range(260):
        name, text = r.choice(known)
        words = [w for w in text.split() if r.random() > 0.02]
        for k in range(len(words)):
            if r.random() < 0.02:
                words[k] = r.choice(["oak", "fir", words[k].upper()])
        mark = r.choice(["", "# ", " * ", "// ", "-- ", "; "])
        body = "\n".join(mark + x for x in textwrap.wrap(" ".join(words), r.randrange(40, 110)))
        cases.append((name, f"{prose(i, r.randrange(60))}\n{body}\n{prose(900 + i, r.randrange(200))}"))
    clean = [prose(5000 + i, 120) for i in range(100)]
    got = {x.doc_id: x for x in scan_licenses(frame(spark, [t for _, t in cases] + clean)).collect()}
    recall = sum(name in {h.license for h in got[i].hits} for i, (name, _) in enumerate(cases)) / len(cases)
    print("recall", round(recall, 3))
    assert recall >= 0.9
    assert not any(got[len(cases) + i].hits for i in range(len(clean)))

"""Runs against the plain loop over every start and every end, on whole licence texts with words replaced and on texts of several licences."""

import random
from collections import Counter

from quire.llm.licenses import Runs, bigrams, normalise, whole_texts


def slowest(grams, template, least, low, high):
    """(score, first, last) of the best run between two places, each start and each end tried."""
    size = template.total()
    at = [k for k in range(low, high) if grams[k] in template]
    best = (0.0, 0, 0)
    for x, start in enumerate(at):
        seen, both = Counter(), 0
        for k in at[x:]:
            seen[grams[k]] += 1
            both += seen[grams[k]] <= template[grams[k]]
            score = 2 * both / (k - start + 1 + size)
            if score > best[0]:
                best = (score, start, k)
    return best if best[0] >= least else None


def every(grams, template, least):
    out, parts = [], [(0, len(grams))]
    while parts:
        low, high = parts.pop()
        if best := slowest(grams, template, least, low, high):
            out.append(best)
            parts += [(low, best[1]), (best[2] + 1, high)]
    return sorted(out)


def replaced(text, rate, seed):
    r = random.Random(seed)
    words = text.split()
    return " ".join(r.choice(words) if r.random() < rate else w for w in words)


def test_every_start_counts():
    texts = dict(whole_texts())
    runs = Runs(list(texts.items()), 0.8)
    names = [name for name, _ in runs.known]
    cases = []
    for name in ("Apache-2.0", "MIT", "CC0"):
        i = names.index(name)
        for seed, rate in enumerate((0.08, 0.1, 0.12)):
            noise = replaced(texts[name], 1.0, seed)[:1500]
            cases.append((i, f"{noise} {replaced(texts[name], rate, seed)} {noise}"))
    several = " ".join(replaced(texts[name], 0.05, 3) for name in ("MIT", "Apache-2.0", "MIT", "MIT"))
    cases += [(names.index("MIT"), several), (names.index("Apache-2.0"), several)]
    matched = 0
    for i, text in cases:
        words = normalise(text)
        grams = list(zip(words, words[1:], strict=False))
        want = every(grams, runs.known[i][1], 0.8)
        got = sorted(runs._best(grams, 0, len(grams), i))
        assert [(round(s, 12), a, b) for s, a, b in got] == [(round(s, 12), a, b) for s, a, b in want]
        matched += len(want)
    assert matched >= 8 and bigrams(["a", "b"]) == {("a", "b"): 1}

import textwrap

from helpers import frame, prose
from quire.llm.licenses import NOTICES, Runs, bigrams, dice, normalise, scan_licenses, whole_texts


def test_whole_texts_and_wrapped_notices(spark):
    cases = []
    for name, text in whole_texts():
        flat = "\n".join(" ".join(p.split()) for p in text.split("\n\n"))
        cases += [(name, text), (name, f"{prose(1, 400)}\n\n{flat}\n{prose(2, 90)}")]
    for name, text in NOTICES:
        cases += [(name, "\n".join(" * " + line for line in textwrap.wrap(text, 60))), (name, f"{prose(3, 60)} {textwrap.fill(text, 50)} {prose(4, 70)}")]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, [t for _, t in cases])).collect()}
    wrong = [(i, name, got[i].license, got[i].score) for i, (name, _) in enumerate(cases) if got[i].license != name or got[i].score < 0.9]
    assert not wrong


def test_runs_are_the_best_ones():
    runs = Runs([("x", "a b c d e f g h i j")], 0.8)
    for text in ("q q a b c d e f g h i j q", "a b c d q e f g h i j", "q r a b c d e z f g h i j s a b c d e f g h i j", "a b q c d", "a b a b a b c d e f g"):
        words = normalise(text)
        scores = [dice(bigrams(words[s:e]), bigrams(normalise("a b c d e f g h i j"))) for s in range(len(words)) for e in range(s + 2, len(words) + 1)]
        found = runs.scan(text, [])
        assert bool(found) == (max(scores) >= 0.8)
        if found:
            assert max(h[3] for h in found) == max(scores)
            assert all(abs(dice(bigrams(normalise(text[s:e])), bigrams(normalise("a b c d e f g h i j"))) - v) < 1e-9 for s, e, _, v in found)

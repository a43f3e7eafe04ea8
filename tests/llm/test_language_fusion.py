"""Fusion against plain Python, evidence that changes answers, and markup that is never closed."""

import math
import random
import re
import time
from collections import Counter

from quire.llm.language import _LENGTHS, calibrate, identify_languages, train_text_model, visible

PAGE = "page_id long, url string, html string"
SYLLABLES = {"en": "th er ing the and wh sh ly", "fr": "ou eau ai é qu la re en", "de": "sch ei ung ä ch der en er"}


def say(lang, r, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randrange(1, 4))) for _ in range(n))


def slow(pages, docs, smooth=8.0, temper=0.3):
    """The formula of the operator with dictionaries and loops; trigrams are told apart by themselves."""
    cells = 65536

    def grams(text):
        data = re.sub(rb"[\s0-9!-/:-@\[-`{-~]+", b" ", b" " + text.lower() + b" ")
        return [data[i : i + 3] for i in range(len(data) - 2)]

    names = sorted({lang for _, _, lang in docs})
    counts = {k: Counter(g for _, text, lang in docs if lang == k for g in grams(text.encode())) for k in names}
    log = lambda k, g: math.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * cells))
    facts = []
    for page_id, url, html in pages:
        text = re.sub(r"<[^>]*>", " ", re.sub(r"(?s)<script>.*?</script>", " ", html)).encode()
        s = [temper * sum(log(k, g) for g in grams(text)) for k in names]
        e = [math.exp(x - max(s)) for x in s]
        host = re.match(r"https?://([^/]*)", url)[1]
        said = re.search(r'<html lang="(\w+)', html)
        facts.append((page_id, [0.999 * x / sum(e) + 0.001 / len(names) for x in e], {"host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1], "declared": said[1] if said else None}))
    mass = [sum(p[k] for _, p, _ in facts) for k in range(len(names))]
    out = {}
    for page_id, p, keys in facts:

        def own(key, k):
            return sum(q[k] for j, q, other in facts if j != page_id and other[key] == keys[key] and keys[key] is not None)

        def total(key):
            return sum(own(key, k) for k in range(len(names)))

        scores = []
        for k in range(len(names)):
            score = math.log(p[k])
            for key, weight in (("declared", 1), ("suffix", 0.5)):
                if keys[key] is not None:
                    score += weight * math.log((own(key, k) + 0.5) / (mass[k] + 0.5 * (len({f[2][key] for f in facts} - {None}) + 1)))
            share = (mass[k] + 1) / (sum(mass) + len(names))
            domain = (own("domain", k) + smooth * share) / (total("domain") + smooth)
            scores.append(score + math.log((own("host", k) + smooth * domain) / (total("host") + smooth)))
        top = max(scores)
        out[page_id] = (names[scores.index(top)], 1 / sum(math.exp(x - top) for x in scores))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    docs = [(i, say(lang, r, 30), lang) for i, lang in enumerate(["en", "fr", "de"] * 12)]
    pages = []
    for i in range(90):
        lang = r.choice(["en", "fr", "de"])
        said = f' lang="{lang if r.random() < 0.8 else "en"}"' if r.random() < 0.8 else ""
        pages.append((i, f"http://{'www' if i % 2 else 'm'}.{lang}{r.randrange(3)}.example.{r.choice([lang, 'org'])}/x", f"<html{said}><script>x</script><p>{say(lang, r, r.randrange(0, 3))}</p>"))
    got = {x.page_id: x for x in identify_languages(spark.createDataFrame(pages, PAGE), spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    for i, (lang, confidence) in slow(pages, docs).items():
        assert abs(got[i].confidence - confidence) < 1e-6 and (got[i].lang == lang or confidence < 0.5 + 1e-6), i


def test_each_evidence_raises_held_out_accuracy(spark):
    """Pages of few letters, with declarations and hosts that are mostly right: what they add, and that long texts stand against them."""
    r = random.Random(9)
    docs = spark.createDataFrame([(i, say(lang, r, 80), lang) for i, lang in enumerate(["en", "fr", "de"] * 150)], "doc_id long, text string, lang string")
    pages, truth = [], {}
    for i in range(1500):
        lang = truth[i] = r.choice(["en", "fr", "de"])
        other = lambda share: lang if r.random() < share else r.choice(["en", "fr", "de"])  # noqa: B023, E731
        host = f"h{r.randrange(20)}.{other(0.9)}site.{other(0.7)}"
        body = say(lang, r, 60) if i % 5 == 0 else r.choice({"en": ["", "er"], "fr": ["", "en"], "de": ["", "er", "en"]}[lang])
        pages.append((i, f"https://{host}/p", f'<html lang="{other(0.85)}"><p>{body}</p>'))
    table = spark.createDataFrame(pages, PAGE)
    right = {}
    for name, use in {"text": (), "declared": ("declared",), "suffix": ("suffix",), "host": ("host",), "all": ("declared", "suffix", "host")}.items():
        found = {x.page_id: x for x in identify_languages(table, docs, evidence=use).collect()}
        right[name] = sum(found[i].lang == lang for i, lang in truth.items()) / len(truth)
        long = [found[i].lang == truth[i] for i in range(0, 1500, 5)]
        assert sum(long) / len(long) > 0.99, name
        if name == "all":
            assert sum(x.lang != x.text_lang for x in found.values()) > 100
    print({k: round(v, 3) for k, v in right.items()})
    assert right["all"] > max(right["declared"], right["host"], right["suffix"]) and min(right["declared"], right["host"], right["suffix"]) > right["text"] + 0.02


def test_calibration_is_by_length(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, say(lang, r, 60), lang) for i, lang in enumerate(["en", "fr"] * 100)], "doc_id long, text string, lang string")
    names, logs = train_text_model(docs)
    found = calibrate(docs, names, logs, 0.3)
    assert len(found) == len(_LENGTHS) and (found[1:] <= found[:-1]).all() and (found > 0).all()
    few = docs.limit(20)
    assert (calibrate(few, *train_text_model(few), 0.3) == 0.3).all()


def test_markup_is_left_out_in_linear_time():
    assert visible(b"a<script>b</script>c<SCRIPT x>d</script >e<nav>f<nav>g</nav>h").split() == [b"a", b"c", b"e", b"h"]
    assert visible(b"a<!-- b --> c <!-- d").split()[:2] == [b"a", b"c"]
    assert visible(b"a<style>b").split() == [b"a", b"b"]
    for part in (b"<script", b"<script>", b"<!--", b"<", b"</script", b"<nav></script>", b"<aside><footer></aside>"):
        began = time.monotonic()
        visible(part * 300_000)
        assert time.monotonic() - began < 5, part

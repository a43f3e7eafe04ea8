"""Language of web pages by Bayesian fusion of four kinds of evidence.

Text: naive Bayes over byte trigrams, learnt from labelled documents; how much a trigram counts is calibrated, by length of text, on documents
held out from that, so that short texts leave room for the other evidence. Declared markup language and address suffix: their
likelihoods given the language, from soft counts over all pages. Host: a prior, smoothed towards its domain's and that
towards the whole crawl's. The soft counts are grouped sums of text posteriors; a page's own share is taken out
before they are used on it, so no page speaks for itself twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.rows import once
from quire.llm.staging import look_up, stage, text_or_empty

_CELLS = 1 << 16
_ASIDE = re.compile(rb"(?i)<!--|<(script|style|nav|footer|aside|noscript)\b|</(script|style|nav|footer|aside|noscript)\s*>")
_TAG = re.compile(rb"<[^>]*>|&[#A-Za-z0-9]{1,10};")
_ENTITY = re.compile(rb"&[#A-Za-z0-9]{1,10};")
_SPACE = re.compile(rb"[\s0-9!-/:-@\[-`{-~]+")


def _asides(html: bytes) -> Iterator[tuple[int, int]]:
    """Places of comments, and of scripts, navigation and the like from their start to their end; what is never closed is none. One pass."""
    marks = list(_ASIDE.finditer(html))
    last_close = {m.group(2).lower(): m.start() for m in marks if m.group(2)}
    at, opened = 0, None  # opened: name and start of what is being left out
    last_comment, last_mark = html.rfind(b"-->"), html.rfind(b">")
    for m in marks:
        if opened:
            if m.group(2) and m.group(2).lower() == opened[0] and m.start() >= at:
                yield opened[1], m.end()
                at, opened = m.end(), None
        elif m.start() < at:
            continue
        elif m.group(1):
            name = m.group(1).lower()
            inside = html.find(b">", m.end()) + 1 if m.end() <= last_mark else 0
            if inside and last_close.get(name, -1) >= inside:
                at, opened = inside, (name, m.start())
        elif not m.group(2) and m.end() <= last_comment:
            at = html.index(b"-->", m.end()) + 3
            yield m.start(), at


def visible(html: bytes) -> bytes:
    """Text of a page without markup, scripts, navigation and footers, in time linear in its length."""
    parts, at = [], 0
    for start, end in _asides(html):
        parts.append(html[at:start])
        at = end
    text = b" ".join([*parts, html[at:]])
    # beyond the last > no tag can end, and looking for its end at each < would take the square of the length
    tags = text.rfind(b">") + 1
    return _TAG.sub(b" ", text[:tags]) + _ENTITY.sub(b" ", text[tags:])


def trigrams(text: bytes) -> np.ndarray:
    """Cells of the byte trigrams of a text, in lower case, white space and marks as one blank."""
    data = np.frombuffer(_SPACE.sub(b" ", b" " + text.lower() + b" "), np.uint8).astype(np.uint32)
    code = data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = total.setdefault(lang, np.zeros(_CELLS, np.int64))
            counts += np.bincount(trigrams(text.as_py()), minlength=_CELLS)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["lang", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(counts.as_py(), np.int64)
            total[lang] = total[lang] + part if lang in total else part
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["lang", "counts"])


def _sample(labelled: DataFrame, train_rows: int) -> DataFrame:
    """lang, text and held: about ``train_rows`` labelled rows (and 64 of each language), picked by a hash; one in five is held out where a language has more than 64.

    An equal share is taken of every language, or all its rows if they are fewer; what these leave goes to the others. The table is read twice: for the sizes, a
    row for each language, and for the rows, which are written.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("lang", F.col("lang").cast("string"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    whole, left, rates = 1 << 20, train_rows, {}
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, max(1, left // (len(sizes) - i)))
        left = max(0, left - take)
        # below 64 rows all are taken, so chance leaves no language out
        rates[lang] = whole if n <= 64 or sum(sizes.values()) <= train_rows else min(whole, -(-whole * max(take, 64) // n))
    if not rates:
        return stage(rows.select("lang", F.col("text").cast("binary").alias("text"), F.lit(False).alias("held")), "sample")
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    many = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, n > 64)]), F.col("lang"))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(whole)) < rate)
    held = many & (F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(5)) == 0)
    return stage(rows.select("lang", F.col("text").cast("binary").alias("text"), held.alias("held")), "sample")


def train_text_model(labelled: DataFrame, train_rows: int = 6000) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities by cell, of a bounded sample of all labelled rows (see ``_sample``). Rows held out for calibration aren't counted."""
    return _text_model(_sample(labelled, train_rows))


def _text_model(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    rows = sample.where("NOT held").select("lang", "text")
    found = rows.mapInArrow(_count, "lang string, counts binary").repartition("lang").mapInArrow(_add, "lang string, counts binary").orderBy("lang").collect()
    logs = np.empty((len(found), _CELLS))
    for i, f in enumerate(found):  # a row of the model at a time, whose size is that of its languages
        counts = np.frombuffer(f.counts, np.int64) + 0.5
        logs[i] = np.log(counts / counts.sum())
    return [f.lang for f in found], logs


#: Lengths of windows, in trigrams, by which the text's evidence is calibrated, and the weights that are tried.
_LENGTHS = [1 << i for i in range(2, 13)]
_TEMPERS = np.geomspace(0.02, 1.0, 24)


def _log_likelihood(logs: np.ndarray, cells: np.ndarray) -> np.ndarray:
    if len(cells) > _CELLS // 4:
        return logs @ np.bincount(cells, minlength=_CELLS)
    return logs[:, cells].sum(1)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


def _losses(names: list[str], logs: np.ndarray):
    known = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(_LENGTHS), len(_TEMPERS))), np.zeros(len(_LENGTHS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = trigrams(text.as_py())
                if lang not in known:
                    continue
                for i, length in enumerate(_LENGTHS):
                    # up to four windows, evenly over the whole text
                    for at in sorted({(len(cells) - length) * j // 3 for j in range(4)}) if len(cells) >= length else []:
                        s = _log_likelihood(logs, cells[at : at + length])
                        total[i] += _log_sum(s[:, None] * _TEMPERS) - s[known[lang]] * _TEMPERS
                        n[i] += 1
        rows = [(i, t, total[i, t], n[i]) for i in range(len(_LENGTHS)) for t in range(len(_TEMPERS)) if n[i]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["length", "temper", "loss", "n"])

    return run


def calibrate(labelled: DataFrame, names: list[str], logs: np.ndarray, temper: float, train_rows: int = 6000) -> np.ndarray:
    """The weight of a trigram's log likelihood by length of text: of ``_TEMPERS`` the one with the least loss on windows of held-out documents.

    Longer texts never get a larger weight than shorter ones. Lengths of which there are no windows take the next shorter one's weight, or ``temper``.
    """
    return _calibrate(_sample(labelled, train_rows), names, logs, temper)


def _calibrate(sample: DataFrame, names: list[str], logs: np.ndarray, temper: float) -> np.ndarray:
    held = sample.where("held").select("lang", "text")
    losses = held.mapInArrow(_losses(names, logs), "length int, temper int, loss double, n long").groupBy("length", "temper").agg(F.sum("loss").alias("loss")).collect()  # a row for each length and weight
    out, last = np.zeros(len(_LENGTHS)), None
    for i in range(len(_LENGTHS)):
        tried = [(x.loss, x.temper) for x in losses if x.length == i]
        if tried:
            found = float(_TEMPERS[min(tried)[1]])
            last = found if last is None else min(last, found)
        out[i] = temper if last is None else last
    return out


def _posteriors(logs: np.ndarray, tempers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(batch), len(logs)))
            for i, html in enumerate(batch.column(4)):
                cells = trigrams(visible(html.as_py()))
                out[i] = _log_likelihood(logs, cells) * tempers[max(0, int(np.searchsorted(_LENGTHS, len(cells), side="right")) - 1)]
            out = np.exp(out - out.max(1, keepdims=True, initial=-1e300))
            out = 0.999 * out / out.sum(1, keepdims=True) + 0.001 / len(logs)  # no page is certain by its text
            places = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(logs))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(places, pa.array(out.ravel()))], names=["page_id", "host", "declared", "html_bytes", "p"])

    return run


def declared_language(html: Column) -> Column:
    """Primary subtag of the html element's lang, in lower case; null without one."""
    return F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", 1), F.lit("")))


def identify_languages(pages: DataFrame, labelled: DataFrame, train_rows: int = 6000, smooth: float = 8.0, temper: float = 0.3, evidence: tuple[str, ...] = ("declared", "suffix", "host")) -> DataFrame:
    """One row for each page: page_id, lang, confidence, text_lang, declared, host.

    labelled: doc_id, text, lang. Null or empty pages have no text evidence, a missing declaration or address is no evidence;
    with nothing at all a page gets its host's or the crawl's commonest language. Ties go to the language first by name. Rows without a
    page_id take no part; repeated rows are returned as often. Any number of languages is told apart; the model has half a megabyte for each. Other
    columns of both tables are not read, and pages of any length are read to their end. Without labelled rows lang is the declared one, with confidence 0.
    An empty table gives an empty result. smooth: pages that a parent's distribution counts for. temper: weight of a trigram's
    log likelihood where no labelled documents are held out to calibrate it; below 1, because trigrams overlap. evidence: what counts beside the text.
    """
    html = text_or_empty(pages, "html")
    host = F.lower(F.regexp_extract(F.coalesce(pages["url"].cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), declared_language(html).alias("declared"), F.octet_length(html).cast("long").alias("html_bytes"), html.cast("binary").alias("html"))
    sample = _sample(labelled, train_rows)
    names, logs = _text_model(sample)
    if not names:
        return rows.select("page_id", F.col("declared").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    n = len(names)
    tempers = _calibrate(sample, names, logs, temper)
    scored = stage(rows.mapInArrow(_posteriors(logs, tempers), "page_id long, host string, declared string, html_bytes long, p array<double>"), "posteriors")
    scored = scored.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})
    summed = F.array(*[F.sum(F.get("p", k)) for k in range(n)])

    def sums(key: str) -> DataFrame:
        return stage(scored.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"{key}_n"), summed.alias(f"{key}_p")), f"by-{key}")

    whole = scored.agg(F.count("*").alias("n"), summed.alias("p"), F.count_distinct("declared").alias("declared"), F.count_distinct("suffix").alias("suffix")).first()
    mass = [float(x or 0.0) for x in whole.p]
    share = [(m + 1.0) / (sum(mass) + n) for m in mass]
    joined = scored
    for key in ("declared", "suffix", "domain", "host"):
        joined = look_up(joined, sums(key), [key], f"{key}_n", whole.n, ["page_id"])

    none = F.array_repeat(F.lit(0.0), n)
    constants = lambda values: F.array(*map(F.lit, values))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def own(key: str) -> Column:
        """A key's sums without the page's own share."""
        return F.zip_with(F.coalesce(f"{key}_p", none), "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def likelihood(key: str) -> Column:
        """The log likelihood of a page's value by language; 0 without one."""
        if key not in evidence:
            return none
        seen = F.zip_with(own(key), constants([m + 0.5 * (whole[key] + 1) for m in mass]), lambda a, m: F.log((a + 0.5) / m))
        return F.when(F.col(key).isNull() | (F.col(key) == ""), none).otherwise(seen)

    joined = once(joined, by_declared=likelihood("declared"), by_suffix=likelihood("suffix"))
    if "host" in evidence:
        joined = once(joined, own_host=own("host"), own_domain=own("domain"))
        joined = once(joined, total_host=total(F.col("own_host")), total_domain=total(F.col("own_domain")))
        domain = F.zip_with("own_domain", constants(share), lambda a, s: (a + smooth * s) / (F.col("total_domain") + smooth))
        prior = F.zip_with("own_host", domain, lambda a, d: (a + smooth * d) / (F.col("total_host") + smooth))
    else:
        prior = constants(share)
    text = F.zip_with("p", "by_declared", lambda p, x: F.log(p) + x)
    score = F.zip_with(F.zip_with(text, "by_suffix", lambda a, x: a + 0.5 * x), prior, lambda a, x: a + F.log(x))
    known = constants(names)
    first = lambda values: F.element_at(known, F.array_position(values, F.array_max(values)).cast("int"))
    found = once(joined, s=score).withColumn("top", F.array_max("s"))
    confidence = 1 / F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return found.select("page_id", first(F.col("s")).alias("lang"), confidence.alias("confidence"), first(F.col("p")).alias("text_lang"), "declared", "host")

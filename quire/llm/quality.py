"""Quality scores: random Fourier features, ridge regression and isotonic calibration.

Document statistics are standardised and mapped to cosines at random frequencies, whose inner products approximate a
Gaussian kernel. The normal equations of the ridge regression are sums over rows: each task sums its own, a second
round of tasks sums those, and the driver solves one system whose size is fixed. Raw scores are then calibrated
by isotonic regression over a fixed number of score bins, on a fold of the labelled rows that the regression hasn't seen. All labelled training rows are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.staging import partitions, stage, text_or_empty

STATS = ("log_bytes", "letters", "upper", "digits", "loud", "symbols", "stops", "spaces", "high", "word_bytes", "distinct_words", "repeated_words", "distinct_lines", "line_words", "evenness", "bar")
_BINS = 2000


def _classes() -> np.ndarray:
    """Byte value to class sums: letters, upper case, digits, loud marks, symbols, stops, white space, beyond ASCII, bars."""
    groups = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "#$%&*<>{}[]\\/=+@^~`_", ".,;:", " \t\n\r", "", "|")
    table = np.zeros((256, len(groups)))
    for i, group in enumerate(groups):
        table[list(group.encode()), i] = 1
    table[128:, 7] = 1
    return table


_CLASS = _classes()


def statistics(text: bytes) -> list[float]:
    """The numbers in STATS of a whole text; all 0 for an empty one."""
    if not text:
        return [0.0] * len(STATS)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, upper, digits, loud, symbols, stops, spaces, high, bar = (counts @ _CLASS).tolist()
    share = counts[counts > 0] / n
    words, lines = text.lower().split(), [x for x in text.split(b"\n") if x]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    # the share of distinct words falls with length by itself; the logarithms' ratio hardly does
    distinct = math.log1p(len(set(words))) / math.log1p(n_words)
    repeated = sum(map(bytes.__eq__, words, words[1:])) / n_words
    return [
        math.log(n + 1), letters / n, upper / max(1, letters), digits / n, loud / n, symbols / n, stops / n, spaces / n, high / n,
        math.log((n - spaces) / n_words + 1), distinct, repeated, len(set(lines)) / n_lines, math.log(n_words / n_lines + 1), float(-(share * np.log(share)).sum()) / math.log(len(share) + 1), bar / n,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = np.array([statistics(x.as_py()) for x in batch.column(1)], np.float32).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["doc_id", *STATS])


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(len(STATS))], axis=1).astype(np.float64)


class FourierMap:
    """Cosines at random frequencies of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.waves = random.normal(0, 1 / width, (len(STATS), features))
        self.phase = random.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.waves + self.phase), np.ones((len(x), 1))])


def _sums(fourier: FourierMap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(fourier.phase) + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            z, y = fourier(_matrix(batch, 2)), batch.column(1).to_numpy(zero_copy_only=False)
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0):
            part = np.frombuffer(x.as_py())
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def pool_adjacent(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing fit by weighted least squares."""
    blocks: list[list[float]] = []
    for value, w in zip(y.tolist(), weight.tolist(), strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w2, n = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + v * w2) / (last[1] + w2)
            last[1] += w2
            last[2] += n
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def quality_scores(docs: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-3, threshold: float = 0.7, seed: int = 11) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    Labels (doc_id, quality 0 or 1) are learnt only from rows with crc32(doc_id as text) mod 4 other than 2; the
    rest is held out. Of those rows, the ones with remainder 3 calibrate what the others are fitted to; where either part has labels of one value only, all
    serve for both. Labels that are null or on unknown documents are left out; where a doc_id has several, each
    counts. The score depends on the whole text only. Null texts count as empty and are scored like any other. Rows
    without a doc_id take no part; repeated rows are returned as often. Without labels, or with labels of one value, nothing can
    be told apart: every score is the mean label, or 1 without labels. Other columns of both tables are not read, whatever their names; texts of any length are
    measured whole, and equal texts score the same. An empty table gives an empty result.

    width: of the Gaussian kernel, in standard deviations. ridge: as a share of the number of training rows.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).cast("binary").alias("body"))
    measured = stage(rows.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{s} float" for s in STATS)), "statistics")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(fold != 2)
    train = stage(measured.join(marks, "doc_id").select("doc_id", "y", *STATS), "labelled")
    held = (fold == 2).alias("held_out")
    folds = {r.own: r for r in train.groupBy((fold == 3).alias("own")).agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect()}
    n, good = sum(f.n for f in folds.values()), sum(f.good for f in folds.values())
    if not n or good in (0.0, n):
        scored = measured.select("doc_id", held, F.lit(good / n if n else 1.0).cast("double").alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    fit, own = train, train
    if len(folds) == 2 and all(0 < f.good < f.n for f in folds.values()):
        fit, own = train.where(fold != 3), train.where(fold == 3)
    known = fit.agg(F.count("*").alias("n"), *[F.avg(s).alias(f"mean_{s}") for s in STATS], *[F.stddev_pop(s).alias(f"dev_{s}") for s in STATS]).first()

    fourier = FourierMap(np.array([known[f"mean_{s}"] for s in STATS]), np.array([known[f"dev_{s}"] for s in STATS]), features, width, seed)
    sums = fit.mapInArrow(_sums(fourier), "sums binary")
    several = max(1, math.isqrt(partitions(docs.sparkSession)))
    parts = sums.repartition(several).mapInArrow(_add, "sums binary").collect()  # a row for each of the few tasks
    size = features + 1
    total = sum(np.frombuffer(p.sums) for p in parts).reshape(size, size + 1)
    penalty = np.diag([ridge * known.n / features] * features + [0.0])
    weights = np.linalg.solve(total[:, :-1] + penalty + 1e-9 * np.eye(size), total[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = fourier(_matrix(batch, 2)) @ weights
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "y", "raw"])

    place = F.greatest(F.lit(0), F.least(F.lit(_BINS), F.floor((F.col("raw") + 0.5) * (_BINS / 2)))).cast("int")
    bins = own.mapInArrow(raw, "doc_id long, y double, raw double").groupBy(place.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    xs, fit = np.array([b.x for b in bins]), pool_adjacent(np.array([b.y for b in bins]), np.array([float(b.n) for b in bins]))

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(np.interp(fourier(_matrix(batch, 1)) @ weights, xs, fit), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = measured.select("doc_id", *STATS).mapInArrow(calibrated, "doc_id long, score double")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

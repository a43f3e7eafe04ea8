"""Scores against plain NumPy over all rows at once, and held-out ranking."""

import random
import zlib

import numpy as np

from helpers import frame, prose
from quire.llm.quality import STATS, quality_scores, statistics


def corpus():
    r = random.Random(4)
    texts, labels = [], []
    for i in range(240):
        words = prose(i, 40 + i % 50).split()
        noise = r.random()
        labels.append(int(noise < 0.6))
        share = noise if labels[-1] == 0 else noise * 0.4
        texts.append(" ".join(w.upper() + "!?" if r.random() < share else w for w in words))
    return texts, labels


def slow(texts, labels, features, width=4.0, ridge=1e-3, seed=11):
    """One matrix, one solution; isotonic values by the max-min formula over bins."""
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i in range(len(texts))])
    x = np.array([statistics(t.encode()) for t in texts], np.float32).astype(np.float64)
    fit, own, y = (fold != 2) & (fold != 3), fold == 3, np.array(labels, float)
    mean, dev = x[fit].mean(0), x[fit].std(0)
    random_numbers = np.random.default_rng(seed)
    waves, phase = random_numbers.normal(0, 1 / width, (len(STATS), features)), random_numbers.uniform(0, 2 * np.pi, features)
    z = np.clip((x - mean) / np.where(dev > 1e-9, dev, 1), -6, 6)
    f = np.column_stack([np.cos(z @ waves + phase) * np.sqrt(2 / features), np.ones(len(x))])
    a = f[fit].T @ f[fit] + np.diag([ridge * fit.sum() / features] * features + [0]) + 1e-9 * np.eye(features + 1)
    raw = f @ np.linalg.solve(a, f[fit].T @ y[fit])
    place = np.clip(np.floor((raw + 0.5) * 1000), 0, 2000)
    bins = np.unique(place[own])
    xs = np.array([raw[own & (place == b)].mean() for b in bins])
    ys, ns = (np.array([v[own & (place == b)].sum() for b in bins]) for v in (y, np.ones(len(y))))
    iso = [max(min(ys[j : k + 1].sum() / ns[j : k + 1].sum() for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    return np.clip(np.interp(raw, xs, iso), 0, 1), fold


def auc(scores, labels):
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2).item()


def test_scores_against_numpy(spark):
    texts, labels = corpus()
    want, fold = slow(texts, labels, 48)
    rows = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_scores(frame(spark, texts), rows, features=48).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-4
    held = fold == 2
    assert auc(want[held], np.array(labels)[held]) > 0.9


def test_a_fold_of_one_value(spark):
    """Where the calibration fold can't tell anything, all training rows serve for both."""
    texts, labels = corpus()
    rows = [(i, 1 if zlib.crc32(str(i).encode()) % 4 == 3 else y) for i, y in enumerate(labels)]
    got = quality_scores(frame(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int"), features=16).collect()
    assert len(got) == len(texts) and len({r.score for r in got}) > 2

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helpers import SCHEMA, frame, odd_texts, prose
from quire.llm.packing import Problem, pack_documents
from quire.llm.tokens import WordEncoder, default_path


def test_encoder_equals_the_tokenizer():
    encoder = WordEncoder.of(default_path())
    texts = odd_texts() + ["a<|endoftext|> b", "x_y #_# it's DON'T İstanbul ΣΑΣ ² ½ é \xa0 a　b \x85 \x1c q", "  lead trail  ", "caffè ÀÉ ñ ß", "é́"]
    for got, text in zip(encoder.encode(pa.array(texts, pa.string())), texts, strict=True):
        assert got.tolist() == encoder.whole.encode(text or "", add_special_tokens=False).ids


def test_packing_round_trip(spark):
    texts = odd_texts() + [prose(i, 20 + 37 * i) for i in range(60)]
    docs = frame(spark, texts).withColumn("item", F.lit("clash")).withColumn("body", F.lit(1))
    rows = pack_documents(docs, problem_rows=40).collect()
    encoder, total = WordEncoder.of(default_path()), 0
    by = {(r.doc_id, r.piece): r for r in rows}
    assert len(by) == len(rows)
    for i, text in enumerate(texts):
        ids = [*encoder.whole.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            r = by.pop((i, piece))
            part = np.array(ids[start : start + 2048], "<u4")
            assert (r.start, r.length, r.ids_crc32) == (start, len(part), zlib.crc32(part.tobytes()))
    assert not by
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert ends[r.sequence_id] <= 2048
    assert len(ends) <= -(-total // 2048) + 4


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_evolution_keeps_every_piece_and_never_worsens():
    noise = random.Random(1)
    for _ in range(20):
        lengths = [noise.randrange(300, 1100) for _ in range(60)]
        problem = Problem(lengths, 2048)
        plain = problem.best_fit([], list(range(60)))
        best = problem.evolve([], noise, 6, 40)
        assert sorted(i for b in best for i in b) == list(range(60))
        assert all(problem.fill(b) <= 2048 for b in best) and problem.bound <= len(best) <= len(plain)
        child = problem.mutate(problem.crossover(plain, best, noise), noise)
        assert sorted(i for b in child for i in b) == list(range(60))


def fewest(lengths, capacity):
    """The fewest bins, by the subsets that can fill one bin after another."""
    n = len(lengths)
    best = {0: (1, 0)}  # of each set of pieces: bins, and the least that its last bin must hold
    for s in range(1, 1 << n):
        best[s] = min((b, used + lengths[i]) if used + lengths[i] <= capacity else (b + 1, lengths[i]) for i in range(n) if s >> i & 1 for b, used in [best[s ^ 1 << i]])
    return best[(1 << n) - 1][0]


def test_small_problems_against_the_optimum():
    noise, over, plain_over = random.Random(9), 0, 0
    for _ in range(60):
        low, high = noise.choice([(300, 1100), (500, 900), (100, 2048)])
        lengths = [noise.randrange(low, high + 1) for _ in range(11)]
        problem = Problem(lengths, 2048)
        least = fewest(lengths, 2048)
        best = problem.evolve([], noise, 5, 60)
        assert least <= len(best) <= least + 1
        over += len(best) > least
        plain_over += len(problem.best_fit([], list(range(11)))) > least
    assert over <= 6 and over < plain_over  # never more than one bin over, and mostly none

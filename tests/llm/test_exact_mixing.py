import itertools
import random
from fractions import Fraction

from helpers import SCHEMA, frame
from quire.llm.mixing import exact_slots, mix_sources


def drift(blocks, weights):
    """Largest distance from the exact weights within a phase, in blocks; every block has to come once and in turn."""
    got, worst = [0] * len(blocks), Fraction(0)
    for _, slots in itertools.groupby(exact_slots(blocks, weights), key=lambda x: x[2]):
        live = [s for s in range(len(blocks)) if got[s] < blocks[s] and weights[s] > 0]
        total = sum(Fraction(weights[s]) for s in live)
        done = [0] * len(blocks)
        for t, (s, block, _) in enumerate(slots, 1):
            assert block == got[s] and (s in live or not live)
            got[s] += 1
            done[s] += 1
            if t % 97 == 0 or t < 300:
                worst = max([worst, *(abs(done[x] - Fraction(weights[x]) / total * t) for x in live)])
    assert got == blocks
    return worst


def test_drift_stays_below_one_block():
    rows = [40_000, 30_000, 20_000, 10_000, 5_000]
    assert drift(rows, [n**0.5 for n in rows]) < 1
    r = random.Random(3)
    for n in (1, 2, 30, 300):
        blocks = [r.randrange(60) for _ in range(n)]
        assert drift(blocks, [r.random() ** 6 for _ in blocks]) < 1


def test_sources_without_weight_come_last():
    got = [s for s, _, _ in exact_slots([5, 40, 4, 30], [0.0, 1e-5, 0.0, 1.0])]
    assert set(got[:70]) == {1, 3} and sorted(got[70:]) == [0] * 5 + [2] * 4
    assert got[:31].count(1) <= 1  # a small weight is no more than that


def test_unnamed_sources_come_last_in_the_table(spark):
    rows = mix_sources(frame(spark, [f"text {i}" for i in range(200)]), {"s0": 1.0, "s1": 3.0}, block_rows=2).collect()
    named = [r.mix_slot for r in rows if r.source in ("s0", "s1")]
    assert len(rows) == 200 and max(named) < min(r.mix_slot for r in rows if r.source not in ("s0", "s1"))


def test_many_sources(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"host{i % 700}", 2) for i in range(3000)], SCHEMA)
    rows = mix_sources(docs, block_rows=2).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000)) and len({r.mix_source for r in rows}) == 700
    assert {r.mix_slot for r in rows} == set(range(len({(r.mix_source, r.mix_slot) for r in rows})))

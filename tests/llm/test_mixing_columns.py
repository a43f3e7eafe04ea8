"""Columns with any names, and the registered query's skewed weights."""

from fractions import Fraction
from itertools import groupby

from pyspark.sql import functions as F

from helpers import frame
from quire.llm.mixing import mix_sources
from quire.llm.queries import target_weight

NAMES = "at first share round count mix_hash mix_key mix_buckets mix_bucket mix_before mix_number mix_block mix_doc mix_source mix_phase mix_slot mix_row from_block to_block".split()


def test_clashing_columns(spark):
    docs = frame(spark, [f"text {i}" for i in range(90)])
    other = docs.withColumns({n: F.lit(f"own {n}") for n in NAMES}).withColumn("a.b", F.lit(1))
    rows = mix_sources(other, block_rows=4).collect()
    new = {"mix_source", "mix_phase", "mix_slot", "mix_row"}
    assert sorted(r.doc_id for r in rows) == list(range(90)) and set(rows[0].asDict()) == {*other.columns, *new}
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES if n not in new) and all(r["a.b"] == 1 for r in rows)
    assert {r.mix_source for r in rows} == {"null", "=s0", "=s1", "=s2"}


def test_weights_of_the_query_are_kept_within_a_block(spark):
    """At every slot of the first phase each source is within one block of its target weight, which differ by much."""
    docs = frame(spark, [f"text {i}" for i in range(3000)]).withColumn("source", F.concat(F.lit("site"), (F.col("doc_id") % 7).cast("string")))
    rows = mix_sources(docs, target_weight, block_rows=4).collect()
    blocks = sorted({(r.mix_phase, r.mix_slot, r.source) for r in rows})
    weights = {s: Fraction(target_weight(s, sum(r.source == s for r in rows))) for s in {r.source for r in rows}}
    assert max(weights.values()) > 2 * min(weights.values())
    first = [s for _, part in groupby(blocks, key=lambda b: b[0]) for *_, s in part][: sum(b[0] == 0 for b in blocks)]
    done, total = dict.fromkeys(weights, 0), sum(weights.values())
    for t, s in enumerate(first, 1):
        done[s] += 1
        assert all(abs(n - weights[x] / total * t) < 1 for x, n in done.items())

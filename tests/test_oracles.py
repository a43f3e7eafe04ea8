"""Every registered query of the library against its SQL, on the driver's small tables where they are there."""

import math
import os

import duckdb
import pytest

from quire.queries import EXAMPLE_ORACLES, EXAMPLES, ORACLES, QUERIES

DATA = os.environ.get("QUIRE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted({**QUERIES, **EXAMPLES}))
def test_query(spark, duck, name):
    got = {**QUERIES, **EXAMPLES}[name](spark, DATA)
    rows = got.collect()
    sql = {**ORACLES, **EXAMPLE_ORACLES}.get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in cursor.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)
    assert len(have) == len(want)
    wrong = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    assert not wrong, (sorted(columns), len(wrong), wrong[:3])

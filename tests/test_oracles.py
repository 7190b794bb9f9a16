"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def test_all_have_both():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    want = tables.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    got = Counter(tuple(map(plain, r)) for r in got.select(*[f"`{n}`" for n in names]).collect())
    assert got == Counter(tuple(map(plain, r)) for r in want.fetchall())

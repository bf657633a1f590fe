"""Every query against its SQL counterpart on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quern.catalog import QUERIES
from quern.oracles import ORACLE_SQL


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)

"""Every registered query against its independent SQL on the smallest tables."""

import datetime as dt
import math
from pathlib import Path

import pytest

from siftline.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, dt.datetime | dt.date):
        return str(v)[:26]
    return repr(v)


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    df = registry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(tuple(cell(v) for v in r) for r in df.select(*cols).collect())
    rel = oracle.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert registry.oracle_sql().keys() == registry.queries().keys()

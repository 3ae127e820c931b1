import datetime
import decimal
import math

import duckdb
import pytest

from lodestone.plans import registry
from lodestone.sources.tables import TABLES

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def tiny():
    return "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert {f"tpch_q{k:02d}" for k in range(1, 23)} <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, oracle, name):
    df = QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = oracle.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)

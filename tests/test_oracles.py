"""Every query that has an oracle gives the oracle's rows at the smallest scale."""

import decimal
from pathlib import Path

import duckdb
import pytest

from sparkloom import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def text(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    return str([text(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("key", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, key):
    df = catalog.queries()[key](spark, str(DATA))
    columns = sorted(df.columns)
    expected = duck.sql(catalog.oracle_sql()[key])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(text(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(text(r[k]) for k in at) for r in expected.fetchall())


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())

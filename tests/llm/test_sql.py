"""The operators that SQL can express give the rows of their SQL on whole tables."""

from pathlib import Path

import duckdb
import pytest

from sparkloom.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, key):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = queries.QUERIES[key](spark, str(DATA))
    columns = sorted(df.columns)
    expected = con.sql(queries.ORACLE_SQL[key])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in expected.fetchall())

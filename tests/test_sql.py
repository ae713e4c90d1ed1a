"""Every query that has SQL gives the values of that SQL, row by row."""

import os

import pandas as pd
import pytest

from orrery import chain_queries, engine_queries  # noqa: F401 (they register queries and SQL)
from orrery import queries as Q

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def large(sf_dir):
    return sf_dir.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def tables(large):
    con = duckdb.connect()
    for f in os.listdir(large):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{large}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, tables, large, name):
    got, want = Q.QUERIES[name](spark, large).toPandas(), tables.execute(Q.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0
    numbers = [c for c in columns if got[c].dtype.kind in "fiu"]
    for x in (got, want):
        x[numbers] = x[numbers].astype(float)
    order = [c for c in columns if c not in numbers] + numbers
    got, want = (x[order].sort_values(order, na_position="first").reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=0, atol=1e-9)

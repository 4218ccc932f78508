"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from combtrack.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{x:.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    own = catalogue.queries()[name](spark, DATA)
    other = con.execute(catalogue.oracle_sql()[name])
    assert sorted(own.columns) == sorted(c[0] for c in other.description)
    assert rows(own.columns, own.collect()) == rows([c[0] for c in other.description], other.fetchall())

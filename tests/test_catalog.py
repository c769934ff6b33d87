"""Every registered street query against its SQL."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from lanecraft.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (float, Decimal)):
        return repr(round(float(value), 6) + 0.0)
    return repr(value)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = tables.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())

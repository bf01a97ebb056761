"""Every registered query of the engine against its oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from veridex.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, tables, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    found = tables.execute(ORACLE_SQL[name])
    at = [[c[0] for c in found.description].index(n) for n in names]
    assert ours == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())

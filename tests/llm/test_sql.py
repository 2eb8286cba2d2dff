import glob
import os

import duckdb
import pytest

from meshwork.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want, found = con.sql(SQL[name]), QUERIES[name](spark, SF)
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)

import glob
import os

import duckdb
import pytest

from meshwork.plans import campaign_queries, format_queries, matrix_queries, report_queries, solver_queries

SF = "/root/testdata/sf0.001"
SLOW = {"l10_multigrid_local_solves", "m03_additive_multiplicity", "q31_smallest_modes", "r02_bicgstab_convdiff", "t02_chain_time_loop"}
CASES = [(n, m.Q[n], m.S[n]) for m in (matrix_queries, report_queries, campaign_queries, format_queries, solver_queries) for n in m.S if n not in SLOW]


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return v if isinstance(v, bool) or not isinstance(v, float) else 0.0 if v == 0 else float(f"{v:.9g}")


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_rows_as_sql(spark, con, name, query, sql):
    found, want = query(spark, SF), con.sql(sql)
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    rows = sorted((tuple(plain(r[n]) for n in names) for r in found.collect()), key=str)
    at = [want.columns.index(n) for n in names]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)

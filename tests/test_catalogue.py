from pyspark.sql import functions as F

from meshwork.operators import algebra, graph
from meshwork.plans import matrix_queries
from meshwork.plans.store import written
from meshwork.sources import tables

SF = "/root/testdata/sf0.001"


def test_decomposition_queries_take_the_whole_catalogue(spark):
    """d02, d05, d06, d08, d09, a11, w03 and j09 work on the co-purchase matrix: each part is owned once, all entries are met."""
    parts, entries = tables.table(spark, SF, "part").count(), tables.copurchase(spark, SF).count()
    sizes = matrix_queries.Q["a11_subdomain_sizes"](spark, SF).collect()
    assert sum(r.n_own for r in sizes) == parts and sum(r.nnz for r in sizes) > entries
    met = matrix_queries.Q["j09_semi_anti"](spark, SF).collect()
    assert sum(r.inside for r in met) == sum(r.nnz for r in sizes)
    for name in ("d02_edge_cut", "d05_local_matrices", "d06_lumping", "d08_multiplicity_unity", "d09_lumped_matrices", "w03_ghost_blocks", "a11_subdomain_sizes", "j09_semi_anti"):
        assert "FROM part" in matrix_queries.S[name] and "FROM orders" not in matrix_queries.S[name]


def test_copurchase_counts_each_pair_once_and_takes_odd_lines(spark, tmp_path, capsys):
    """Repeated lines, nulls, parts that the table lacks, and orders of one part; no part meets all others in a self-join."""
    lines = [(1, 5), (1, 5), (1, 7), (1, None), (None, 5), (None, 7), (2, 7), (2, 5), (2, 9), (3, 8), (4, 11)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in (5, 7, 8, 9)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    a = tables.copurchase(spark, str(tmp_path))
    off = {(5, 7): -2.0, (5, 9): -1.0, (7, 9): -1.0}
    want = off | {(j, i): v for (i, j), v in off.items()} | {(5, 5): 4.0, (7, 7): 4.0, (8, 8): 1.0, (9, 9): 3.0}
    assert sorted(tuple(r) for r in a.collect()) == sorted((i, j, v) for (i, j), v in want.items())
    a.explain()
    assert "Join" not in capsys.readouterr().out


def test_only_the_diagonal_is_shuffled(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, 4.0)], "row long, col long, val double")
    d = spark.createDataFrame([(1, 0.5), (2, 0.5)], "idx long, val double")
    out = algebra.add_diagonal(a, d)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 2.5), (1, 2, 3.0), (2, 1, 4.0), (2, 2, 0.5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Aggregate")


def test_components_join_without_broadcasts(spark, monkeypatch, capsys):
    tables_ = []
    monkeypatch.setattr(graph, "written", lambda df, name: (df.explain(), tables_.append(name), written(df, name))[2])
    nodes = spark.range(6).select(F.col("id").alias("idx"))
    edges = spark.createDataFrame([(0, 1), (2, 1), (4, 5)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.components(nodes, edges).collect()) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4)]
    plans = capsys.readouterr().out
    assert len(tables_) > 2 and "SortMergeJoin" in plans and "Broadcast" not in plans


def test_symmetry_takes_as_many_tasks_as_entries_need(spark, monkeypatch, capsys):
    a = spark.createDataFrame([(i, j, float(i + j)) for i in range(20) for j in range(20)] + [(30, 31, 1.0)], "row long, col long, val double")
    monkeypatch.setattr(algebra, "ENTRIES_A_TASK", 10)
    out = algebra.symmetry(a)
    assert not out.first().symmetric and algebra.symmetry(a.filter("row < 20")).first().symmetric
    out.explain()
    assert ", 40)" in capsys.readouterr().out  # 401 entries in 40 tasks


def test_permutation_takes_as_many_tasks_as_entries_need(spark, monkeypatch, capsys):
    a = spark.createDataFrame([(i, j, float(20 * i + j)) for i in range(20) for j in range(20)], "row long, col long, val double")
    nb = spark.range(20).select(F.col("id").alias("old_idx"), (19 - F.col("id")).alias("new_idx"))
    monkeypatch.setattr(algebra, "ENTRIES_A_TASK", 10)
    monkeypatch.setattr(algebra, "SHORT", 10, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = algebra.permute(a, nb)
        assert {(r.row, r.col): r.val for r in out.collect()} == {(19 - i, 19 - j): float(20 * i + j) for i in range(20) for j in range(20)}
        out.explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert ", 40)" in plan and ", 4)" not in plan  # 400 entries in 40 tasks, the numbering with them

import pytest

from meshwork.operators import algebra
from meshwork.plans.driver import main
from meshwork.sources import matrix_market


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A tridiagonal system, one with an empty row, one that is not square, and a right-hand side of another size."""
    d = tmp_path_factory.mktemp("driver")
    rows = [(i, i, 2.5) for i in range(24)] + [(i, i + 1, -1.0) for i in range(23)] + [(i + 1, i, -1.0) for i in range(23)]
    a = spark.createDataFrame(rows, "row long, col long, val double")
    x = spark.range(24).selectExpr("id AS idx", "double(1 + id % 7) AS val")
    matrix_market.write_problem(a, algebra.spmv(a, x), f"{d}/good")
    matrix_market.write_problem(a.filter("row <> 5 AND col <> 5"), x, f"{d}/hole")
    matrix_market.write_matrix(a.filter("row < 20"), 20, 24, f"{d}/wide")
    matrix_market.write_vector(x.filter("idx < 9"), f"{d}/short")
    return d


def test_exit_statuses(spark, files, capsys):
    good = ["--matrix", f"{files}/good/matrix", f"--rhs={files}/good/rhs", "--parts", "2"]
    assert main(spark, [*good, "--coarse", "none", "--solution", f"{files}/x", "--csv", f"{files}/log"]) == 0
    got = {r.idx: r.val for r in matrix_market.read_vector(spark, f"{files}/x").collect()}
    assert len(got) == 24 and all(abs(v - (1 + i % 7)) < 1e-5 for i, v in got.items())
    assert spark.read.option("header", True).csv(f"{files}/log").first()["converged"] == "true"
    assert main(spark, [*good, "--coarse", "none", "--maxit", "1", "--rtol", "1e-14"]) == 2
    assert "fallbacks=0" in capsys.readouterr().out


@pytest.mark.parametrize("args,said", [
    (["--matrix", "{d}/hole/matrix", "--parts", "2"], "factorizations"),
    (["--matrix", "{d}/wide"], "not square"),
    (["--matrix", "{d}/good/matrix", "--rhs", "{d}/short"], "9 values"),
    (["--matrix", "{d}/good/matrix", "--block", "5"], "multiple"),
    (["--matrix", "{d}/none"], ""),
    (["--parts", "2"], "missing"),
    (["--matrix", "x", "--what", "1"], "unknown"),
    (["--matrix"], "no value"),
])
def test_errors(spark, files, capsys, args, said):
    assert main(spark, [a.format(d=files) for a in args]) == 1
    assert said in capsys.readouterr().err


def test_rows_as_arrays(spark):
    a = spark.createDataFrame([(1, 3, 2.0), (1, 0, 5.0), (2, 1, 1.0)], "row long, col long, val double")
    rows = algebra.row_arrays(a)
    assert sorted(map(tuple, rows.collect())) == [(1, [0, 3], [5.0, 2.0]), (2, [1], [1.0])]
    x = spark.range(4).selectExpr("id AS idx", "double(id + 1) AS val")
    assert sorted(map(tuple, algebra.row_spmv(rows, x).collect())) == sorted(map(tuple, algebra.spmv(a, x).collect()))


def test_symmetry_counts_missing_mirrors(spark):
    of = lambda rows: tuple(algebra.symmetry(spark.createDataFrame(rows, "row long, col long, val double")).first())
    assert of([(0, 0, 4.0), (0, 1, 2.0), (1, 0, 2.0)]) == (True, 0.0)
    assert of([(0, 0, 4.0), (0, 1, 2.0), (1, 0, 1.0)]) == (False, 0.25)
    assert of([(0, 0, 4.0), (1, 0, -2.0)]) == (False, 0.5)
    assert of([]) == (True, 0.0)


def test_a_file_of_many_parts_is_read_in_their_order(spark, tmp_path):
    """Later parts are larger, and Spark reads large files first."""
    lines = ["%%MatrixMarket matrix array real general", "6 1"], ["1.5"], ["2.50000000000", "3.5"], ["4.5000000000000000", "5.5000000000000000", "6.5000000000000000000"]
    matrix = ["%%MatrixMarket matrix coordinate real general", "3 4 3"], ["1 1 1.0000000000000000000000000000000000000"], ["2 2 2.0000000000000000000000000000000000000", "3 4 3.0"]
    for name, parts in (("x", lines), ("a", matrix)):
        (tmp_path / name).mkdir()
        for at, part in enumerate(parts):
            (tmp_path / name / f"part-{at:05d}.txt").write_text("\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for cost in ("1", "1g"):  # files together in a task, and one for each
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            assert [tuple(r) for r in matrix_market.read_vector(spark, f"{tmp_path}/x").orderBy("idx").collect()] == [(i, i + 1.5) for i in range(6)]
            a, rows, cols = matrix_market.read_matrix(spark, f"{tmp_path}/a")
            assert (rows, cols) == (3, 4) and {tuple(r) for r in a.collect()} == {(0, 0, 1.0), (1, 1, 2.0), (2, 3, 3.0)}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)

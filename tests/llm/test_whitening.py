import math
import random

import numpy as np
import pytest

from meshwork.llm import whitening

#: Extra columns have names that the operator uses inside.
SCHEMA = "vec_id long, embedding array<float>, label int, x long, row string, whitened double, deviation long, at int"


def rows_of(vectors, ids=None):
    return [(i if ids is None else ids[i], v, 1, 2, "r", 0.5, 3, 4) for i, v in enumerate(vectors)]


def expected(vectors, d, wanted=4):
    """n, sums, variances, components, total variance by numpy over the different whole vectors."""
    x = np.unique(np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors], dtype=np.int64).reshape(-1, d), axis=0)
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, sums, e[::-1][:wanted], q.T[::-1][:wanted], np.trace(v)


def test_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    good = [list(map(float, rnd.standard_normal(7) * [1, 2, 3, 4, 5, 6, 7])) for _ in range(300)]
    bad = [None, [], [None] * 7, [1.0] * 6 + [float("nan")], [1.0] * 6 + [float("inf")], [1e38] * 7, [1.0, 2.0], [1.0] * 6 + [None]]
    vectors = good + good[:40] + [good[0]] * 200 + bad
    ids = [None if i % 50 == 7 else i for i in range(len(vectors))]
    df = spark.createDataFrame(rows_of(vectors, ids), SCHEMA).repartition(5)
    out, model = whitening.whiten(df)
    n, sums, e, q, total = expected(good, 7)
    assert (model.n, model.sums) == (n, sums.tolist())
    assert np.allclose(model.variances, e, rtol=1e-12) and np.allclose(model.total, total, rtol=1e-12) and model.identity_error < 1e-12
    assert np.allclose(np.abs((model.components * q).sum(axis=1)), 1, atol=1e-13)
    found = out.collect()
    assert len(found) == 540 and sorted(r.row.vec_id for r in found if r.row.vec_id is not None) == sorted(i for i in ids[:540] if i is not None)
    for r in found:
        x = np.floor(256 * np.array(r.row.embedding, dtype=np.float32).astype(float)).astype(np.int64)
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
        assert np.allclose(r.whitened, (x - sums / n) @ model.components.T / np.sqrt(e), atol=1e-10)
        assert r.row.x == 2 and r.row.whitened == 0.5


@pytest.mark.parametrize("case", ["one", "line", "plane", "cross", "equal"])
def test_few_or_equal_variances(spark, case):
    """Rank below the components asked for, and variances that repeat, where the Krylov space closes early."""
    rnd = random.Random(4)
    unit = lambda i, s: [s if j == i else 0.0 for j in range(6)]
    vectors = {
        "one": [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 9,
        "line": [[float(k)] * 6 for k in range(20)],
        "plane": [[float(a), float(b), float(a + b), 0.0, 1.0, 2.0] for a in range(5) for b in range(7)],
        "cross": [unit(i, s) for i in range(6) for s in (1.0, -1.0)],
        "equal": [unit(i, s * (3.0 if i < 3 else 1.0)) for i in range(6) for s in (1.0, -1.0)] * 2,
    }[case]
    rnd.shuffle(vectors)
    out, model = whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA))
    n, _, e, _, _ = expected(vectors, 6)
    e = e[e > 1e-12 * max(e[0], 1)]
    assert model.n == n and np.allclose(model.variances, e, rtol=1e-10) and model.identity_error < 1e-9
    assert all(len(r.whitened) == len(e) for r in out.collect())


def test_large_entries_stay_exact(spark):
    vectors = [[float(2**40 + k * 2**20), float(-k), 0.0] for k in range(4)]
    out, model = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    assert model.sums == [sum(c) for c in zip(*x)]
    for r in out.collect():
        want = sum((4 * a - s) ** 2 for a, s in zip(x[r.row.vec_id], model.sums))
        assert r.deviation == (want if want < 1 << 63 else None)


def test_any_number_of_partitions_gives_the_same(spark):
    rnd = np.random.default_rng(5)
    df = spark.createDataFrame(rows_of([list(map(float, rnd.standard_normal(5))) for _ in range(200)]), SCHEMA)
    a, b = (whitening.whiten(df.repartition(k))[1] for k in (1, 9))
    assert np.allclose(a.components, b.components, atol=1e-12) and np.allclose(a.variances, b.variances, rtol=1e-12)


def test_nothing(spark):
    for rows in ([], rows_of([None, []])):
        out, model = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == [] and model.n == 0


def test_query_of_the_tables(spark):
    d = "/root/testdata/sf0.001"
    found = whitening.op11_embedding_whitening(spark, d).toPandas()
    n, sums, e, q, total = expected(spark.read.parquet(f"{d}/embeddings.parquet").toPandas().embedding.tolist(), 64)
    assert list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(found) == 2000 and set(found.n) == {n} and found.identity_error.max() < 1e-10
    assert np.allclose(found.groupby("component").explained.first(), e / total, rtol=1e-10)

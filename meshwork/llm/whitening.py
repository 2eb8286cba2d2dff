"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Each step is two passes over the rows: X v, orthogonalised against all left vectors before it, and X^T u, orthogonalised on
the driver against all right vectors before it. A left vector has an entry for each row, so it never leaves the tasks: all
are images of the row space, u_j = X w_j, and the driver sends the short w_j with each pass. No pass depends on what an
executor held before, and none shuffles more than a few sums. The SVD of the small bidiagonal matrix gives the components
and the deviations along them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Entries are floor(SCALE * c); components that are asked for; bytes of doubles of a block of rows.
SCALE, COMPONENTS, BLOCK_BYTES = 256, 4, 4 << 20
#: Lengths below this share of the largest one count as nothing; a component has converged at this residual.
NOTHING, CONVERGED = 1e-12, 1e-15
LONG = 1 << 63


@dataclass
class Whitening:
    """What a fit finds: n different vectors, their sums, unit components (rows) with variances, the total variance, and how
    far the whitened vectors' covariance is from the identity."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    variances: np.ndarray = field(default_factory=lambda: np.zeros(0))
    total: float = 0.0
    identity_error: float = 0.0
    steps: int = 0

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry as long; null for a vector that is null, empty, or has an entry that is null, not
    finite, or beyond a long."""
    scaled = F.transform(vector, lambda c: F.lit(scale) * c.cast("double"))
    fits = F.coalesce(F.forall(scaled, lambda c: F.coalesce(F.abs(c) < F.lit(float(LONG)), F.lit(False)) & ~F.isnan(c)), F.lit(False))
    return F.when(fits & (F.size(vector) > 0), F.transform(scaled, lambda c: F.floor(c).cast("long")))


def usable(rows: DataFrame, vector: str, scale: int = SCALE) -> tuple[DataFrame, int]:
    """rows with `x` (whole entries), without those that have none, and the dimension: the commonest length, the longer one
    in a tie. Vectors of another length lack entries, or have some too many, and go as well."""
    x = rows.withColumn("x", whole(F.col(vector), scale)).filter("x IS NOT NULL")
    found = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    d = found["d"] if found else 0
    return x.filter(F.size("x") == d), d


def blocks(vectors: DataFrame, d: int) -> DataFrame:
    """The different vectors as matrices of some BLOCK_BYTES of doubles: n, payload; a table in the shared folder. Copies
    meet in partial sums before the shuffle."""

    def pack(batches):
        import pyarrow as pa

        most = max(1, BLOCK_BYTES // (8 * d))
        kind = pa.schema([("n", pa.int64()), ("payload", pa.binary())])

        def packed(parts):
            m = np.concatenate(parts)
            return pa.RecordBatch.from_pydict({"n": [len(m)], "payload": [m.tobytes()]}, schema=kind)

        held, rows = [], 0
        for b in batches:
            m = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
            for at in range(0, len(m), most):
                held.append(m[at : at + most])
                rows += len(held[-1])
                if rows >= most:
                    yield packed(held)
                    held, rows = [], 0
        if held:
            yield packed(held)

    return common.written(vectors.select("x").distinct().mapInArrow(pack, "n long, payload binary"), "whitening_blocks")


def over_blocks(table: DataFrame, d: int, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of the short vectors that of_block makes of each; tasks add up their own first."""

    def add(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            for payload in b.column("payload"):
                own = of_block(np.frombuffer(payload.as_buffer(), dtype=np.int64).reshape(-1, d))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "value": pa.array(total, pa.float64())})

    rows = table.select("payload").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["at"]] = r["value"]
    return out


def exact_sums(table: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of each dimension, as whole numbers of any size that 38 digits hold."""

    def add(batches):
        import decimal

        import pyarrow as pa

        total = [0] * (d + 1)
        for b in batches:
            for payload in b.column("payload"):
                m = np.frombuffer(payload.as_buffer(), dtype=np.int64).reshape(-1, d)
                small = len(m) * max(abs(int(m.max())), abs(int(m.min()))) < LONG
                own = m.sum(axis=0).tolist() if small else m.astype(object).sum(axis=0).tolist()
                total = [a + int(b) for a, b in zip(total, [len(m), *own])]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(d + 1), pa.int32()), "value": pa.array([decimal.Decimal(t) for t in total], pa.decimal128(38, 0))})

    rows = table.select("payload").mapInArrow(add, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()
    found = {r["at"]: int(r["value"]) for r in rows}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(d)]


def bidiagonalise(table: DataFrame, d: int, n: int, means: np.ndarray, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """Right singular vectors (rows) and singular values of the centred rows, the largest first, and the steps taken.

    Stops when `wanted` triplets have converged, or when the row space is used up. Where the Krylov space closes before
    that (repeated or missing singular values), a new direction orthogonal to all before it goes on."""
    rnd = np.random.default_rng(seed)
    v_all, w_all, alphas, betas = np.zeros((0, d)), np.zeros((0, d)), [], []
    largest, closed = 0.0, False

    def clean(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - v_all.T @ (v_all @ v)
        return v

    def fresh() -> np.ndarray:
        v = clean(rnd.standard_normal(d))
        return v / np.linalg.norm(v)

    v, beta, restarted = fresh(), 0.0, True
    while True:
        direction = v - beta * w_all[-1] if len(w_all) and not restarted else v
        if len(w_all):  # X v against all left vectors; the recurrence has taken off nearly all, what rounding left goes here

            def across(m: np.ndarray, w=direction, before=w_all) -> np.ndarray:
                x = m - means
                return (x @ before.T).T @ (x @ w)

            direction = direction - w_all.T @ over_blocks(table, d, across)

        def back(m: np.ndarray, w=direction) -> np.ndarray:
            x = m - means
            u = x @ w
            return np.append(x.T @ u, u @ u)

        sums = over_blocks(table, d, back)
        alpha = float(np.sqrt(sums[-1]))
        largest = max(largest, alpha)
        v_all = np.vstack([v_all, v])
        if alpha <= NOTHING * max(largest, np.sqrt(n) * max(1.0, float(np.abs(means).max())) * 1e-3):
            # nothing is left along v: a new direction that gives nothing has met all there is
            alphas.append(0.0)
            w_all = np.vstack([w_all, np.zeros(d)])
            if restarted or len(v_all) >= d:
                break
            betas.append(0.0)
            v, beta, restarted, closed = fresh(), 0.0, True, True
            continue
        alphas.append(alpha)
        w_all = np.vstack([w_all, direction / alpha])
        if len(v_all) >= d:
            break
        rest = clean(sums[:-1] / alpha - alpha * v)
        beta = float(np.linalg.norm(rest))
        largest = max(largest, beta)
        left, s, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        if not closed and len(s) >= wanted and np.all(beta * np.abs(left[-1, :wanted]) <= CONVERGED * s[0]):
            break
        if beta <= NOTHING * largest:
            betas.append(0.0)
            v, beta, restarted, closed = fresh(), 0.0, True, True
        else:
            betas.append(beta)
            v, restarted = rest / beta, False
    b = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)
    _, s, right = np.linalg.svd(b)
    return right @ v_all, s, len(alphas)


def fit(vectors: DataFrame, d: int, wanted: int = COMPONENTS) -> Whitening:
    """The whitening of the different vectors x (arrays of d longs) among the rows."""
    if not d:
        return Whitening()
    table = blocks(vectors, d)
    n, sums = exact_sums(table, d)
    if not n:
        return Whitening()
    means = np.array([s / n for s in sums])
    total = float(over_blocks(table, d, lambda m: np.array([((m - means) ** 2).sum()]))[0]) / n
    found, s, steps = bidiagonalise(table, d, n, means, wanted)
    real = [i for i in range(min(wanted, len(s))) if s[i] > 1e-10 * s[0] and s[i] > 0]
    components = found[real]
    components = components * np.sign(components[np.arange(len(real)), np.abs(components).argmax(axis=1)])[:, None] if real else components
    model = Whitening(n, sums, components, s[real] ** 2 / n, total, 0.0, steps)
    if real:
        k, map_ = len(real), (components / np.sqrt(model.variances)[:, None]).T
        middle = over_blocks(table, d, lambda m: ((m - means) @ map_).sum(axis=0)) / n
        cov = over_blocks(table, d, lambda m: ((y := (m - means) @ map_ - middle).T @ y).ravel()).reshape(k, k) / n
        model.identity_error = float(np.abs(cov - np.eye(k)).max())
    return model


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows (with x) with `whitened` (an array of doubles, one for each component) and `deviation` (the exact sum of
    (n x - S)^2; null where a long can't hold it)."""
    n, sums, means = model.n, model.sums, model.means
    map_ = (model.components / np.sqrt(model.variances)[:, None]).T if len(model.variances) else np.zeros((len(sums), 0))
    names = [c for c in rows.columns if c != "x"]

    def apply(batches):
        import pyarrow as pa

        d, k = len(sums), map_.shape[1]
        most = max(1, BLOCK_BYTES // (8 * max(1, d)))
        s = np.array(sums, dtype=object)
        for whole_ in batches:
            for at in range(0, whole_.num_rows, most):
                b = whole_.slice(at, most)
                m = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
                bound = n * max(abs(int(m.max())), abs(int(m.min()))) + max(map(abs, sums))
                if d * bound * bound < LONG:
                    deviation = ((n * m - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [x if x < LONG else None for x in ((n * m.astype(object) - s) ** 2).sum(axis=1).tolist()]
                y = (m - means) @ map_
                offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * k)
                out = {c: b.column(c) for c in names}
                out |= {"whitened": pa.ListArray.from_arrays(offsets, pa.array(y.ravel(), pa.float64())), "deviation": pa.array(deviation, pa.int64())}
                yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x"), "whitened array<double>", "deviation long"])
    return rows.mapInArrow(apply, schema)


def whiten(rows: DataFrame, vector: str = "embedding", wanted: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, Whitening]:
    """row (all columns of rows as a struct), whitened, deviation for each row whose vector can be used; and the model.

    Dropped: null, empty and non-finite vectors, entries beyond a long after scaling, and lengths other than the commonest.
    Each different vector counts once in the fit, however many rows have it; rows themselves are all kept, repeated ones
    too. Fewer components come back where fewer have a variance (none for a single vector); an empty table gives no rows.
    Extra columns of any name come back in row."""
    boxed = rows.select(F.struct("*").alias("row"), F.col(vector).alias("vector"))
    ready, d = usable(boxed, "vector", scale)
    ready = ready.select("row", "x")
    model = fit(ready, d, wanted)
    return transform(ready, model), model


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable row of embeddings and each of up to four components. Null vec_ids and repeated rows stay."""
    table = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows, model = whiten(table)
    share = F.array(*(F.lit(float(v / model.total)) for v in model.variances)) if len(model.variances) else F.array().cast("array<double>")
    each = rows.select("row.vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )

"""Sparse algebra on relations: matrices are (row, col, val), vectors (idx, val); every operator is a DataFrame plan.

Vectors are joined on their index, without hints: Spark broadcasts a side that its statistics show to be small and
shuffles both otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_coo(entries: DataFrame, nrows: int | None = None, ncols: int | None = None) -> DataFrame:
    """One entry for each (row, col): values of repeated ones are summed. Entries outside the bounds raise an error."""
    if nrows is not None and ncols is not None:
        inside = F.col("row").between(0, nrows - 1) & F.col("col").between(0, ncols - 1)
        entries = entries.withColumn("val", F.when(inside, F.col("val")).otherwise(F.raise_error(F.lit("entry outside the matrix")).cast("double")))
    return entries.groupBy("row", "col").agg(F.sum("val").alias("val"))


def nnz(a: DataFrame) -> DataFrame:
    return a.agg(F.count(F.lit(1)).alias("nnz"))


def drop_zeros(a: DataFrame) -> DataFrame:
    return a.filter(F.col("val") != 0)


def lower(a: DataFrame) -> DataFrame:
    return a.filter(F.col("row") >= F.col("col"))


def upper(a: DataFrame) -> DataFrame:
    return a.filter(F.col("row") <= F.col("col"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


#: Entries that one task groups by pair, or joins.
ENTRIES_A_TASK = 250_000
#: Rows of a numbering that Spark may broadcast; with more, entries are dealt out.
SHORT = 500_000


def _tasks(a: DataFrame) -> int:
    """As many tasks as the entries need, those of the session at least."""
    return max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), a.count() // ENTRIES_A_TASK)


def symmetry(a: DataFrame, tolerance: float = 1e-14) -> DataFrame:
    """One row: symmetric, and the largest difference to the mirror (a missing one counts as zero) over the largest value. There are
    as many tasks as the entries need, so that a task's memory does not grow with them."""
    tasks = _tasks(a)
    above, below = F.when(F.col("row") < F.col("col"), F.col("val")), F.when(F.col("row") > F.col("col"), F.col("val"))
    ends = a.select("row", "col", "val", F.least("row", "col").alias("i"), F.greatest("row", "col").alias("j")).repartition(tasks, "i", "j")
    pairs = ends.groupBy("i", "j").agg(F.abs(F.coalesce(F.sum(above), F.lit(0.0)) - F.coalesce(F.sum(below), F.lit(0.0))).alias("gap"), F.max(F.abs("val")).alias("size"))
    found = pairs.agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"), F.coalesce(F.max("size"), F.lit(0.0)).alias("size"))
    return found.select((F.col("gap") <= tolerance * F.col("size")).alias("symmetric"), F.coalesce(F.try_divide("gap", "size"), F.lit(0.0)).alias("relative_gap"))


def permute(a: DataFrame, numbering: DataFrame) -> DataFrame:
    """P A P^T for numbering (old_idx, new_idx). Entries that are more than the session's tasks should join are dealt to as many as
    they need, so that a task's memory does not grow with them; not with a short numbering, which joins without a shuffle."""
    tasks = _tasks(a)
    many = tasks > int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")) and numbering.count() > SHORT
    dealt = lambda df, c: df.repartition(tasks, c) if many else df
    rows = numbering.select(F.col("old_idx").alias("row"), F.col("new_idx").alias("new_row"))
    cols = numbering.select(F.col("old_idx").alias("col"), F.col("new_idx").alias("new_col"))
    met = dealt(a.select("row", "col", "val"), "row").join(rows, "row")
    return dealt(met, "col").join(cols, "col").select(F.col("new_row").alias("row"), F.col("new_col").alias("col"), "val")


def permute_vector(x: DataFrame, numbering: DataFrame) -> DataFrame:
    return x.join(numbering, F.col("idx") == F.col("old_idx")).select(F.col("new_idx").alias("idx"), "val")


def original_order(x: DataFrame, numbering: DataFrame) -> DataFrame:
    return x.join(numbering, F.col("idx") == F.col("new_idx")).select(F.col("old_idx").alias("idx"), "val")


def row_range(a: DataFrame, start: int, end: int) -> DataFrame:
    return a.filter((F.col("row") >= start) & (F.col("row") < end))


def add_diagonal(a: DataFrame, diagonal: DataFrame) -> DataFrame:
    """A + diag(d) for d (idx, val); a missing diagonal entry is inserted. Entries off A's diagonal, each there once, pass as they
    are: only diagonals are shuffled."""
    on = F.col("row").eqNullSafe(F.col("col"))
    d = diagonal.select(F.col("idx").alias("row"), F.col("idx").alias("col"), "val")
    return a.filter(~on).select("row", "col", "val").unionByName(from_coo(a.filter(on).select("row", "col", "val").unionByName(d)))


def fingerprint(a: DataFrame) -> DataFrame:
    """One row (entries, pattern) that is equal for equal sparsity patterns, whatever the order and the values."""
    return a.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.bit_xor(F.xxhash64("row", "col")), F.lit(0).cast("long")).alias("pattern"))


def pattern_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """row, col, side: entries that only the first (a) or only the second (b) has."""
    p, q = a.select("row", "col"), b.select("row", "col")
    return p.exceptAll(q).withColumn("side", F.lit("a")).unionByName(q.exceptAll(p).withColumn("side", F.lit("b")))


def replace_values(pattern: DataFrame, new: DataFrame) -> DataFrame:
    """The pattern's entries with new's values. An entry of one without the other raises an error."""
    both = pattern.select("row", "col", F.lit(True).alias("old")).join(new.select("row", "col", "val", F.lit(True).alias("new")), ["row", "col"], "full_outer")
    known = F.col("old").isNotNull() & F.col("new").isNotNull()
    return both.select("row", "col", F.when(known, F.col("val")).otherwise(F.raise_error(F.lit("the sparsity pattern has changed")).cast("double")).alias("val"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (changed, entries): whether and in how many entries the values differ; nulls equal nulls."""
    both = old.select("row", "col", F.col("val").alias("old")).join(new.select("row", "col", F.col("val").alias("new")), ["row", "col"], "full_outer")
    n = F.coalesce(F.sum((~F.col("old").eqNullSafe(F.col("new"))).cast("long")), F.lit(0).cast("long"))
    return both.agg(n.alias("entries")).select((F.col("entries") > 0).alias("changed"), "entries")


def norm_estimate(a: DataFrame) -> DataFrame:
    """One row: the square root of the largest column sum times the largest row sum of absolute values."""
    by_row = a.groupBy("row").agg(F.sum(F.abs("val")).alias("s")).agg(F.max("s").alias("r"))
    by_col = a.groupBy("col").agg(F.sum(F.abs("val")).alias("s")).agg(F.max("s").alias("c"))
    return by_row.crossJoin(by_col).select(F.sqrt(F.col("r") * F.col("c")).alias("norm"))  # one row each


def blocks_of(x: DataFrame, size: int) -> DataFrame:
    """The cells of the unknowns: idx div size, each once."""
    return x.select(F.floor(F.col("idx") / size).alias("cell")).distinct()


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x; rows whose entries meet no x are absent."""
    return a.join(x.select(F.col("idx").alias("col"), F.col("val").alias("x")), "col").groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("val")).withColumnRenamed("row", "idx")


def row_arrays(a: DataFrame) -> DataFrame:
    """row, cols, vals: each row's entries as two arrays, sorted by column. One row of a matrix must fit into a task."""
    entries = a.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("e"))
    return entries.select("row", F.col("e.col").alias("cols"), F.col("e.val").alias("vals"))


def row_spmv(rows: DataFrame, x: DataFrame) -> DataFrame:
    """A x over rows as arrays: the entries meet x by column and come back to their rows."""
    entries = rows.select("row", F.explode(F.arrays_zip(F.col("cols").alias("col"), F.col("vals").alias("val"))).alias("e")).select("row", "e.col", "e.val")
    return spmv(entries, x)


def triple_product(w: DataFrame, a: DataFrame) -> DataFrame:
    """W^T A W for W (idx, coarse_col, val), A W first."""
    right = w.select(F.col("idx").alias("col"), F.col("coarse_col").alias("c"), F.col("val").alias("w"))
    aw = a.join(right, "col").groupBy("row", "c").agg(F.sum(F.col("val") * F.col("w")).alias("aw"))
    left = w.select(F.col("idx").alias("row"), F.col("coarse_col").alias("r"), F.col("val").alias("w"))
    return aw.join(left, "row").groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum(F.col("w") * F.col("aw")).alias("val"))


def combine(x: DataFrame, y: DataFrame, alpha, beta) -> DataFrame:
    """alpha x + beta y over the indices of both."""
    both = x.select("idx", F.col("val").alias("x")).join(y.select("idx", F.col("val").alias("y")), "idx", "full_outer")
    return both.select("idx", (F.lit(alpha) * F.coalesce("x", F.lit(0.0)) + F.lit(beta) * F.coalesce("y", F.lit(0.0))).alias("val"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("idx", F.col("val").alias("y")), "idx").agg(F.coalesce(F.sum(F.col("val") * F.col("y")), F.lit(0.0)).alias("dot"))


def multi_dot(basis: DataFrame, w: DataFrame) -> DataFrame:
    """j, dot: one product for each column of basis (idx, j, val), all in one reduction."""
    return basis.join(w.select("idx", F.col("val").alias("w")), "idx").groupBy("j").agg(F.sum(F.col("val") * F.col("w")).alias("dot"))


def norms(x: DataFrame) -> DataFrame:
    """One row: the sum, the 1-, 2- and maximum norm, and the count, in one pass."""
    zero = F.lit(0.0)
    return x.agg(F.coalesce(F.sum("val"), zero).alias("total"), F.coalesce(F.sum(F.abs("val")), zero).alias("norm1"), F.sqrt(F.coalesce(F.sum(F.col("val") * F.col("val")), zero)).alias("norm2"), F.coalesce(F.max(F.abs("val")), zero).alias("norm_max"), F.count(F.lit(1)).alias("n"))


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    return combine(b, spmv(a, x), 1.0, -1.0)


def normalisation_factor(a: DataFrame, b: DataFrame, x0: DataFrame) -> DataFrame:
    """One row: sum |A x0 - m A 1| + sum |b - m A 1| + 1e-20, m being the mean of x0."""
    ones = a.groupBy(F.col("row").alias("idx")).agg(F.sum("val").alias("a1"))
    rows = ones.join(spmv(a, x0).withColumnRenamed("val", "ax"), "idx", "left").join(b.withColumnRenamed("val", "b"), "idx", "left")
    mean = x0.agg(F.avg("val").alias("m"))  # one row
    own = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    gap = F.abs(own("ax") - F.col("m") * F.col("a1")) + F.abs(own("b") - F.col("m") * F.col("a1"))
    return rows.crossJoin(mean).agg((F.coalesce(F.sum(gap), F.lit(0.0)) + 1e-20).alias("factor"))


def backward_error(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest residual over |A| |x| + |b| in the maximum norm."""
    top = lambda df, name: df.agg(F.coalesce(F.max(F.abs("val")), F.lit(0.0)).alias(name))
    size = a.groupBy("row").agg(F.sum(F.abs("val")).alias("val"))
    all_ = top(residual(a, x, b), "r").crossJoin(top(size, "a")).crossJoin(top(x, "x")).crossJoin(top(b, "b"))  # one row each
    return all_.select(F.coalesce(F.try_divide(F.col("r"), F.col("a") * F.col("x") + F.col("b")), F.lit(0.0)).alias("backward_error"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: entries only in a, only in b, shared ones, and the largest difference over the largest value."""
    both = a.select("row", "col", F.col("val").alias("a")).join(b.select("row", "col", F.col("val").alias("b")), ["row", "col"], "full_outer")
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))
    gap, size = F.max(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))), F.max(F.greatest(F.abs(F.coalesce("a", F.lit(0.0))), F.abs(F.coalesce("b", F.lit(0.0)))))
    return both.agg(n(F.col("b").isNull()).alias("only_a"), n(F.col("a").isNull()).alias("only_b"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.coalesce(F.try_divide(gap, size), F.lit(0.0)).alias("relative_gap"))


def lower_median(column: str) -> Column:
    """Aggregate: the element at floor((n - 1) / 2) of the sorted values of the named column."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})")

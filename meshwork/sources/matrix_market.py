"""Matrix Market text: coordinate matrices and vectors, read and written by Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import algebra, scan
from . import seeded
from .seeded import SEED


#: A line's place: its file's name, the start of the split, and its number there. Spark deals files to tasks by size, so that
#: the number alone does not follow the files' order.
PLACE = ["_file", "_from", "at"]


def _lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, list[int]]:
    """The banner's words, the data lines (with their place, for arrays) and the size line's numbers."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("at"))
    is_data = ~F.col("value").startswith("%") & (F.trim("value") != "")
    line = F.struct(*PLACE, "value")
    first, size = text.agg(F.min(F.when(F.col("value").startswith("%%"), line)), F.min(F.when(is_data, line))).first()
    banner = first.value.lower().split() if first else []
    if len(banner) < 5 or banner[:2] != ["%%matrixmarket", "matrix"]:
        raise ValueError(f"{path} has no Matrix Market banner")
    if banner[3] not in ("real", "integer", "pattern", "double") or banner[4] not in ("general", "symmetric", "skew-symmetric"):
        raise ValueError(f"{path}: {' '.join(banner[3:])} matrices are not supported")
    if not size:
        raise ValueError(f"{path} has no line of sizes")
    rest = (F.col("_file") != size["_file"]) | (F.col("_from") != size["_from"]) | (F.col("at") != size["at"])
    return banner, text.filter(is_data & rest), [int(x) for x in size.value.split()]


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(row, col, val) from 0, and the sizes. Patterns are ones, symmetric and skew ones mirrored, explicit zeros dropped, repeats summed."""
    banner, data, size = _lines(spark, path)
    if banner[2] != "coordinate":
        raise ValueError(f"{path} is not a coordinate matrix")
    t = F.split(F.trim("value"), r"\s+")
    val = F.lit(1.0) if banner[3] == "pattern" else F.get(t, F.lit(2)).cast("double")
    entries = data.select((F.get(t, F.lit(0)).cast("long") - 1).alias("row"), (F.get(t, F.lit(1)).cast("long") - 1).alias("col"), val.alias("val")).filter("val <> 0")
    if banner[4] != "general":
        sign = -1.0 if banner[4].startswith("skew") else 1.0
        entries = entries.unionByName(entries.filter("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * sign).alias("val")))
    return entries.groupBy("row", "col").agg(F.sum("val").alias("val")), size[0], size[1]


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(idx, val): an n x 1 array in its order, or a one-column coordinate matrix, absent entries as zero."""
    banner, data, size = _lines(spark, path)
    if banner[2] == "array":
        return scan.placed(data, *PLACE, name="idx").select("idx", F.trim("value").cast("double").alias("val"))
    entries, n, _ = read_matrix(spark, path)
    return spark.range(n).select(F.col("id").alias("idx")).join(entries.select(F.col("row").alias("idx"), "val"), "idx", "left").select("idx", F.coalesce("val", F.lit(0.0)).alias("val"))


def write_matrix(a: DataFrame, nrows: int, ncols: int, path: str) -> None:
    """A folder of text parts whose concatenation in name order is one general coordinate file, sorted by column in rows, values with 17 digits."""
    head = a.sparkSession.createDataFrame([(-2, -1, "%%MatrixMarket matrix coordinate real general"), (-1, -1, f"{nrows} {ncols} {a.count()}")], "row long, col long, value string")
    body = a.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.format_string("%d %d %.17g", F.col("row") + 1, F.col("col") + 1, F.col("val")).alias("value"))
    head.unionByName(body).orderBy("row", "col").select("value").write.text(path)


def write_vector(x: DataFrame, path: str) -> None:
    n = x.count()
    head = x.sparkSession.createDataFrame([(-2, "%%MatrixMarket matrix array real general"), (-1, f"{n} 1")], "idx long, value string")
    head.unionByName(x.select(F.col("idx").cast("long").alias("idx"), F.format_string("%.17g", "val").alias("value"))).orderBy("idx").select("value").write.text(path)


@dataclass
class Problem:
    """A system of n unknowns, in blocks of a size."""

    matrix: DataFrame
    rhs: DataFrame
    n: int
    block: int
    symmetric: bool


def write_problem(a: DataFrame, b: DataFrame, folder: str) -> None:
    """A generated system as two files in a folder, `matrix` and `rhs` (unknowns without a value are zeros)."""
    n = (a.agg(F.max(F.greatest("row", "col"))).first()[0] or 0) + 1
    write_matrix(a, n, n, f"{folder}/matrix")
    every = a.sparkSession.range(n).select(F.col("id").alias("idx"))
    write_vector(every.join(b, "idx", "left").select("idx", F.coalesce("val", F.lit(0.0)).alias("val")), f"{folder}/rhs")


def load_problem(spark: SparkSession, matrix: str, rhs: str = "ones", step: int = 0, block: int = 1, seed: int = SEED) -> Problem:
    """The system of a step, from files whose names may have a pattern of it; `ones` is a right-hand side of ones, `random` one
    of the seed's values in [-1, 1), which no partitioning changes. Matrices that are not square, sizes that are no multiple of the block's, and right-hand sides of another size raise an error."""
    a, rows, cols = read_matrix(spark, step_file(matrix, step))
    if rows != cols:
        raise ValueError(f"{matrix} is not square: {rows} x {cols}")
    if block < 1 or rows % block:
        raise ValueError(f"{rows} unknowns are no multiple of a block of {block}")
    if rhs == "ones":
        b = spark.range(rows).select(F.col("id").alias("idx"), F.lit(1.0).alias("val"))
    elif rhs == "random":
        b = seeded.random_vector(spark, rows, seed)
    else:
        b = read_vector(spark, step_file(rhs, step))
        if (given := b.count()) != rows:
            raise ValueError(f"{rhs} has {given} values for {rows} unknowns")
    return Problem(a, b, rows, block, bool(algebra.symmetry(a).first()["symmetric"]))


def step_file(pattern: str, step: int) -> str:
    """The file of a step: one %d, %4d or %04d in the pattern, or the same file for every step."""
    found = re.findall(r"%(?!%)[^%]*?[a-zA-Z]", pattern)
    if not found:
        return pattern
    if len(found) > 1 or not re.fullmatch(r"%0?\d*d", found[0]):
        raise ValueError(f"{pattern!r} must have exactly one integer conversion")
    return pattern % step

"""Partitions, overlapping subdomains and partitions of unity, as keyed relations.

partition: (idx, part); numbering: (old_idx, new_idx, part); membership: (part, idx, is_owned, local_idx, pou)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def linear_partition(x: DataFrame, n: int, parts: int) -> DataFrame:
    """part = floor(idx * parts / n)."""
    return x.select("idx", F.floor(F.col("idx") * parts / n).cast("int").alias("part"))


def range_partition(x: DataFrame, rows: int) -> DataFrame:
    """Parts of some `rows` consecutive indices each, two at least; one row of bounds reaches the driver."""
    at = x.agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).first()
    lo, n = at.lo or 0, (at.hi or 0) - (at.lo or 0) + 1
    return x.select("idx", F.floor((F.col("idx") - lo) * max(2, n // rows) / n).cast("int").alias("part"))


def ordered_partition(x: DataFrame, parts: int) -> DataFrame:
    """Stretches of nearly equal size along the order of x's other columns, then of idx: place * parts / n."""
    keys = [F.asc(c) for c in x.columns if c != "idx"]
    placed = scan.placed(x, *keys, "idx")
    return placed.select("idx", F.floor(F.col("place") * parts / F.lit(placed.count())).cast("int").alias("part"))


def grid_partition(x: DataFrame, nx: int, ny: int, px: int, py: int) -> DataFrame:
    """Blocks of a grid whose cells are numbered i + nx (j + ny k)."""
    i, j = F.col("idx") % nx, F.floor(F.col("idx") / nx) % ny
    return x.select("idx", (F.floor(i * px / nx) + px * F.floor(j * py / ny)).cast("int").alias("part"))


def edges(a: DataFrame) -> DataFrame:
    """The graph of A + A^T: src, dst, both ways, each once, without loops. Each pair is shuffled one way and mirrored then."""
    pairs = a.filter("row <> col").select(F.least("row", "col").alias("i"), F.greatest("row", "col").alias("j")).distinct()
    way = lambda s, d: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"))
    return pairs.select(F.explode(F.array(way("i", "j"), way("j", "i"))).alias("e")).select("e.src", "e.dst")


def level_partition(a: DataFrame, x: DataFrame, parts: int, name: str = "levels") -> DataFrame:
    """Parts of nearly equal size along breadth-first levels from the smallest index: for graphs without a geometry.

    One round for each level, each written to the shared folder, over the graph, which is written once. Unreached unknowns come
    last, by index."""
    from ..plans.store import written

    graph = written(edges(a), "graph")
    start = x.agg(F.min("idx").alias("idx")).select("idx", F.lit(0).alias("level"))
    seen = written(start, name)
    front, level = seen, 0
    while True:
        level += 1
        new = front.select(F.col("idx").alias("src")).join(graph, "src").select(F.col("dst").alias("idx")).distinct().join(seen, "idx", "left_anti").withColumn("level", F.lit(level))
        front = written(new, name)
        if front.isEmpty():
            break
        seen = seen.union(front)
    ranked = x.select("idx").join(seen, "idx", "left").withColumn("level", F.coalesce("level", F.lit(level)))
    return scan.placed(ranked, "level", "idx").select("idx", F.floor(F.col("place") * parts / F.lit(x.count())).cast("int").alias("part"))


def offsets(partition: DataFrame) -> DataFrame:
    """part, n, first: sizes and exclusive sums of the parts (one row for each part). An empty part raises an error."""
    sizes = partition.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    at = scan.placed(sizes, "part", weight="n", name="first")
    full = sizes.agg((F.coalesce(F.max("part") + 1, F.lit(0)) == F.count(F.lit(1))).alias("full"))  # one row
    n = F.when(F.col("full"), F.col("n")).otherwise(F.raise_error(F.lit("a part is empty")).cast("long"))
    return at.crossJoin(F.broadcast(full)).select("part", n.alias("n"), "first")


def numbering(partition: DataFrame) -> DataFrame:
    """New numbers: part after part, the old order within a part."""
    return scan.placed(partition, "part", "idx", name="new_idx").select(F.col("idx").alias("old_idx"), "new_idx", "part")


def owners(x: DataFrame, bounds: DataFrame) -> DataFrame:
    """The part whose range [first, first + n) has idx, for indices in any of them: as of the last bound at or before idx.
    Bounds and indices are scanned in one order, so that rows neither multiply nor meet, however unequal the parts are."""
    owner = F.struct("part", (F.col("first") + F.col("n")).alias("end"))
    starts = bounds.filter("n > 0").select(F.col("first").cast("long").alias("idx"), F.lit(0).alias("kind"), owner.alias("owner"))
    both = starts.unionByName(x.select(F.col("idx").cast("long").alias("idx"), F.lit(1).alias("kind")), allowMissingColumns=True)
    return scan.last_known(both, "owner", "idx", "kind").filter("kind = 1 AND idx < owner.end").select("idx", "owner.part")


def ghosts(a: DataFrame, partition: DataFrame) -> DataFrame:
    """part, idx, owner: what is one edge of A + A^T away from a part's own unknowns."""
    of = lambda c, p: partition.select(F.col("idx").alias(c), F.col("part").alias(p))
    across = edges(a).join(of("src", "part"), "src").join(of("dst", "owner"), "dst").filter("part <> owner")
    return across.select("part", F.col("dst").alias("idx"), "owner").distinct()


def membership(a: DataFrame, partition: DataFrame, unity: str = "boolean") -> DataFrame:
    """The overlapping subdomains: own unknowns first, then ghosts by owner and index; pou sums to one for each unknown."""
    if unity not in ("boolean", "multiplicity"):
        raise ValueError(f"unknown partition of unity {unity!r}")
    own = partition.select("part", "idx", F.col("part").alias("owner"), F.lit(True).alias("is_owned"))
    all_ = own.unionByName(ghosts(a, partition).withColumn("is_owned", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("is_owned"), "owner", "idx")) - 1
    pou = F.col("is_owned").cast("double") if unity == "boolean" else 1.0 / F.count(F.lit(1)).over(Window.partitionBy("idx"))
    return all_.select("part", "idx", "owner", "is_owned", place.alias("local_idx"), pou.alias("pou"))


def ghost_blocks(members: DataFrame) -> DataFrame:
    """part, neighbour, start, n: where each neighbour's ghosts lie; they are contiguous."""
    return members.filter("NOT is_owned").groupBy("part", F.col("owner").alias("neighbour")).agg(F.min("local_idx").alias("start"), F.count(F.lit(1)).alias("n"))


def local_matrices(a: DataFrame, members: DataFrame) -> DataFrame:
    """R_i A R_i^T of all parts: part, lrow, lcol, row, col, val."""
    rows = members.select("part", F.col("idx").alias("row"), F.col("local_idx").alias("lrow"))
    cols = members.select("part", F.col("idx").alias("col"), F.col("local_idx").alias("lcol"))
    return a.join(rows, "row").join(cols, ["part", "col"]).select("part", "lrow", "lcol", "row", "col", "val")


def lumping(a: DataFrame, members: DataFrame) -> DataFrame:
    """part, idx, s: for each ghost row the sum of |a| over the columns outside the subdomain (zero if there is none)."""
    rows = members.filter("NOT is_owned").select("part", F.col("idx").alias("row"))
    inside = members.select("part", F.col("idx").alias("col"))
    out = a.join(rows, "row").join(inside, ["part", "col"], "left_anti").groupBy("part", "row").agg(F.sum(F.abs("val")).alias("s"))
    return rows.join(out, ["part", "row"], "left").select("part", F.col("row").alias("idx"), F.coalesce("s", F.lit(0.0)).alias("s"))


def lumped_matrices(a: DataFrame, members: DataFrame) -> DataFrame:
    """The local matrices with s taken off the ghosts' diagonal (inserted where it is missing): part, row, col, val. One
    join of the rows with the columns gives both: what stays outside goes to the diagonal with its absolute value."""
    rows = members.select("part", F.col("idx").alias("row"))
    inside = members.select("part", F.col("idx").alias("col"), F.lit(True).alias("inside"))
    met = a.join(rows, "row").join(inside, ["part", "col"], "left")
    here = F.coalesce("inside", F.lit(False))
    entries = met.select("part", "row", F.when(here, F.col("col")).otherwise(F.col("row")).alias("col"), F.when(here, F.col("val")).otherwise(-F.abs("val")).alias("val"))
    diagonal = members.filter("NOT is_owned").select("part", F.col("idx").alias("row"), F.col("idx").alias("col"), F.lit(0.0).alias("val"))
    return entries.unionByName(diagonal).groupBy("part", "row", "col").agg(F.sum("val").alias("val"))


def weighted_matrices(a: DataFrame, members: DataFrame) -> DataFrame:
    """D_i A_ii D_i: part, row, col, val."""
    d = lambda c, w: members.select("part", F.col("idx").alias(c), F.col("pou").alias(w))
    return local_matrices(a, members).join(d("row", "dr"), ["part", "row"]).join(d("col", "dc"), ["part", "col"]).select("part", "row", "col", (F.col("dr") * F.col("val") * F.col("dc")).alias("val"))


def restrict(x: DataFrame, members: DataFrame) -> DataFrame:
    """R_i x of all parts: part, idx, val (and what else x has, such as a column number)."""
    return members.select("part", "idx").join(x, "idx")


def extend_add(local: DataFrame) -> DataFrame:
    """The sum over parts of R_i^T x_i."""
    return local.groupBy("idx").agg(F.sum("val").alias("val"))


def sizes(members: DataFrame, entries: DataFrame) -> DataFrame:
    """part, n_own, n_ghost, n_neighbours, nnz of each subdomain; entries has part, nnz."""
    counts = members.groupBy("part").agg(F.sum(F.col("is_owned").cast("long")).alias("n_own"), F.sum((~F.col("is_owned")).cast("long")).alias("n_ghost"), F.count_distinct(F.when(~F.col("is_owned"), F.col("owner"))).alias("n_neighbours"))
    return counts.join(entries, "part")


def edge_cut(a: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: edges of A + A^T between parts, each counted once."""
    of = lambda c, p: partition.select(F.col("idx").alias(c), F.col("part").alias(p))
    return edges(a).filter("src < dst").join(of("src", "p"), "src").join(of("dst", "q"), "dst").agg(F.count(F.when(F.col("p") != F.col("q"), 1)).alias("cut"))

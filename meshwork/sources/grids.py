"""Model problems on structured grids: matrices (row, col, val) and right-hand sides (idx, val) made by Spark from ranges.

Cells are numbered i + nx (j + ny k); unknowns cell * ncomp + component."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("laplace", "convdiff", "coupled", "bubbles")


@dataclass(frozen=True)
class Problem:
    matrix: DataFrame
    rhs: DataFrame
    n: int
    block_size: int
    symmetric: bool
    description: str


@dataclass(frozen=True)
class GridOptions:
    nx: int
    ny: int
    nz: int = 1
    nu: float = 1e-2
    ncomp: int = 2
    pulse: float = 0.0
    pulse_period: int = 10
    time: float = 0.0
    rho_ratio: float = 1000.0
    nbubbles: int = 50
    radius: float = 0.06
    cfl: float = 0.5
    seed: int = 2024
    source: str = "alpha"


def cells(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """cell, i, j, k of every cell."""
    c = F.col("id")
    return spark.range(nx * ny * nz).select(c.alias("cell"), (c % nx).alias("i"), (F.floor(c / nx) % ny).alias("j"), F.floor(c / (nx * ny)).alias("k"))


def _segment(x: Column, y: Column, ax: float, ay: float, bx: float, by: float) -> Column:
    vx, vy = bx - ax, by - ay
    t = F.least(F.greatest(((x - ax) * vx + (y - ay) * vy) / (vx * vx + vy * vy), F.lit(0.0)), F.lit(1.0))
    dx, dy = x - (ax + t * vx), y - (ay + t * vy)
    return F.sqrt(dx * dx + dy * dy)


def kappa(x: Column, y: Column) -> Column:
    """The heterogeneous diffusivity: a region of 2, two channels and a lattice of 0.06, else 1."""
    # The geometry of the model problem.
    lattice = (F.abs(x % 0.2 - 0.1) < 0.035) & (F.abs(y % 0.2 - 0.1) < 0.035)
    low = (_segment(x, y, 0.15, 0.62, 0.75, 0.70) < 0.04) | (_segment(x, y, 0.55, 0.62, 0.90, 0.35) < 0.03) | lattice
    return F.when(x.between(0.10, 0.45) & y.between(0.12, 0.30), 2.0).when(low, 6e-2).otherwise(1.0)


def _parse(name: str) -> tuple[str, int]:
    kind, dim = name[:-2], name[-2:]
    if kind not in KINDS or dim not in ("2d", "3d"):
        raise ValueError(f"unknown generator {name!r}")
    return kind, int(dim[0])


def generate(spark: SparkSession, name: str, o: GridOptions) -> Problem:
    """laplace, convdiff, coupled or bubbles in 2d or 3d. In 2d nz counts as 1."""
    kind, dim = _parse(name)
    if min(o.nx, o.ny, o.nz) < 1:
        raise ValueError("grid sizes must be positive")
    return _bubbles(spark, dim, o) if kind == "bubbles" else _flow(spark, kind, dim, o)


def _flow(spark: SparkSession, kind: str, dim: int, o: GridOptions) -> Problem:
    nx, ny, nz = o.nx, o.ny, o.nz if dim == 3 else 1
    hx, hy, hz = 1.0 / nx, 1.0 / ny, 1.0 / nz if dim == 3 else 1.0
    nc = max(1, o.ncomp) if kind == "coupled" else 1
    moving = kind != "laplace"
    nu = 1.0 if kind == "laplace" else o.nu
    swing = 1.0 + o.pulse * math.sin(2.0 * math.pi * o.time / max(1, o.pulse_period))
    i, j, k = (F.col(c).cast("double") for c in "ijk")
    k_at = lambda di, dj: kappa((i + di + 0.5) * hx, (j + dj + 0.5) * hy) if moving else F.lit(1.0)
    grid = cells(spark, nx, ny, nz).withColumns({"kp": k_at(0, 0), "kx": k_at(1, 0), "ky": k_at(0, 1)})
    kp, kx, ky = F.col("kp"), F.col("kx"), F.col("ky")
    p1 = lambda s: s * s - s
    over = lambda a, h: p1((a + 1) * h) - p1(a * h)
    xf, yf, zf = (i + 1) * hx, (j + 1) * hy, (k + 1) * hz
    flux_x = xf * (1 - xf) * over(j, hy) * (1.0 if dim == 2 else ((k + 1) * hz * (k + 1) * hz - k * hz * k * hz))
    flux_y = -yf * (1 - yf) * over(i, hx) * (1.0 if dim == 2 else hz)
    flux_z = -zf * (1 - zf) * over(i, hx) * over(j, hy)
    harmonic = lambda a, b: 2.0 * a * b / (a + b)
    face = lambda there, step, geom, flux: F.when(there, F.struct((F.col("cell") + step).alias("q"), geom.alias("geom"), (flux * swing if moving else F.lit(0.0)).alias("f")))
    faces = [face(F.col("i") + 1 < nx, 1, harmonic(kp, kx) * (hy * hz) / hx, flux_x), face(F.col("j") + 1 < ny, nx, harmonic(kp, ky) * (hx * hz) / hy, flux_y)]
    if dim == 3:
        faces.append(face(F.col("k") + 1 < nz, nx * ny, kp * (hx * hy) / hz, flux_z))
    inner = grid.select(F.col("cell").alias("p"), F.explode(F.array_compact(F.array(*faces))).alias("face")).select("p", "face.*")
    comps = F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))
    inner = inner.withColumn("c", comps).withColumns({"d": nu * (1.0 + F.col("c")) * F.col("geom"), "p": F.col("p") * nc + F.col("c"), "q": F.col("q") * nc + F.col("c")})
    out, back = F.greatest(F.col("f"), F.lit(0.0)), F.greatest(-F.col("f"), F.lit(0.0))
    entry = lambda r, c, v: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), v.alias("val"))
    d = F.col("d")
    entries = inner.select(F.explode(F.array(entry("p", "p", d + out), entry("p", "q", -d - back), entry("q", "q", d + back), entry("q", "p", -d - out))).alias("e")).select("e.*")
    along, last, area = ("k", nz - 1, hx * hy / (0.5 * hz)) if dim == 3 else ("j", ny - 1, hx / (0.5 * hy))
    at_start, at_end = (1.0, 0.0) if dim == 3 else (0.0, 1.0)
    sides = F.array_compact(F.array(F.when(F.col(along) == 0, F.lit(at_start)), F.when(F.col(along) == last, F.lit(at_end))))
    wall = grid.select("cell", "kp", F.explode(sides).alias("u")).withColumn("c", comps).select((F.col("cell") * nc + F.col("c")).alias("row"), (nu * (1.0 + F.col("c")) * F.col("kp") * area).alias("d"), "u")
    entries = entries.unionByName(wall.select("row", F.col("row").alias("col"), F.col("d").alias("val")))
    if nc > 1:
        gamma = nu * (hy / hx if dim == 2 else hy * hz / hx)
        own = grid.select("cell").withColumn("c", comps).select((F.col("cell") * nc + F.col("c")).alias("row"), (F.col("cell") * nc + (F.col("c") + 1) % nc).alias("next"))
        entries = entries.unionByName(own.select("row", F.col("row").alias("col"), F.lit(gamma).alias("val"))).unionByName(own.select("row", F.col("next").alias("col"), F.lit(-gamma).alias("val")))
    n = nx * ny * nz * nc
    known = wall.groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("d") * F.col("u")).alias("v"))
    rhs = spark.range(n).select(F.col("id").alias("idx")).join(known, "idx", "left").select("idx", F.coalesce("v", F.lit(0.0)).alias("val"))
    matrix = entries.groupBy("row", "col").agg(F.sum("val").alias("val"))
    return Problem(matrix, rhs, n, nc, kind == "laplace", f"{kind}{dim}d {nx}x{ny}" + f"x{nz}" * (dim == 3))


class Mt19937_64:
    """The standard 64-bit Mersenne twister, and doubles in [0, 1) from it."""

    def __init__(self, seed: int):
        # The standard's parameters.
        self.n, self.m, self.a = 312, 156, 0xB5026F5AA96619E9
        self.mask = (1 << 64) - 1
        self.state = [seed & self.mask]
        for i in range(1, self.n):
            before = self.state[-1]
            self.state.append((6364136223846793005 * (before ^ (before >> 62)) + i) & self.mask)
        self.at = self.n

    def next(self) -> int:
        if self.at == self.n:
            for i in range(self.n):
                y = (self.state[i] & (self.mask ^ 0x7FFFFFFF)) | (self.state[(i + 1) % self.n] & 0x7FFFFFFF)
                self.state[i] = self.state[(i + self.m) % self.n] ^ (y >> 1) ^ (self.a if y & 1 else 0)
            self.at = 0
        x = self.state[self.at]
        self.at += 1
        x ^= (x >> 29) & 0x5555555555555555
        x ^= (x << 17) & 0x71D67FFFEDA60000
        x ^= (x << 37) & 0xFFF7EEE000000000
        return x ^ (x >> 43)

    def uniform(self) -> float:
        return min(self.next() / 2.0**64, math.nextafter(1.0, 0.0))


def bubble_images(dim: int, o: GridOptions) -> list[tuple]:
    """Centres (x, y, z) and index boxes of the bubbles and their periodic copies at a time; some 3 nbubbles rows."""
    counts = (o.nx, o.ny, o.nz if dim == 3 else 1)
    h = [1.0 / c for c in counts]
    up = dim - 1
    reach = o.radius + 4.0 * max(h[:dim])
    rng, out = Mt19937_64(o.seed), []
    for _ in range(o.nbubbles):
        x0, y0, z0, phase = (rng.uniform() for _ in range(4))
        x0, y0 = (o.radius + (1.0 - 2.0 * o.radius) * v for v in (x0, y0))
        x = min(max(x0 + 0.5 * o.radius * math.sin(2.0 * math.pi * o.time / 40.0 + 2.0 * math.pi * phase), o.radius), 1.0 - o.radius)
        height = z0 + o.cfl * h[up] * o.time
        height -= math.floor(height)
        for copy in (-1, 0, 1):
            c = (x, y0, height + copy) if dim == 3 else (x, height + copy, 0.5)
            box = [(max(0, math.floor((c[d] - reach) / h[d])), min(counts[d] - 1, math.floor((c[d] + reach) / h[d]))) if d < dim else (0, 0) for d in range(3)]
            if all(lo <= hi for lo, hi in box):
                out.append((*c, *(v for side in box for v in side)))
    return out


def bubble_field(spark: SparkSession, dim: int, o: GridOptions) -> DataFrame:
    """cell, i, j, k, alpha: the gas fraction of every cell, the largest of the bubbles that reach it."""
    nx, ny, nz = o.nx, o.ny, o.nz if dim == 3 else 1
    h = (1.0 / nx, 1.0 / ny, 1.0 / nz)
    names = ["cx", "cy", "cz", "i0", "i1", "j0", "j1", "k0", "k1"]
    schema = ", ".join(f"{c} {'double' if c[0] == 'c' else 'long'}" for c in names)
    images = spark.createDataFrame(bubble_images(dim, o), schema)
    for c in "ijk":
        images = images.withColumn(c, F.explode(F.sequence(f"{c}0", f"{c}1")))
    dx, dy = (F.col("i") + 0.5) * h[0] - F.col("cx"), (F.col("j") + 0.5) * h[1] - F.col("cy")
    dz = (F.col("k") + 0.5) * h[2] - F.col("cz") if dim == 3 else F.lit(0.0)
    profile = 0.5 * (1.0 - F.tanh((F.sqrt(dx * dx + dy * dy + dz * dz) - o.radius) / max(h[:dim])))
    inside = images.select((F.col("i") + nx * (F.col("j") + ny * F.col("k"))).alias("cell"), profile.alias("a")).groupBy("cell").agg(F.max("a").alias("a"))
    return cells(spark, nx, ny, nz).join(inside, "cell", "left").select("cell", "i", "j", "k", F.coalesce("a", F.lit(0.0)).alias("alpha"))


def cell_of(x: Column, y: Column, z: Column, nx: int, ny: int, nz: int) -> Column:
    """The number of the cell that has the point, clamped to the grid."""
    at = lambda v, n: F.least(F.greatest(F.floor(v / (1.0 / n)), F.lit(0)), F.lit(n - 1))
    return at(x, nx) + nx * (at(y, ny) + ny * at(z, nz))


def grid_faces(field: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """p, q, axis and both sides' columns (p_*, q_*) for each inner face of a field with cell, i, j, k."""
    steps = F.array_compact(F.array(F.when(F.col("i") + 1 < nx, F.struct(F.lit("x").alias("axis"), F.lit(1).alias("step"))), F.when(F.col("j") + 1 < ny, F.struct(F.lit("y").alias("axis"), F.lit(nx).alias("step"))), F.when(F.col("k") + 1 < nz, F.struct(F.lit("z").alias("axis"), F.lit(nx * ny).alias("step")))))
    left = field.select(*(F.col(c).alias(f"p_{c}") for c in field.columns), F.explode(steps).alias("s"))
    right = field.select(*(F.col(c).alias(f"q_{c}") for c in field.columns))
    return left.join(right, F.col("p_cell") + F.col("s.step") == F.col("q_cell")).select("*", F.col("s.axis").alias("axis")).drop("s")


def _bubbles(spark: SparkSession, dim: int, o: GridOptions) -> Problem:
    if o.rho_ratio <= 0 or o.radius <= 0 or o.nbubbles < 0:
        raise ValueError("rho_ratio and radius must be positive, nbubbles not negative")
    if o.source not in ("alpha", "buoyancy"):
        raise ValueError("source must be alpha or buoyancy")
    nx, ny, nz = o.nx, o.ny, o.nz if dim == 3 else 1
    hx, hy, hz = 1.0 / nx, 1.0 / ny, 1.0 / nz
    field = bubble_field(spark, dim, o).withColumn("rho", F.col("alpha") / o.rho_ratio + (1.0 - F.col("alpha")))
    geom = F.when(F.col("axis") == "x", hy * hz / hx).when(F.col("axis") == "y", hx * hz / hy).otherwise(hx * hy / hz)
    faces = grid_faces(field, nx, ny, nz).withColumn("coef", 0.5 * (1.0 / F.col("p_rho") + 1.0 / F.col("q_rho")) * geom)
    entry = lambda r, c, sign: F.struct(F.col(f"{r}_cell").alias("row"), F.col(f"{c}_cell").alias("col"), (sign * F.col("coef")).alias("val"))
    entries = faces.select(F.explode(F.array(entry("p", "q", -1), entry("q", "p", -1), entry("p", "p", 1), entry("q", "q", 1))).alias("e")).select("e.*")
    top, size = ("k", hx * hy / (0.5 * hz)) if dim == 3 else ("j", hx * hz / (0.5 * hy))
    outlet = field.filter(F.col(top) == (nz if dim == 3 else ny) - 1).select(F.col("cell").alias("row"), F.col("cell").alias("col"), (size / F.col("rho")).alias("val"))
    matrix = entries.unionByName(outlet).groupBy("row", "col").agg(F.sum("val").alias("val"))
    if o.source == "alpha":
        rhs = field.select(F.col("cell").alias("idx"), (hx * hy * hz * F.col("alpha")).alias("val"))
    else:
        axis, hv = ("k", hz) if dim == 3 else ("j", hy)
        height = F.when(F.col("axis") == ("z" if dim == 3 else "y"), (F.col(f"p_{axis}") + 1) * hv).otherwise((F.col(f"p_{axis}") + 0.5) * hv)
        flux = F.col("coef") * (1.0 - height) * (F.col("q_rho") - F.col("p_rho"))
        parts = faces.withColumn("flux", flux).select(F.explode(F.array(F.struct(F.col("p_cell").alias("idx"), F.col("flux").alias("val")), F.struct(F.col("q_cell").alias("idx"), (-F.col("flux")).alias("val")))).alias("e")).select("e.*")
        zero = field.select(F.col("cell").alias("idx"), F.lit(0.0).alias("val"))
        rhs = parts.unionByName(zero).groupBy("idx").agg(F.sum("val").alias("val"))
    return Problem(matrix, rhs, nx * ny * nz, 1, True, f"bubbles{dim}d {nx}x{ny}" + f"x{nz}" * (dim == 3))

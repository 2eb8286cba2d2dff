"""Queries of the matrix, decomposition and grid operators over the tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import algebra as A
from ..operators import decompose as D
from ..operators import distributed as M
from ..operators import partition as P
from ..operators import scan
from ..operators import tiles as T
from ..sources import grids, seeded, tables
from .schwarz import agreed, local_checks
from .store import written

PARTS = 8
#: Orders (or parts of the catalogue) in a subdomain, on average.
PART_ROWS = 250
#: DuckDB's view of the relations of sources.tables and sources.grids.
CTE = {
    "li": "li AS (SELECT l_orderkey AS row, l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY ALL)",
    "cop": """pr AS (SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem),
 w AS (SELECT a.p AS row, b.p AS col, count(*)::DOUBLE AS val FROM pr a JOIN pr b ON a.o = b.o AND a.p <> b.p GROUP BY ALL),
 cop AS (SELECT row, col, sum(val) AS val FROM (SELECT row, col, -val AS val FROM w UNION ALL SELECT row, row, val FROM w UNION ALL SELECT p_partkey, p_partkey, 1.0 FROM part) GROUP BY ALL)""",
    "x": "x AS (SELECT p_partkey AS idx, (1 + p_partkey % 7)::DOUBLE AS val FROM part)",
    "g": """side AS (SELECT greatest(2, floor(sqrt(count(*) + 1e-6)))::BIGINT AS n FROM customer),
 cell AS (SELECT c.r AS cell, c.r % n AS i, c.r // n AS j, n, 1.0 / n AS h FROM side, LATERAL (SELECT unnest(range(n * n)) AS r) c)""",
    "lap": """fc AS (SELECT cell AS p, cell + 1 AS q FROM cell WHERE i + 1 < n UNION ALL SELECT cell, cell + n FROM cell WHERE j + 1 < n),
 wall AS (SELECT cell AS p, 0.0 AS u FROM cell WHERE j = 0 UNION ALL SELECT cell, 1.0 FROM cell WHERE j = n - 1),
 a AS (SELECT row, col, sum(val) AS val FROM (SELECT p AS row, q AS col, -1.0::DOUBLE AS val FROM fc UNION ALL SELECT q, p, -1.0 FROM fc UNION ALL SELECT p, p, 1.0 FROM fc UNION ALL SELECT q, q, 1.0 FROM fc UNION ALL SELECT p, p, 2.0 FROM wall) GROUP BY ALL)""",
    "sys": """ch AS (SELECT o_orderkey AS p, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders),
 fo AS (SELECT c_custkey, c_nationkey, min(o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 sp AS (SELECT k AS p, lag(k) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q FROM fo),
 lk AS (SELECT * FROM ch WHERE q IS NOT NULL UNION ALL SELECT * FROM sp WHERE q IS NOT NULL),
 a AS (SELECT row, col, sum(val) AS val FROM (SELECT p AS row, q AS col, -1.0::DOUBLE AS val FROM lk UNION ALL SELECT q, p, -1.0 FROM lk UNION ALL SELECT p, p, 1.0 FROM lk UNION ALL SELECT q, q, 1.0 FROM lk UNION ALL SELECT o_orderkey, o_orderkey, 1.0 FROM orders) GROUP BY ALL)""",
    "pt": f"pt AS (SELECT o_orderkey AS idx, ((row_number() OVER (ORDER BY c_nationkey NULLS FIRST, o_custkey, o_orderkey) - 1) * greatest(2, n // {PART_ROWS})) // n AS part FROM orders LEFT JOIN customer ON o_custkey = c_custkey, (SELECT count(*) AS n FROM orders))",
    "cosys": "a AS (SELECT * FROM cop)",
    "copt": f"pt AS (SELECT p_partkey AS idx, ((p_partkey - lo) * greatest(2, n // {PART_ROWS})) // n AS part FROM part, (SELECT min(p_partkey) AS lo, max(p_partkey) - min(p_partkey) + 1 AS n FROM part))",
    "mem": """ed AS (SELECT row AS src, col AS dst FROM a WHERE row <> col UNION SELECT col, row FROM a WHERE row <> col),
 gh AS (SELECT DISTINCT s.part, e.dst AS idx, d.part AS owner FROM ed e JOIN pt s ON e.src = s.idx JOIN pt d ON e.dst = d.idx WHERE s.part <> d.part),
 mm AS (SELECT part, idx, part AS owner, true AS is_owned FROM pt UNION ALL SELECT part, idx, owner, false FROM gh),
 mem AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY is_owned DESC, owner, idx) - 1 AS local_idx, 1.0 / count(*) OVER (PARTITION BY idx) AS pou FROM mm)""",
}


def _sql(parts: str, body: str) -> str:
    return "WITH " + ",\n ".join(CTE[p] for p in parts.split()) + "\n" + body


def _cop(spark, d):
    """Written once, since most queries read it several times."""
    return written(tables.copurchase(spark, d), "copurchase")


def _x(spark, d):
    return tables.known_solution(tables.table(spark, d, "part").select(F.col("p_partkey").alias("idx")))


def _grid(spark, d, name="laplace2d", **more):
    n = tables.grid_side(spark, d, "customer")
    return grids.generate(spark, name, grids.GridOptions(nx=n, ny=n, **more)), n


def _chain(spark, d):
    return written(tables.order_chain(spark, d), "chain")


def _part_count(spark, d) -> int:
    return max(2, tables.table(spark, d, "orders").count() // PART_ROWS)


def along_chain(spark, d):
    """The partition that follows the chain of orders, which the number of subdomains follows."""
    return D.ordered_partition(tables.chain_order(spark, d), _part_count(spark, d))


def _parts(spark, d):
    """The chain of orders and a partition of its unknowns along it."""
    return _chain(spark, d), along_chain(spark, d)


def _members(spark, d, unity="boolean"):
    """The matrix and its overlapping subdomains, each a table, since plans read them several times."""
    a, part = _parts(spark, d)
    return a, written(D.membership(a, part, unity), "members")


def _catalogue(spark, d):
    """The co-purchase matrix and a partition of its unknowns by ranges of keys, whose number of subdomains follows the rows."""
    return _cop(spark, d), D.range_partition(tables.table(spark, d, "part").select(F.col("p_partkey").alias("idx")), PART_ROWS)


def _catalogue_members(spark, d, unity="boolean"):
    """As _members, of the co-purchase matrix: dense, so that a subdomain's neighbours are nearly all unknowns near it in the graph."""
    a, part = _catalogue(spark, d)
    return a, written(D.membership(a, part, unity), "members")


def graph_parts(spark, d):
    """The chain and the partition found from its graph alone, once for each application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in FOUND:
        a = _chain(spark, d)
        FOUND[key] = a, written(P.graph_partition(a, _orders(spark, d), _part_count(spark, d)), "graph_partition")
    return FOUND[key]


FOUND: dict = {}


def _orders(spark, d):
    return tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))


def _rounded(df, *names, digits=6):
    return df.select(*(F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns))


Q, S = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


@query("p01_from_coo", _sql("li", "SELECT * FROM li"))
def p01(spark, d):
    return tables.order_part(spark, d)


@query("p02_nnz", _sql("li", "SELECT count(*) AS nnz FROM li"))
def p02(spark, d):
    return A.nnz(tables.order_part(spark, d))


@query("p03_drop_zeros", _sql("li", "SELECT row, col, val - 25 AS val FROM li WHERE val <> 25"))
def p03(spark, d):
    return A.drop_zeros(tables.order_part(spark, d).withColumn("val", F.col("val") - 25))


@query("p04_triangles", _sql("cop", "SELECT (SELECT count(*) FROM cop WHERE row >= col) AS lower, (SELECT count(*) FROM cop WHERE row <= col) AS upper, (SELECT sum(val) FROM cop WHERE row >= col) AS lower_sum"))
def p04(spark, d):
    a = _cop(spark, d)
    return A.lower(a).agg(F.count(F.lit(1)).alias("lower"), F.sum("val").alias("lower_sum")).crossJoin(A.upper(a).agg(F.count(F.lit(1)).alias("upper")))


@query("p05_symmetry", _sql("cop", "SELECT coalesce(max(abs(a.val - coalesce(b.val, 0))), 0) <= 1e-14 * max(abs(a.val)) AS symmetric, 0.0::DOUBLE + max(abs(a.val - coalesce(b.val, 0))) / max(abs(a.val)) AS relative_gap FROM cop a LEFT JOIN cop b ON a.row = b.col AND a.col = b.row"))
def p05(spark, d):
    return A.symmetry(_cop(spark, d))


@query("p06_transpose", _sql("li", "SELECT col AS row, row AS col, val FROM li"))
def p06(spark, d):
    return A.transpose(tables.order_part(spark, d))


NUMBERED = "nb AS (SELECT p_partkey AS old_idx, row_number() OVER (ORDER BY p_partkey % 8, p_partkey) - 1 AS new_idx FROM part)"


def _numbering(spark, d):
    x = tables.table(spark, d, "part").select(F.col("p_partkey").alias("idx"), (F.col("p_partkey") % PARTS).cast("int").alias("part"))
    return D.numbering(x)


@query("p07_permute", _sql("cop", "").rstrip() + ",\n " + NUMBERED + "\nSELECT r.new_idx AS row, c.new_idx AS col, val FROM cop JOIN nb r ON row = r.old_idx JOIN nb c ON col = c.old_idx")
def p07(spark, d):
    return A.permute(_cop(spark, d), _numbering(spark, d))


@query("j11_reorder", _sql("x", "").rstrip() + ",\n " + NUMBERED + "\nSELECT new_idx AS idx, val, old_idx FROM x JOIN nb ON idx = old_idx")
def j11(spark, d):
    nb = _numbering(spark, d)
    new = A.permute_vector(_x(spark, d), nb)
    return A.original_order(new, nb).select(F.col("idx").alias("old_idx"), "val").join(nb, "old_idx").select(F.col("new_idx").alias("idx"), "val", "old_idx")


@query("w01_numbering", "SELECT p_partkey AS old_idx, row_number() OVER (ORDER BY p_partkey % 8, p_partkey) - 1 AS new_idx, (p_partkey % 8)::INTEGER AS part FROM part")
def w01(spark, d):
    return _numbering(spark, d)


@query("p09_diagonal_shift", _sql("cop", "SELECT row, col, val + CASE WHEN row = col THEN 0.5 ELSE 0 END AS val FROM cop"))
def p09(spark, d):
    x = _x(spark, d).select("idx", F.lit(0.5).alias("val"))
    return A.add_diagonal(_cop(spark, d), x)


@query("p10_pattern_fingerprint", _sql("cop", "SELECT count(*) AS entries, true AS same_when_scaled, false AS same_when_shrunk FROM cop"))
def p10(spark, d):
    a = _cop(spark, d)
    one, two, three = A.fingerprint(a), A.fingerprint(a.withColumn("val", F.col("val") * 2)), A.fingerprint(a.filter("row <> col"))
    pat = lambda df, n: df.select(F.col("pattern").alias(n))
    return one.crossJoin(pat(two, "p2")).crossJoin(pat(three, "p3")).select("entries", (F.col("pattern") == F.col("p2")).alias("same_when_scaled"), (F.col("pattern") == F.col("p3")).alias("same_when_shrunk"))


@query("p11_replace_values", _sql("cop", "SELECT row, col, val * 3 AS val FROM cop"))
def p11(spark, d):
    a = _cop(spark, d)
    return A.replace_values(a, a.withColumn("val", F.col("val") * 3))


@query("p12_changed", _sql("cop", "SELECT true AS changed, count(*) AS entries FROM cop WHERE row % 5 = 0"))
def p12(spark, d):
    a = _cop(spark, d)
    return A.changed(a, a.withColumn("val", F.col("val") + (F.col("row") % 5 == 0).cast("double")))


@query("p14_norm_estimate", _sql("cop", "SELECT round(sqrt((SELECT max(s) FROM (SELECT sum(abs(val)) s FROM cop GROUP BY row)) * (SELECT max(s) FROM (SELECT sum(abs(val)) s FROM cop GROUP BY col))), 6) AS norm"))
def p14(spark, d):
    return _rounded(A.norm_estimate(_cop(spark, d)), "norm")


@query("p16_block_cells", "SELECT DISTINCT p_partkey // 3 AS cell FROM part")
def p16(spark, d):
    return A.blocks_of(_x(spark, d), 3)


@query("j01_spmv", _sql("li x", "SELECT row AS idx, sum(li.val * x.val) AS val FROM li JOIN x ON li.col = x.idx GROUP BY row"))
def j01(spark, d):
    return A.spmv(tables.order_part(spark, d), _x(spark, d))


@query("j12_triple_product", _sql("cop", "SELECT row % 8 AS row, col % 8 AS col, sum(val) AS val FROM cop GROUP BY ALL"))
def j12(spark, d):
    w = _x(spark, d).select("idx", (F.col("idx") % PARTS).alias("coarse_col"), F.lit(1.0).alias("val"))
    return A.triple_product(w, _cop(spark, d))


@query("a01_norms", _sql("li x", ", y AS (SELECT row AS idx, sum(li.val * x.val) AS val FROM li JOIN x ON li.col = x.idx GROUP BY row) SELECT sum(val) AS total, sum(abs(val)) AS norm1, round(sqrt(sum(val * val)), 6) AS norm2, max(abs(val)) AS norm_max, count(*) AS n FROM y"))
def a01(spark, d):
    return _rounded(A.norms(j01(spark, d)), "norm2")


@query("a03_multi_dot", _sql("cop x", ", y AS (SELECT row AS idx, sum(cop.val * x.val) AS val FROM cop JOIN x ON cop.col = x.idx GROUP BY row) SELECT j, sum((1 + idx % j) * val) AS dot FROM y, (SELECT unnest(range(1, 6)) AS j) GROUP BY j"))
def a03(spark, d):
    x = _x(spark, d)
    basis = x.select("idx", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("j")).withColumn("val", (1 + F.col("idx") % F.col("j")).cast("double"))
    return A.multi_dot(basis, A.spmv(_cop(spark, d), x))


@query("a05_normalisation_factor", _sql("cop x", """, a1 AS (SELECT row AS idx, sum(val) AS v FROM cop GROUP BY row), ax AS (SELECT row AS idx, sum(cop.val * x.val) AS v FROM cop JOIN x ON cop.col = x.idx GROUP BY row), m AS (SELECT avg(val) AS m FROM x)
SELECT round(sum(abs(ax.v - m * a1.v) + abs(2 * x.val - m * a1.v)) + 1e-20, 4) AS factor FROM a1 JOIN ax USING (idx) JOIN x USING (idx), m"""))
def a05(spark, d):
    x = _x(spark, d)
    return _rounded(A.normalisation_factor(_cop(spark, d), x.withColumn("val", 2 * F.col("val")), x), "factor", digits=4)


@query("a20_backward_error", _sql("cop x", ", ax AS (SELECT row AS idx, sum(cop.val * x.val) AS v FROM cop JOIN x ON cop.col = x.idx GROUP BY row) SELECT round((SELECT max(abs(x.val - v)) FROM ax JOIN x USING (idx)) / ((SELECT max(s) FROM (SELECT sum(abs(val)) s FROM cop GROUP BY row)) * (SELECT max(abs(val)) FROM x) + (SELECT max(abs(val)) FROM x)), 9) AS backward_error"))
def a20(spark, d):
    x = _x(spark, d)
    return _rounded(A.backward_error(_cop(spark, d), x, x), "backward_error", digits=9)


@query("u03_pattern_difference", _sql("li", "SELECT count(*) FILTER (val < 10) AS only_a, count(*) FILTER (val > 45) AS only_b, count(*) FILTER (val BETWEEN 10 AND 45) AS shared, round(max(CASE WHEN val < 10 THEN val WHEN val > 45 THEN val + 1 ELSE 1 END) / max(CASE WHEN val <= 45 THEN greatest(val, CASE WHEN val >= 10 THEN val + 1 ELSE 0 END) ELSE val + 1 END), 9) AS relative_gap FROM li"))
def u03(spark, d):
    li = tables.order_part(spark, d)
    a, b = li.filter("val <= 45"), li.filter("val >= 10").withColumn("val", F.col("val") + 1)
    return _rounded(A.difference(a, b), "relative_gap", digits=9)


@query("u01_edges", _sql("cop", "SELECT row AS src, col AS dst FROM cop WHERE row <> col UNION SELECT col, row FROM cop WHERE row <> col"))
def u01(spark, d):
    return D.edges(_cop(spark, d))


@query("trade_laplacian", """WITH one AS (SELECT s_nationkey::BIGINT AS row, c_nationkey::BIGINT AS col, count(*)::DOUBLE AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
 w AS (SELECT row, col, sum(val) AS val FROM (SELECT * FROM one UNION ALL SELECT col, row, val FROM one) GROUP BY ALL)
SELECT row, col, sum(val) AS val FROM (SELECT row, col, -val AS val FROM w UNION ALL SELECT row, row, val FROM w UNION ALL SELECT n_nationkey, n_nationkey, 1.0 FROM nation) GROUP BY ALL""")
def trade(spark, d):
    return tables.trade(spark, d)


REACTION = "SELECT c_custkey AS row, c_custkey AS col, abs(c_acctbal) / 1000 AS val FROM customer, side WHERE c_custkey < {0} * n * n"


def _reacting(spark, d, matrix, unknowns):
    """matrix with a reaction term on the diagonal: the balance of the customer of that number, in thousands."""
    c = tables.table(spark, d, "customer").filter(F.col("c_custkey") < unknowns)
    return _rounded(A.add_diagonal(matrix, c.select(F.col("c_custkey").alias("idx"), (F.abs("c_acctbal") / 1000).alias("val"))), "val", digits=9)


@query("s06_laplace2d", _sql("g lap", f"SELECT row, col, round(sum(val), 9) AS val FROM (SELECT * FROM a UNION ALL {REACTION.format(1)}) GROUP BY ALL"))
def s06(spark, d):
    p, n = _grid(spark, d)
    return _reacting(spark, d, p.matrix, n * n)


@query("s06_laplace2d_rhs", _sql("g", "SELECT cell AS idx, round(CASE WHEN j = n - 1 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + coalesce(c_acctbal, 0), 6) AS val FROM cell LEFT JOIN customer ON c_custkey = cell"))
def s06_rhs(spark, d):
    """The walls' part and the customers' balances as sources."""
    source = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("source"))
    rhs = _grid(spark, d)[0].rhs.join(source, "idx", "left")
    return rhs.select("idx", F.round(F.col("val") + F.coalesce("source", F.lit(0.0)), 6).alias("val"))


K_SQL = """CASE WHEN {x} BETWEEN 0.10 AND 0.45 AND {y} BETWEEN 0.12 AND 0.30 THEN 2.0
 WHEN {s1} < 0.04 OR {s2} < 0.03 OR (abs(fmod({x}, 0.2) - 0.1) < 0.035 AND abs(fmod({y}, 0.2) - 0.1) < 0.035) THEN 0.06 ELSE 1.0 END"""


def _segment_sql(x, y, ax, ay, bx, by):
    t = f"least(greatest((({x} - {ax}) * ({bx} - {ax}) + ({y} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay})), 0.0::DOUBLE), 1.0::DOUBLE)"
    return f"sqrt(pow({x} - ({ax} + {t} * ({bx} - {ax})), 2) + pow({y} - ({ay} + {t} * ({by} - {ay})), 2))"


def kappa_sql(x: str, y: str) -> str:
    e = [f"{v}::DOUBLE" for v in (0.15, 0.62, 0.75, 0.70, 0.55, 0.62, 0.90, 0.35)]
    return K_SQL.format(x=x, y=y, s1=_segment_sql(x, y, *e[:4]), s2=_segment_sql(x, y, *e[4:]))


@query("s09_kappa", _sql("g", f"SELECT cell, round(({kappa_sql('((i + 0.5::DOUBLE) * h)', '((j + 0.5::DOUBLE) * h)')})::DOUBLE * (1 + coalesce(abs(c_acctbal), 0) / 10000), 9) AS kappa FROM cell LEFT JOIN customer ON c_custkey = cell").replace("1.0 / n AS h", "1.0::DOUBLE / n AS h"))
def s09(spark, d):
    n = tables.grid_side(spark, d, "customer")
    h = 1.0 / n
    rich = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.abs("c_acctbal").alias("balance"))
    kappa = grids.kappa((F.col("i") + 0.5) * h, (F.col("j") + 0.5) * h).cast("double") * (1 + F.coalesce("balance", F.lit(0.0)) / 10000)
    return grids.cells(spark, n, n, 1).join(rich, "cell", "left").select("cell", F.round(kappa, 9).alias("kappa"))


CONV = f"""side AS (SELECT greatest(2, floor(sqrt(count(*) + 1e-6)))::BIGINT AS n FROM customer),
 c0 AS (SELECT c.r AS cell, c.r % n AS i, c.r // n AS j, n, 1.0::DOUBLE / n AS h FROM side, LATERAL (SELECT unnest(range(n * n)) AS r) c),
 cell AS (SELECT *, ({kappa_sql('((i + 0.5::DOUBLE) * h)', '((j + 0.5::DOUBLE) * h)')})::DOUBLE AS k, (i + 1) * h AS x1, i * h AS x0, (j + 1) * h AS y1, j * h AS y0 FROM c0),
 fc AS (SELECT a.cell AS p, b.cell AS q, 2 * a.k * b.k / (a.k + b.k) AS g, a.x1 * (1 - a.x1) * ((a.y1 * a.y1 - a.y1) - (a.y0 * a.y0 - a.y0)) AS f FROM cell a JOIN cell b ON b.cell = a.cell + 1 AND a.i + 1 < a.n
  UNION ALL SELECT a.cell, b.cell, 2 * a.k * b.k / (a.k + b.k), -a.y1 * (1 - a.y1) * ((a.x1 * a.x1 - a.x1) - (a.x0 * a.x0 - a.x0)) FROM cell a JOIN cell b ON b.cell = a.cell + a.n)"""


@query("s07_convdiff2d", f"""WITH {CONV}
SELECT row, col, round(sum(val), 9) AS val FROM (SELECT p AS row, p AS col, 0.01 * g + greatest(f, 0) AS val FROM fc UNION ALL SELECT p, q, -0.01 * g - greatest(-f, 0) FROM fc
 UNION ALL SELECT q, q, 0.01 * g + greatest(-f, 0) FROM fc UNION ALL SELECT q, p, -0.01 * g - greatest(f, 0) FROM fc
 UNION ALL SELECT cell, cell, 0.01 * k * 2 FROM cell WHERE j = 0 UNION ALL SELECT cell, cell, 0.01 * k * 2 FROM cell WHERE j = n - 1 UNION ALL {REACTION.format(1)}) GROUP BY ALL""")
def s07(spark, d):
    p, n = _grid(spark, d, "convdiff2d", nu=0.01)
    return _reacting(spark, d, p.matrix, n * n)


@query("s08_coupled2d", f"""WITH {CONV}, c AS (SELECT unnest([0, 1, 2]) AS c)
SELECT row, col, round(sum(val), 9) AS val FROM (SELECT 3 * p + c AS row, 3 * p + c AS col, 0.1 * (1 + c) * g + greatest(f, 0) AS val FROM fc, c UNION ALL SELECT 3 * p + c, 3 * q + c, -0.1 * (1 + c) * g - greatest(-f, 0) FROM fc, c
 UNION ALL SELECT 3 * q + c, 3 * q + c, 0.1 * (1 + c) * g + greatest(-f, 0) FROM fc, c UNION ALL SELECT 3 * q + c, 3 * p + c, -0.1 * (1 + c) * g - greatest(f, 0) FROM fc, c
 UNION ALL SELECT 3 * cell + c, 3 * cell + c, 0.1 * (1 + c) * k * 2 FROM cell, c WHERE j = 0 UNION ALL SELECT 3 * cell + c, 3 * cell + c, 0.1 * (1 + c) * k * 2 FROM cell, c WHERE j = n - 1
 UNION ALL SELECT 3 * cell + c, 3 * cell + c, 0.1 FROM cell, c UNION ALL SELECT 3 * cell + c, 3 * cell + (c + 1) % 3, -0.1 FROM cell, c UNION ALL {REACTION.format(3)}) GROUP BY ALL""")
def s08(spark, d):
    p, n = _grid(spark, d, "coupled2d", nu=0.1, ncomp=3)
    return _reacting(spark, d, p.matrix, 3 * n * n)


@query("s07_convdiff3d")
def s07_3d(spark, d):
    n = tables.grid_side(spark, d, "customer", dim=3)
    return _rounded(grids.generate(spark, "convdiff3d", grids.GridOptions(n, n, n, nu=0.01)).matrix, "val", digits=9)


@query("s10_bubbles2d")
def s10(spark, d):
    return _rounded(_grid(spark, d, "bubbles2d", nbubbles=10, radius=0.1)[0].matrix, "val", digits=9)


@query("s15_buoyancy2d")
def s15(spark, d):
    return _rounded(_grid(spark, d, "bubbles2d", nbubbles=10, radius=0.1, source="buoyancy")[0].rhs, "val", digits=9)


@query("d01_level_partition")
def d01(spark, d):
    """On the co-purchase graph, whose levels are few."""
    return D.level_partition(_cop(spark, d), _x(spark, d), PARTS)


@query("a09_part_offsets", _sql("pt", "SELECT part::INTEGER AS part, count(*) AS n, (sum(count(*)) OVER (ORDER BY part) - count(*))::BIGINT AS first FROM pt GROUP BY part"))
def a09(spark, d):
    return D.offsets(along_chain(spark, d))


@query("j07_owner", _sql("pt", "SELECT idx, part::INTEGER AS part FROM pt"))
def j07(spark, d):
    """Each order's part as of the bounds of the new numbers; back to the old ones."""
    part = along_chain(spark, d)
    nb = D.numbering(part)
    return D.owners(nb.select(F.col("new_idx").alias("idx")), D.offsets(part)).join(nb.select(F.col("old_idx"), F.col("new_idx").alias("idx")), "idx").select(F.col("old_idx").alias("idx"), "part")


@query("d02_edge_cut", _sql("cop cosys copt", ", e AS (SELECT row, col FROM a WHERE row < col) SELECT count(*) AS cut FROM e JOIN pt p ON row = p.idx JOIN pt q ON col = q.idx WHERE p.part <> q.part"))
def d02(spark, d):
    a, part = _catalogue(spark, d)
    return D.edge_cut(a, part)


@query("d04_membership", _sql("sys pt mem", "SELECT part::INTEGER AS part, idx, owner::INTEGER AS owner, is_owned, local_idx, is_owned::INT::DOUBLE AS pou FROM mem"))
def d04(spark, d):
    return _members(spark, d)[1].withColumn("local_idx", F.col("local_idx").cast("long"))


@query("d08_multiplicity_unity", _sql("cop cosys copt mem", "SELECT part::INTEGER AS part, idx, round(pou, 9) AS pou FROM mem"))
def d08(spark, d):
    return _rounded(_catalogue_members(spark, d, "multiplicity")[1].select("part", "idx", "pou"), "pou", digits=9)


@query("w03_ghost_blocks", _sql("cop cosys copt mem", "SELECT part::INTEGER AS part, owner::INTEGER AS neighbour, min(local_idx) AS start, count(*) AS n FROM mem WHERE NOT is_owned GROUP BY ALL"))
def w03(spark, d):
    return D.ghost_blocks(_catalogue_members(spark, d)[1]).withColumn("start", F.col("start").cast("long"))


@query("d05_local_matrices", _sql("cop cosys copt mem", "SELECT r.part::INTEGER AS part, r.local_idx AS lrow, c.local_idx AS lcol, row, col, round(val, 9) AS val FROM a JOIN mem r ON row = r.idx JOIN mem c ON col = c.idx AND c.part = r.part"))
def d05(spark, d):
    out = T.local_matrices(*_catalogue_members(spark, d))
    return _rounded(out.withColumns({c: F.col(c).cast("long") for c in ("lrow", "lcol")}), "val", digits=9)


LUMP = "lump AS (SELECT m.part, m.idx, coalesce(sum(abs(a.val)) FILTER (i.idx IS NULL), 0) AS s FROM mem m JOIN a ON a.row = m.idx LEFT JOIN mem i ON i.part = m.part AND i.idx = a.col WHERE NOT m.is_owned GROUP BY ALL)"


@query("d06_lumping", _sql("cop cosys copt mem", f", {LUMP} SELECT part::INTEGER AS part, idx, round(s, 9) AS s FROM lump"))
def d06(spark, d):
    return _rounded(T.lumping(*_catalogue_members(spark, d)), "s", digits=9)


@query("d09_lumped_matrices", _sql("cop cosys copt mem", f", {LUMP}, l AS (SELECT r.part, row, col, val FROM a JOIN mem r ON row = r.idx JOIN mem c ON col = c.idx AND c.part = r.part) SELECT part::INTEGER AS part, row, col, round(sum(val), 9) AS val FROM (SELECT * FROM l UNION ALL SELECT part, idx, idx, -s FROM lump) GROUP BY ALL"))
def d09(spark, d):
    return _rounded(T.lumped_matrices(*_catalogue_members(spark, d)), "val", digits=9)


@query("d10_weighted_matrices", _sql("sys pt mem", "SELECT r.part::INTEGER AS part, row, col, round(r.pou * val * c.pou, 9) AS val FROM a JOIN mem r ON row = r.idx JOIN mem c ON col = c.idx AND c.part = r.part"))
def d10(spark, d):
    return _rounded(D.weighted_matrices(*_members(spark, d, "multiplicity")), "val", digits=9)


@query("a11_subdomain_sizes", _sql("cop cosys copt mem", "SELECT m.part::INTEGER AS part, count(*) FILTER (is_owned) AS n_own, count(*) FILTER (NOT is_owned) AS n_ghost, count(DISTINCT owner) FILTER (NOT is_owned) AS n_neighbours, (SELECT count(*) FROM a JOIN mem r ON a.row = r.idx JOIN mem c ON a.col = c.idx AND c.part = r.part WHERE r.part = m.part) AS nnz FROM mem m GROUP BY m.part"))
def a11(spark, d):
    a, members = _catalogue_members(spark, d)
    return D.sizes(members, T.counts(a, members).select("part", F.col("inside").alias("nnz")))


@query("j05_extend_add", _sql("sys pt mem", "SELECT idx, round(sum(pou * (1 + idx % 7)), 9) AS val FROM mem GROUP BY idx"))
def j05(spark, d):
    _, members = _members(spark, d, "multiplicity")
    local = D.restrict(tables.known_solution(_orders(spark, d)), members).join(members.select("part", "idx", "pou"), ["part", "idx"])
    return _rounded(D.extend_add(local.withColumn("val", F.col("val") * F.col("pou"))), "val", digits=9)


@query("j09_semi_anti", _sql("cop cosys copt mem", "SELECT m.part::INTEGER AS part, count(*) FILTER (i.idx IS NOT NULL) AS inside, count(*) FILTER (i.idx IS NULL) AS outside FROM mem m JOIN a ON a.row = m.idx LEFT JOIN mem i ON i.part = m.part AND i.idx = a.col GROUP BY m.part"))
def j09(spark, d):
    return T.counts(*_catalogue_members(spark, d))


@query("d01_graph_partition", _sql("sys pt", "SELECT (SELECT count(*) FROM orders) AS unknowns, (SELECT count(DISTINCT part) FROM pt) AS parts, (SELECT count(*) FROM a WHERE row < col) AS links, true AS balanced, true AS follows_the_graph"))
def d01_graph(spark, d):
    """The k-way partition of the graph: every part within 5 % of the mean, and at most 1.2 members for each unknown."""
    a, part = graph_parts(spark, d)
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    mean = F.sum("n") / F.count(F.lit(1))
    near = (F.max("n") <= F.greatest(mean * (1 + P.SLACK), mean + 1)) & (F.min("n") >= F.least(mean * (1 - P.SLACK), mean - 1))
    one = sizes.agg(F.sum("n").alias("unknowns"), F.count(F.lit(1)).alias("parts"), near.alias("balanced"))
    members = D.membership(a, part).agg(F.count(F.lit(1)).alias("members"))
    links = a.filter("row < col").agg(F.count(F.lit(1)).alias("links"))
    return one.crossJoin(members).crossJoin(links).select("unknowns", "parts", "links", "balanced", (F.col("members") <= 1.2 * F.col("unknowns")).alias("follows_the_graph"))  # one row each


AX = "ax AS (SELECT row AS idx, sum(val * (1 + col % 7)) AS val FROM a GROUP BY row)"


@query("d03_decomposition", _sql("sys", f", {AX} SELECT idx, round(val, 9) AS val FROM ax"))
def d03(spark, d):
    """From matrix to answer: partition by the graph, renumber, distribute, one product, and back to the first order."""
    a, part = graph_parts(spark, d)
    nb = written(D.numbering(part), "numbering")
    new = nb.select(F.col("new_idx").alias("idx"), "part")
    x = A.permute_vector(tables.known_solution(_orders(spark, d)), nb)
    y = M.product(M.distribute(A.permute(a, nb), new), M.vector(x, new))
    return _rounded(A.original_order(y, nb), "val", digits=9)


@query("j02_distributed_product", _sql("sys", f", {AX} SELECT row AS idx, round(sum(a.val * ax.val), 9) AS val FROM a JOIN ax ON col = ax.idx GROUP BY row"))
def j02(spark, d):
    """A A x with the matrix in place: the second product takes the first one's parts as they are."""
    a, part = graph_parts(spark, d)
    m = M.distribute(a, part)
    y = M.held(M.product(m, M.vector(tables.known_solution(_orders(spark, d)), part)))
    return _rounded(M.product(m, y).select("idx", "val"), "val", digits=9)


@query("j04_restrict_columns", _sql("sys pt mem", "SELECT part::INTEGER AS part, mem.idx, j, (j + mem.idx % 7)::DOUBLE AS val FROM mem, (SELECT unnest([1, 2, 3]) AS j)"))
def j04(spark, d):
    """R_i X of three columns at once."""
    x = _orders(spark, d).select("idx", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("j")).withColumn("val", (F.col("j") + F.col("idx") % 7).cast("double"))
    return D.restrict(x, _members(spark, d)[1])


@query("j13_routed_entries", _sql("sys pt", "SELECT part::INTEGER AS part, count(*) AS entries, sum(val) AS total FROM a JOIN pt ON row = idx GROUP BY part"))
def j13(spark, d):
    """Coefficients by the owner of their row, found as of the bounds of the new numbers."""
    a, part = _parts(spark, d)
    nb = written(D.numbering(part), "numbering")
    return M.routed(A.permute(a, nb), D.offsets(part)).groupBy("part").agg(F.count(F.lit(1)).alias("entries"), F.sum("val").alias("total"))


NEW_VALUES = "b AS (SELECT row, col, val * (1 + row % 3) + CASE WHEN row = col THEN o_totalprice / 1000 ELSE 0 END AS val FROM a JOIN orders ON row = o_orderkey)"


def _new_values(spark, d, a):
    price = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_totalprice") / 1000).alias("price"))
    return a.join(price, "row").select("row", "col", (F.col("val") * (1 + F.col("row") % 3) + F.when(F.col("row") == F.col("col"), F.col("price")).otherwise(0.0)).alias("val"))


@query("p13_refilled_subdomains", _sql("sys", f", {NEW_VALUES}, " + CTE["pt"] + ", " + CTE["mem"] + ", l AS (SELECT r.part, row, col, val, c.idx IS NOT NULL AS inside FROM b JOIN mem r ON row = r.idx LEFT JOIN mem c ON col = c.idx AND c.part = r.part) SELECT part::INTEGER AS part, row, CASE WHEN inside THEN col ELSE row END AS col, round(sum(CASE WHEN inside THEN val ELSE -abs(val) END), 6) AS val, 1 AS version FROM l GROUP BY ALL"))
def p13(spark, d):
    """The lumped local matrices after new values came to their places, at their version."""
    a, members = _members(spark, d)
    now = M.update(M.subdomains(a, members), _new_values(spark, d, a))
    return _rounded(M.lumped_values(now), "val", digits=6).withColumn("version", F.lit(now.version))


@query("d11_versions", _sql("sys", f", {NEW_VALUES}, " + CTE["pt"] + ", " + CTE["mem"] + ", n AS (SELECT count(*) FILTER (a.val <> b.val) AS n FROM a JOIN b USING (row, col) JOIN mem ON a.row = mem.idx) SELECT unnest([0, 1, 2]) AS step, unnest([0, n, 0]) AS changed, unnest([0, 1, 1]) AS version FROM n"))
def d11(spark, d):
    """Updates with the same, new and again the same values: changed places (of all subdomains) and the version."""
    a, members = _members(spark, d)
    s, rows = M.subdomains(a, members), []
    for step, new in enumerate((a, changed := written(_new_values(spark, d, a), "values"), changed)):
        s = M.update(s, new)
        rows.append((step, s.changed, s.version))
    return spark.createDataFrame(rows, "step int, changed long, version int")


@query("a06_residual_norms", _sql("sys", f", {AX} SELECT round(sum(abs(o_totalprice - val)), 3) AS norm1, round(sqrt(sum(pow(o_totalprice - val, 2))), 3) AS norm2 FROM ax JOIN orders ON idx = o_orderkey"))
def a06(spark, d):
    """Both norms of the prices minus A x in one pass."""
    b = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("val"))
    r = A.norms(A.residual(_chain(spark, d), tables.known_solution(b), b))
    return _rounded(r.select("norm1", "norm2"), "norm1", "norm2", digits=3)


@query("a15_subdomain_checks", _sql("sys pt mem", "SELECT part::INTEGER AS part, CASE WHEN bool_or(idx % 1000 = 7) THEN 'pinv' ELSE 'cholesky' END AS method, NOT bool_or(idx % 1000 = 7) AS ok, count(*) FILTER (bool_or(idx % 1000 = 7)) OVER () AS failed FROM mem GROUP BY part"))
def a15(spark, d):
    """Factorizations of all subdomains of a matrix with some empty rows: which failed, and how many did."""
    a, members = _members(spark, d)
    holes = a.withColumn("val", F.when((F.col("row") % 1000 == 7) | (F.col("col") % 1000 == 7), 0.0).otherwise(F.col("val")))
    checks, failed, _ = agreed(local_checks(holes, members, True))
    return checks.withColumn("failed", F.lit(failed).cast("long"))


@query("o01_row_arrays", _sql("li x", "SELECT row AS idx, sum(li.val * x.val) AS val FROM li JOIN x ON li.col = x.idx GROUP BY row"))
def o01(spark, d):
    """A x over rows as sorted arrays, which are read as one array each; x is exploded to the entries."""
    rows = A.row_arrays(tables.order_part(spark, d))
    return A.row_spmv(rows, _x(spark, d))


@query("s13_point_cells", """WITH side AS (SELECT greatest(2, floor(sqrt(count(*) + 1e-6)))::BIGINT AS n FROM customer), p AS (SELECT o_orderkey, (o_orderkey % 997) / 980.0::DOUBLE - 0.01::DOUBLE AS x, (o_custkey % 991) / 991.0::DOUBLE AS y, n FROM orders, side)
SELECT o_orderkey, least(greatest(floor(x / (1.0::DOUBLE / n)), 0), n - 1)::BIGINT + n * least(greatest(floor(y / (1.0::DOUBLE / n)), 0), n - 1)::BIGINT AS cell FROM p""")
def s13(spark, d):
    """The cell of each order's point, some of which lie outside the grid."""
    n = tables.grid_side(spark, d, "customer")
    x, y = (F.col("o_orderkey") % 997) / F.lit(980.0) - F.lit(0.01), (F.col("o_custkey") % 991) / F.lit(991.0)
    return tables.table(spark, d, "orders").select("o_orderkey", grids.cell_of(x, y, F.lit(0.0), n, n, 1).cast("long").alias("cell"))


# The standard's seed sequence of each of the pairs, and its engine, as recursions: half a window of 156 words a step.
SEEDS_SQL = f"""sq AS (SELECT step, corrector, 0 AS k, [{seeded.SEED}::BIGINT, step, corrector, {seeded.STEP_MARK}] AS v, list_transform(range(624), lambda i: {seeded.FILL}::BIGINT) AS b FROM pairs
  UNION ALL SELECT step, corrector, k + 1, v, list_transform(b, lambda y, i: CASE WHEN i - 1 = k % 624 THEN own
    WHEN i - 1 = (k + 306) % 624 THEN CASE WHEN k < 624 THEN (y + r) % 4294967296 ELSE xor(y, r) END
    WHEN i - 1 = (k + 317) % 624 THEN CASE WHEN k < 624 THEN (y + own) % 4294967296 ELSE xor(y, own) END ELSE y END)
  FROM (SELECT *, CASE WHEN k < 624 THEN (r + CASE WHEN k = 0 THEN 4 WHEN k <= 4 THEN k + v[k] ELSE k END) % 4294967296 ELSE (r - k % 624 + 4294967296) % 4294967296 END AS own
  FROM (SELECT *, CASE WHEN k < 624 THEN ({seeded.MIX1} * xor(u, u >> 27)) % 4294967296 ELSE ({seeded.MIX2} * xor(u, u >> 27)) % 4294967296 END AS r
  FROM (SELECT *, CASE WHEN k < 624 THEN xor(xor(b[k % 624 + 1], b[(k + 306) % 624 + 1]), b[(k + 623) % 624 + 1]) ELSE (b[k % 624 + 1] + b[(k + 306) % 624 + 1] + b[(k + 623) % 624 + 1]) % 4294967296 END AS u FROM sq WHERE k < 1248)))),
 first AS (SELECT step, corrector, list_transform(range(312), lambda i: b[2 * i + 1]::UBIGINT + b[2 * i + 2]::UBIGINT * 4294967296::UBIGINT) AS s FROM sq WHERE k = 1248)"""
TWIST_SQL = f"""tw AS (SELECT *, 0 AS h FROM first UNION ALL
  SELECT tw.* EXCLUDE (s, h), list_concat(s[157:312], list_transform(range(1, 157), lambda i: xor(xor(s[i + 156], ((s[i] & {seeded.UPPER}::UBIGINT) | (s[i + 1] & {seeded.LOWER}::UBIGINT)) >> 1), CASE WHEN s[i + 1] & 1 = 1 THEN {seeded.TWIST}::UBIGINT ELSE 0::UBIGINT END))), h + 1 FROM tw, many WHERE h * 156 < many.n),
 w0 AS (SELECT * EXCLUDE (s, h), unnest(s[157:312]) AS g, (h - 1) * 156 + generate_subscripts(s[157:312], 1) - 1 AS place FROM tw WHERE h > 0),
 w1 AS (SELECT * REPLACE (xor(g, (g >> 29) & 6148914691236517205::UBIGINT) AS g) FROM w0),
 w2 AS (SELECT * REPLACE (xor(g, (g & (8202884508482404352::UBIGINT >> 17)) << 17) AS g) FROM w1),
 w3 AS (SELECT * REPLACE (xor(g, (g & (18444473444759240704::UBIGINT >> 37)) << 37) AS g) FROM w2),
 drawn AS (SELECT * EXCLUDE (g), least(xor(g, g >> 43)::DOUBLE / 18446744073709551616.0::DOUBLE, 0.9999999999999999::DOUBLE) * 2 - 1 AS val FROM w3)"""


@query("s16_random_vector", f"""WITH RECURSIVE many AS (SELECT count(*) AS n FROM orders),
 wd AS (SELECT 0 AS i, {seeded.SEED}::UBIGINT AS w UNION ALL SELECT i + 1, (({seeded.INIT}::HUGEINT * xor(w, w >> 62)::HUGEINT + i + 1) % 18446744073709551616::HUGEINT)::UBIGINT FROM wd WHERE i < 311),
 first AS (SELECT list(w ORDER BY i) AS s FROM wd),
 {TWIST_SQL}
SELECT o_orderkey AS idx, val FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) JOIN drawn USING (place)""")
def s16(spark, d):
    """The seeded right-hand side over the orders, in the order of their keys."""
    at = scan.placed(tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("idx")), "idx")
    drawn = seeded.random_vector(spark, at.count(), seeded.SEED).withColumnRenamed("idx", "place")
    return at.join(drawn, "place").select("idx", "val")


@query("s17_step_vectors", f"""WITH RECURSIVE many AS (SELECT count(*) AS n FROM supplier),
 lg AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
 pairs AS (SELECT DISTINCT seq // 3 AS step, seq % 3 AS corrector FROM lg),
 {SEEDS_SQL},
 {TWIST_SQL}
SELECT step, corrector, s_suppkey AS idx, val FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier) JOIN drawn USING (place)""")
def s17(spark, d):
    """The right-hand sides over the suppliers of every step and corrector that the log of solves has."""
    at = scan.placed(tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx")), "idx")
    steps = tables.solve_log(spark, d).select("step", "corrector").distinct()
    drawn = seeded.uniform(steps.withColumn("seed", seeded.step_seed(seeded.SEED, F.col("step"), F.col("corrector"))), at.count())
    return at.join(drawn, "place").select("step", "corrector", "idx", "val")


@query("o03_top_k_over_threshold", "SELECT run, k, size FROM (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC, event_id) AS k, abs(value) AS size FROM events) WHERE k <= 5 AND size >= 10")
def o03(spark, d):
    e = tables.table(spark, d, "events").select(F.col("user_id").alias("run"), "event_id", F.abs("value").alias("size"))
    k = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("size"), "event_id"))
    return e.withColumn("k", k.cast("long")).filter((F.col("k") <= 5) & (F.col("size") >= 10)).select("run", "k", "size")


@query("q48_masked_components", """WITH RECURSIVE side AS (SELECT greatest(2, floor(sqrt(count(*) + 1e-6)))::BIGINT AS n FROM customer),
 k AS (SELECT c_custkey AS cell, c_custkey % n AS i, n, c_acctbal AS v FROM customer, side WHERE c_custkey < n * n AND c_acctbal > 6000),
 e AS (SELECT a.cell AS p, b.cell AS q FROM k a JOIN k b ON b.cell = a.cell + 1 AND a.i + 1 < a.n UNION ALL SELECT a.cell, b.cell FROM k a JOIN k b ON b.cell = a.cell + a.n),
 b AS (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
 r AS (SELECT cell AS x, cell AS y FROM k UNION SELECT r.x, b.q FROM r JOIN b ON r.y = b.p),
 l AS (SELECT x AS cell, min(y) AS label FROM r GROUP BY x)
SELECT label, count(*) AS cells, round(sum(v), 2) AS total FROM l JOIN k USING (cell) GROUP BY label""")
def q48(spark, d):
    """Connected components of the masked cells of a grid, and what each adds up to."""
    from ..operators.graph import components

    n = tables.grid_side(spark, d, "customer")
    c = tables.table(spark, d, "customer").filter((F.col("c_custkey") < n * n) & (F.col("c_acctbal") > 6000))
    cell = c.select(F.col("c_custkey").alias("cell"), (F.col("c_custkey") % n).alias("i"), F.floor(F.col("c_custkey") / n).alias("j"), F.lit(0).alias("k"), F.col("c_acctbal").alias("v"))
    faces = grids.grid_faces(cell, n, n, 1).select(F.col("p_cell").alias("src"), F.col("q_cell").alias("dst"))
    label = components(cell.select(F.col("cell").alias("idx")), faces)
    return cell.join(label.hint("merge"), F.col("cell") == F.col("idx")).groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("v"), 2).alias("total"))

"""Reports over a campaign of runs: logs, timers, exit status, settings and published figures, joined by the run.

The solve log is the events table (sources.tables.solve_log). Of the same tables come the timers of each run (what its
events of one sixth of the ids add up to), the exit status and the settings (the customer of the run's number), and the
published figures of each problem (a nation's)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from .report_queries import LOG, SUMMARY, summary

Q, S = {}, {}
TIMERS = ["setup.eig", "setup.lu", "apply.local", "apply.coarse", "krylov.spmv", "krylov.orth"]
COLUMNS = [t.replace(".", "_") for t in TIMERS]
CTE = {
    "lg": LOG,
    "sm": SUMMARY,
    "tm": f"tm AS (SELECT user_id AS run, {TIMERS}[event_id % 6 + 1] AS timer, sum(value) AS sec FROM events GROUP BY ALL)",
    "tp": "tp AS (SELECT run, " + ", ".join(f"sum(sec) FILTER (timer = '{t}') AS {c}" for t, c in zip(TIMERS, COLUMNS)) + " FROM tm GROUP BY run)",
    "st": "st AS (SELECT c_custkey AS run, ['ok', 'ok', 'timeout', 'error'][c_custkey % 4 + 1] AS status, c_acctbal AS wall, c_nationkey AS nodes, c_custkey % 3 AS tau, c_custkey % 2 AS unity FROM customer)",
    "pub": "pub AS (SELECT n_nationkey AS grp, 10 + 5 * n_regionkey AS pub_its, (1 + n_nationkey % 4) / 10 AS pub_ratio FROM nation)",
    "ext": "ext AS (SELECT o_custkey AS run, count(*) AS solves, sum(o_totalprice) / 1000 AS seconds FROM orders GROUP BY o_custkey)",
}


class Campaign:
    """The relations of a campaign."""

    def __init__(self, spark, d):
        t = lambda n: tables.table(spark, d, n)
        self.log = tables.solve_log(spark, d)
        self.runs = summary(self.log)
        e, c, n = t("events"), t("customer"), t("nation")
        name = lambda i, *of: F.element_at(F.array(*map(F.lit, of)), (i + 1).cast("int"))
        self.timers = e.groupBy(F.col("user_id").alias("run"), name(F.col("event_id") % 6, *TIMERS).alias("timer")).agg(F.sum("value").alias("sec"))
        self.phases = self.timers.withColumn("timer", F.translate("timer", ".", "_")).groupBy("run").pivot("timer", COLUMNS).agg(F.sum("sec"))
        key = F.col("c_custkey")
        self.status = c.select(key.alias("run"), name(key % 4, "ok", "ok", "timeout", "error").alias("status"), F.col("c_acctbal").alias("wall"), F.col("c_nationkey").alias("nodes"), (key % 3).alias("tau"), (key % 2).alias("unity"))
        self.published = n.select(F.col("n_nationkey").alias("grp"), (10 + 5 * F.col("n_regionkey")).alias("pub_its"), ((1 + F.col("n_nationkey") % 4) / 10).alias("pub_ratio"))
        self.external = t("orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count(F.lit(1)).alias("solves"), (F.sum("o_totalprice") / 1000).alias("seconds"))
        self.spark, self.dir = spark, d


def query(name, parts, sql):
    def keep(f):
        Q[name] = lambda spark, d: f(Campaign(spark, d))
        S[name] = "WITH " + ",\n ".join(CTE[p] for p in parts.split()) + "\n" + sql
        return f

    return keep


def _r(c, digits=6):
    """Rounded, under the same name if it is one."""
    return F.round(c, digits).alias(c) if isinstance(c, str) else F.round(c, digits)


def _ratio(a, b) -> Column:
    return F.round(F.try_divide(a, b), 6)


@query("j15_published", "lg sm pub", "SELECT run, sm.grp, round(its_avg, 6) AS its_avg, pub_its, round(its_avg / pub_its, 6) AS ratio FROM sm LEFT JOIN pub ON sm.grp = pub.grp")
def j15(c):
    """Measured against published figures; problems without one keep their row."""
    return c.runs.join(c.published, "grp", "left").select("run", "grp", _r("its_avg"), "pub_its", _ratio("its_avg", "pub_its").alias("ratio"))


@query("j17_run_facts", "lg sm tm tp st", "SELECT sm.run, solves, status, round(wall, 4) AS wall, round(setup_eig, 4) AS setup_eig, round(krylov_spmv, 4) AS krylov_spmv FROM sm LEFT JOIN tp ON sm.run = tp.run LEFT JOIN st ON sm.run = st.run")
def j17(c):
    """Log, timers and status of each run of the log."""
    return c.runs.join(c.phases, "run", "left").join(c.status, "run", "left").select("run", "solves", "status", _r("wall", 4), _r("setup_eig", 4), _r("krylov_spmv", 4))


@query("q06_time_split", "lg sm tm tp", """SELECT run, round((coalesce(apply_local, 0) + coalesce(apply_coarse, 0) + coalesce(krylov_spmv, 0) + coalesce(krylov_orth, 0)) / nullif(its_avg * solves, 0), 6) AS per_iteration,
 round((coalesce(setup_eig, 0) + coalesce(setup_lu, 0)) / (1 + rebuild), 6) AS per_setup FROM sm JOIN tp USING (run)""")
def q06(c):
    t = c.runs.join(c.phases.na.fill(0.0), "run")
    solve = F.col("apply_local") + F.col("apply_coarse") + F.col("krylov_spmv") + F.col("krylov_orth")
    return t.select("run", _ratio(solve, F.col("its_avg") * F.col("solves")).alias("per_iteration"), _ratio(F.col("setup_eig") + F.col("setup_lu"), 1 + F.col("rebuild")).alias("per_setup"))


@query("q07_operation_costs", "lg", "SELECT kind, round(avg(t_update) FILTER (level = 'rebuild'), 6) AS rebuild, round(avg(t_update) FILTER (level = 'refactorize'), 6) AS refactorize, round(avg(t_update) FILTER (level = 'rebuild') / nullif(avg(t_update) FILTER (level = 'refactorize'), 0), 6) AS ratio FROM lg GROUP BY kind")
def q07(c):
    t = c.log.groupBy("kind").pivot("level", ["rebuild", "refactorize"]).agg(F.avg("t_update"))
    return t.select("kind", _r("rebuild"), _r("refactorize"), _ratio("rebuild", "refactorize").alias("ratio"))


@query("q09_coarse_solvers", "lg sm", ", n AS (SELECT grp || '_' || mode AS name, per_solve FROM sm) SELECT split_part(name, '_', 1) AS problem, split_part(name, '_', 2) AS solver, round(per_solve, 6) AS cost, row_number() OVER (PARTITION BY split_part(name, '_', 1) ORDER BY per_solve, name) AS place FROM n")
def q09(c):
    """Names are problem_solver: the solvers of each problem, cheapest first."""
    n = c.runs.select(F.concat_ws("_", "grp", "mode").alias("name"), "per_solve")
    n = n.select("name", F.substring_index("name", "_", 1).alias("problem"), F.substring_index("name", "_", -1).alias("solver"), "per_solve")
    place = F.row_number().over(Window.partitionBy("problem").orderBy("per_solve", "name"))
    return n.select("problem", "solver", _r("per_solve").alias("cost"), place.cast("long").alias("place"))


BOTH = "bo AS (SELECT 'own' AS code, run, np, solves, per_solve AS cost, its_avg FROM sm UNION ALL SELECT 'external', run, NULL, solves, seconds / solves, NULL FROM ext)"


def _both(c) -> DataFrame:
    """Two schemas of logs as one: the external code's has neither processes nor iterations."""
    own = c.runs.select(F.lit("own").alias("code"), "run", "np", "solves", F.col("per_solve").alias("cost"), "its_avg")
    return own.unionByName(c.external.select(F.lit("external").alias("code"), "run", "solves", (F.col("seconds") / F.col("solves")).alias("cost")), allowMissingColumns=True)


@query("q11_scaling_two_schemas", "lg sm ext", f", {BOTH} SELECT code, run, np, solves, round(cost, 6) AS cost, round(its_avg, 6) AS its_avg FROM bo")
def q11(c):
    return _both(c).select("code", "run", "np", "solves", _r("cost"), _r("its_avg"))


@query("q12_phase_shares", "lg sm tm tp", """, p AS (SELECT run, t_solve, apply_local / nullif(total, 0) AS l, apply_coarse / nullif(total, 0) AS c FROM (SELECT *, coalesce(apply_local, 0) + coalesce(apply_coarse, 0) + coalesce(krylov_spmv, 0) + coalesce(krylov_orth, 0) AS total FROM tp) JOIN sm USING (run))
SELECT run, round(t_solve * l, 4) AS local, round(t_solve * c, 4) AS coarse, round(t_solve * (1 - l - c), 4) AS krylov FROM p""")
def q12(c):
    """The solves' time by the timers' shares; what is neither local nor coarse is the Krylov method's. A missing timer leaves nulls."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    t = c.phases.withColumn("total", sum((zero(F.col(x)) for x in COLUMNS[3:]), zero(F.col("apply_local"))))
    t = t.join(c.runs.select("run", "t_solve"), "run").withColumns({"l": F.try_divide("apply_local", "total"), "c": F.try_divide("apply_coarse", "total")})
    return t.select("run", _r(F.col("t_solve") * F.col("l"), 4).alias("local"), _r(F.col("t_solve") * F.col("c"), 4).alias("coarse"), _r(F.col("t_solve") * (1 - F.col("l") - F.col("c")), 4).alias("krylov"))


@query("q18_settings_differ", "lg sm st", ", k AS (SELECT grp, unnest(['tau', 'unity', 'nodes']) AS key, unnest([tau, unity, nodes]) AS setting FROM sm JOIN st USING (run)) SELECT grp, key, count(DISTINCT setting) AS n, min(setting) AS least, max(setting) AS most FROM k GROUP BY grp, key HAVING count(DISTINCT setting) > 1")
def q18(c):
    """Settings that differ between the runs of one problem."""
    own = c.runs.select("run", "grp").join(c.status, "run").select("grp", *(F.col(x).cast("long").alias(x) for x in ("tau", "unity", "nodes")))
    k = own.unpivot(["grp"], ["tau", "unity", "nodes"], "key", "setting")
    return k.groupBy("grp", "key").agg(F.count_distinct("setting").alias("n"), F.min("setting").alias("least"), F.max("setting").alias("most")).filter("n > 1")


@query("q19_krylov_split", "lg sm tm tp", "SELECT run, round(1000 * krylov_spmv / nullif(its_avg * solves, 0), 6) AS spmv_ms, round(1000 * krylov_orth / nullif(its_avg * solves, 0), 6) AS orth_ms, round(greatest(t_solve - coalesce(krylov_spmv, 0) - coalesce(krylov_orth, 0), 0), 4) AS other, round(converged::DOUBLE / solves, 6) AS finished FROM sm JOIN tp USING (run)")
def q19(c):
    t = c.runs.join(c.phases, "run")
    ms = lambda x: _ratio(1000 * F.col(x), F.col("its_avg") * F.col("solves"))
    other = F.greatest(F.col("t_solve") - F.coalesce("krylov_spmv", F.lit(0.0)) - F.coalesce("krylov_orth", F.lit(0.0)), F.lit(0.0))
    return t.select("run", ms("krylov_spmv").alias("spmv_ms"), ms("krylov_orth").alias("orth_ms"), _r(other, 4).alias("other"), _ratio("converged", "solves").alias("finished"))


@query("q23_status_precedence", "lg sm st", "SELECT st.run, CASE WHEN solves IS NULL THEN status WHEN converged < solves THEN 'not_converged' ELSE 'ok' END AS outcome, status FROM st LEFT JOIN sm ON st.run = sm.run")
def q23(c):
    """What the log says comes before the exit status."""
    logged = F.when(F.col("converged") < F.col("solves"), "not_converged").when(F.col("solves").isNotNull(), "ok")
    return c.status.join(c.runs, "run", "left").select("run", F.coalesce(logged, "status").alias("outcome"), "status")


@query("q24_setup_remainder", "lg sm tm tp", "SELECT run, round(coalesce(setup_eig, 0), 4) AS eig, round(coalesce(setup_lu, 0), 4) AS lu, round(greatest(t_init + t_upd - coalesce(setup_eig, 0) - coalesce(setup_lu, 0), 0), 4) AS rest FROM sm LEFT JOIN tp USING (run)")
def q24(c):
    t = c.runs.join(c.phases.na.fill(0.0), "run", "left").na.fill(0.0, ["setup_eig", "setup_lu"])
    rest = F.greatest(F.col("t_init") + F.col("t_upd") - F.col("setup_eig") - F.col("setup_lu"), F.lit(0.0))
    return t.select("run", _r("setup_eig", 4).alias("eig"), _r("setup_lu", 4).alias("lu"), _r(rest, 4).alias("rest"))


TAU = "tt AS (SELECT grp, tau, unity, avg(its_avg) AS its, avg(n0) AS n0 FROM sm JOIN st USING (run) GROUP BY grp, tau, unity)"


def _by_tau(c) -> DataFrame:
    """grp, tau, unity, its, n0: means of the runs."""
    return c.runs.join(c.status, "run").groupBy("grp", "tau", "unity").agg(F.avg("its_avg").alias("its"), F.avg("n0").alias("n0"))


@query("q25_published_table", "lg sm st pub", f", {TAU}, g AS (SELECT grp, avg(its) AS its FROM tt GROUP BY grp) SELECT tt0.grp, " + ", ".join(f"round(avg(its) FILTER (tau = {k}), 6) AS its_{k}, round(avg(n0) FILTER (tau = {k}), 6) AS n0_{k}" for k in range(3)) + ", max(pub_its) AS pub_its FROM tt tt0 LEFT JOIN pub ON pub.grp = tt0.grp GROUP BY tt0.grp")
def q25(c):
    """One row for each problem, a pair of columns for each threshold, and the published figure."""
    t = _by_tau(c).groupBy("grp").pivot("tau", [0, 1, 2]).agg(F.avg("its").alias("its"), F.avg("n0").alias("n0")).join(c.published, "grp", "left")
    return t.select("grp", *(_r(f"{k}_{x}").alias(f"{x}_{k}") for k in range(3) for x in ("its", "n0")), "pub_its")


@query("q28_system_comparison", "lg", """, l AS (SELECT l_orderkey AS row, l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY ALL), a AS (SELECT * FROM l WHERE val <= 45), b AS (SELECT row, col, val * 1.001 AS val FROM l WHERE val >= 10),
 j AS (SELECT a.val AS x, b.val AS y FROM a FULL JOIN b ON a.row = b.row AND a.col = b.col)
SELECT count(*) FILTER (y IS NULL) AS only_first, count(*) FILTER (x IS NULL) AS only_second, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS both, round(max(abs(x - y)) / max(abs(x)) FILTER (y IS NOT NULL), 9) AS relative_gap,
 CASE WHEN count(*) FILTER (x IS NULL OR y IS NULL) > 0 THEN 'patterns differ' WHEN max(abs(x - y)) > 1e-9 * max(abs(x)) THEN 'values differ' ELSE 'equal' END AS verdict FROM j""")
def q28(c):
    """Two systems: what only one has, the largest difference of the rest, and a verdict."""
    a = tables.order_part(c.spark, c.dir)
    first, second = a.filter("val <= 45"), a.filter("val >= 10").select("row", "col", (F.col("val") * 1.001).alias("other"))
    x, y = F.col("val"), F.col("other")
    both = x.isNotNull() & y.isNotNull()
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    t = first.join(second, ["row", "col"], "full_outer").agg(n(y.isNull(), "only_first"), n(x.isNull(), "only_second"), n(both, "both"), F.max(F.abs(x - y)).alias("gap"), F.max(F.when(both, F.abs(x))).alias("size"))
    verdict = F.when(F.col("only_first") + F.col("only_second") > 0, "patterns differ").when(F.col("gap") > 1e-9 * F.col("size"), "values differ").otherwise("equal")
    return t.select("only_first", "only_second", "both", _r(F.col("gap") / F.col("size"), 9).alias("relative_gap"), verdict.alias("verdict"))


@query("q30_series", "lg", "SELECT grp, mode, seq, round(avg(iterations), 6) AS iterations, round(avg(t_solve), 6) AS t_solve FROM lg GROUP BY grp, mode, seq")
def q30(c):
    """Iterations and time by the solve's place, for curves of several runs."""
    return c.log.groupBy("grp", "mode", "seq").agg(_r(F.avg("iterations")).alias("iterations"), _r(F.avg("t_solve")).alias("t_solve"))


@query("q32_tau_sweep", "lg sm st pub", f", {TAU}, o AS (SELECT grp, tau, avg(its) AS its FROM tt WHERE unity = 0 GROUP BY ALL), f AS (SELECT grp, tau, avg(its) AS its FROM tt WHERE unity = 1 GROUP BY ALL), k AS (SELECT DISTINCT grp, tau FROM tt)"
       " SELECT k.grp, k.tau, round(coalesce(o.its, f.its), 6) AS its, pub_its FROM k LEFT JOIN o ON o.grp = k.grp AND o.tau = k.tau LEFT JOIN f ON f.grp = k.grp AND f.tau = k.tau LEFT JOIN pub ON pub.grp = k.grp UNION ALL SELECT grp, -1, round(avg(its), 6), NULL FROM tt GROUP BY grp")
def q32(c):
    """Thresholds next to published points, with the other runs of the same threshold where the sweep lacks one; a row of all runs is added."""
    t = _by_tau(c)
    one = lambda u, name: t.filter(F.col("unity") == u).groupBy("grp", "tau").agg(F.avg("its").alias(name))
    k = t.select("grp", "tau").distinct().join(one(0, "own"), ["grp", "tau"], "left").join(one(1, "other"), ["grp", "tau"], "left").join(c.published, "grp", "left")
    rows = k.select("grp", F.col("tau").cast("long").alias("tau"), _r(F.coalesce("own", "other")).alias("its"), F.col("pub_its").cast("long").alias("pub_its"))
    return rows.union(t.groupBy("grp").agg(_r(F.avg("its")).alias("its")).select("grp", F.lit(-1).cast("long"), "its", F.lit(None).cast("long")))


@query("q34_levels_matrix", "lg sm pub", "SELECT sm.grp, " + ", ".join(f"round(max(its_avg) FILTER (mode = '{m}'), 6) AS its_{m}" for m in ("off", "auto")) + ", round(max(n0) FILTER (mode = 'auto') / 1000.0, 6) AS n0_share, max(pub_its) AS pub_its, round(max(pub_ratio), 6) AS pub_ratio FROM sm LEFT JOIN pub ON pub.grp = sm.grp GROUP BY sm.grp")
def q34(c):
    t = c.runs.groupBy("grp").pivot("mode", ["off", "auto"]).agg(F.max("its_avg").alias("its"), F.max("n0").alias("n0")).join(c.published, "grp", "left")
    return t.select("grp", _r("off_its").alias("its_off"), _r("auto_its").alias("its_auto"), _r(F.col("auto_n0") / 1000.0).alias("n0_share"), "pub_its", _r("pub_ratio"))


@query("q35_subphases", "tm st", "SELECT status, regexp_extract(timer, '^([a-z]+)', 1) AS part, regexp_extract(timer, '([a-z]+)$', 1) AS phase, count(*) AS n, round(sum(sec), 4) AS seconds FROM tm JOIN st USING (run) GROUP BY ALL")
def q35(c):
    t = c.timers.join(c.status, "run").withColumns({"part": F.regexp_extract("timer", "^([a-z]+)", 1), "phase": F.regexp_extract("timer", "([a-z]+)$", 1)})
    return t.groupBy("status", "part", "phase").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("sec"), 4).alias("seconds"))


@query("q36_tau_by_unity", "lg sm st pub", f", {TAU} SELECT tt.grp, " + ", ".join(f"round(avg(its) FILTER (tau = {k} AND unity = {u}), 6) AS its_{k}_{u}" for k in range(3) for u in range(2)) + ", max(pub_its) AS pub_its FROM tt LEFT JOIN pub ON pub.grp = tt.grp GROUP BY tt.grp")
def q36(c):
    at = F.concat_ws("_", F.lit("its"), F.col("tau"), F.col("unity"))
    names = [f"its_{k}_{u}" for k in range(3) for u in range(2)]
    t = _by_tau(c).withColumn("at", at).groupBy("grp").pivot("at", names).agg(F.avg("its")).join(c.published, "grp", "left")
    return t.select("grp", *(_r(n) for n in names), "pub_its")


@query("q37_pairs", "lg sm", "SELECT a.grp, round(a.its_avg / nullif(b.its_avg, 0), 6) AS applications, a.its_max AS fixed_max, b.its_max AS adaptive_max, round(100 * b.t_solve / nullif(b.t_init + b.t_upd + b.t_solve, 0), 6) AS share FROM sm a JOIN sm b ON a.grp = b.grp AND a.mode = 'refactor' AND b.mode = 'auto'")
def q37(c):
    """Runs of two name patterns side by side."""
    a = c.runs.filter("mode = 'refactor'").select("grp", F.col("its_avg").alias("fixed"), F.col("its_max").alias("fixed_max"))
    b = c.runs.filter("mode = 'auto'")
    share = F.try_divide(100 * F.col("t_solve"), F.col("t_init") + F.col("t_upd") + F.col("t_solve"))
    return a.join(b, "grp").select("grp", _ratio("fixed", "its_avg").alias("applications"), "fixed_max", F.col("its_max").alias("adaptive_max"), _r(share).alias("share"))


@query("q38_both_unities", "lg sm st", f", {TAU} SELECT unity::INTEGER AS unity, tau, round(avg(its), 6) AS its, round(first_value(avg(its)) OVER (PARTITION BY unity ORDER BY tau) / nullif(avg(its), 0), 6) AS against_first FROM tt GROUP BY unity, tau")
def q38(c):
    t = _by_tau(c).groupBy("unity", "tau").agg(F.avg("its").alias("its"))
    first = F.first("its").over(Window.partitionBy("unity").orderBy("tau"))
    return t.select(F.col("unity").cast("int").alias("unity"), "tau", _r("its"), _ratio(first, F.col("its")).alias("against_first"))


@query("q39_krylov_details", "lg sm tm tp", """, i AS (SELECT run, min(iterations) AS its_min, max(iterations) AS its_max FROM lg GROUP BY run), r AS (SELECT grp, max(per_solve) FILTER (mode = 'off') AS o, max(per_solve) FILTER (mode = 'refactor') AS f FROM sm GROUP BY grp)
SELECT sm.run, its_min, i.its_max, round(its_avg, 6) AS its_avg, round(1000 * apply_local / nullif(its_avg * solves, 0), 6) AS local_ms, round(per_solve / nullif(o, 0), 6) AS vs_off, round(per_solve / nullif(f, 0), 6) AS vs_refactor FROM sm JOIN i ON i.run = sm.run LEFT JOIN tp ON tp.run = sm.run LEFT JOIN r ON r.grp = sm.grp""")
def q39(c):
    i = c.log.groupBy("run").agg(F.min("iterations").alias("its_min"))
    reference = c.runs.groupBy("grp").pivot("mode", ["off", "refactor"]).agg(F.max("per_solve"))
    t = c.runs.join(i, "run").join(c.phases, "run", "left").join(reference, "grp", "left")
    return t.select("run", "its_min", "its_max", _r("its_avg"), _ratio(1000 * F.col("apply_local"), F.col("its_avg") * F.col("solves")).alias("local_ms"), _ratio("per_solve", "off").alias("vs_off"), _ratio("per_solve", "refactor").alias("vs_refactor"))


@query("q41_warm_start_detail", "lg", """SELECT run, min(iterations) FILTER (corrector = 0) AS first_min, max(iterations) FILTER (corrector = 0) AS first_max, min(iterations) FILTER (corrector = 2) AS last_min, max(iterations) FILTER (corrector = 2) AS last_max,
 round(coalesce(sum(t_solve) FILTER (corrector = 2), 0) / nullif(sum(t_solve), 0), 6) AS last_share, max(decades) FILTER (corrector = 2) AS last_decades, round(sum(t_update) / (max(step) + 1), 6) AS update_per_step FROM lg GROUP BY run""")
def q41(c):
    at = lambda k, x: F.when(F.col("corrector") == k, F.col(x))
    return c.log.groupBy("run").agg(
        *(f(at(k, "iterations")).alias(f"{n}_{m}") for k, n in ((0, "first"), (2, "last")) for f, m in ((F.min, "min"), (F.max, "max"))),
        _r(F.try_divide(F.coalesce(F.sum(at(2, "t_solve")), F.lit(0.0)), F.sum("t_solve"))).alias("last_share"),
        F.max(at(2, "decades")).alias("last_decades"),
        _r(F.sum("t_update") / (F.max("step") + 1)).alias("update_per_step"),
    )


@query("q42_fastest_of_each", "lg sm ext", f", {BOTH}, m AS (SELECT run % 10 AS problem, min(cost) FILTER (code = 'own') AS own, min_by(run, cost) FILTER (code = 'own') AS own_run, min(cost) FILTER (code = 'external') AS external FROM bo GROUP BY problem) SELECT problem, round(own, 6) AS own, round(external, 6) AS external, round(external / nullif(own, 0), 6) AS ratio FROM m")
def q42(c):
    t = _both(c).groupBy((F.col("run") % 10).alias("problem")).pivot("code", ["own", "external"]).agg(F.min("cost"))
    return t.select("problem", _r("own"), _r("external"), _ratio("external", "own").alias("ratio"))


@query("q43_relative_to_reference", "lg sm", "SELECT grp, run, mode, round(t_upd / nullif(first_value(t_upd) OVER w, 0), 6) AS setup, round(t_solve / nullif(first_value(t_solve) OVER w, 0), 6) AS solve FROM sm WINDOW w AS (PARTITION BY grp ORDER BY mode = 'refactor' DESC, run)")
def q43(c):
    """Every variant against the reference row of its group."""
    by = Window.partitionBy("grp").orderBy(F.desc(F.col("mode") == "refactor"), "run")
    against = lambda x: _ratio(F.col(x), F.first(x).over(by))
    return c.runs.select("grp", "run", "mode", against("t_upd").alias("setup"), against("t_solve").alias("solve"))


@query("q44_unpivoted_phases", "lg sm", "SELECT np, run, mode, phase, round(s / solves, 6) AS seconds_per_step FROM (UNPIVOT (SELECT np, run, mode, solves, t_init, t_upd, t_solve FROM sm) ON t_init, t_upd, t_solve INTO NAME phase VALUE s)")
def q44(c):
    t = c.runs.unpivot(["np", "run", "mode", "solves"], ["t_init", "t_upd", "t_solve"], "phase", "s")
    return t.select("np", "run", "mode", "phase", _ratio("s", "solves").alias("seconds_per_step"))


@query("q45_advantage", "lg sm", """, x AS (SELECT grp, mode, max(its_avg) AS its, max(t_solve / solves / its_avg) AS each, max(t_upd / solves) AS upd, max(t_init / solves) AS init FROM sm GROUP BY grp, mode)
SELECT o.grp, round(o.its * o.each / nullif(a.its * o.each, 0), 6) AS iterations, round((o.its * o.each + o.upd) / nullif(a.its * a.each + a.upd, 0), 6) AS with_updates, round((o.its * o.each + o.upd + o.init) / nullif(a.its * a.each + a.upd + a.init, 0), 6) AS with_setup
 FROM x o JOIN x a ON o.grp = a.grp AND o.mode = 'off' AND a.mode = 'auto'""")
def q45(c):
    """Cumulative ratios: iterations alone, with the updates, with the setup."""
    per = lambda x: F.max(F.col(x) / F.col("solves"))
    x = c.runs.groupBy("grp", "mode").agg(F.max("its_avg").alias("its"), F.max(F.col("t_solve") / F.col("solves") / F.col("its_avg")).alias("each"), per("t_upd").alias("upd"), per("t_init").alias("init"))
    side = lambda m, s: x.filter(F.col("mode") == m).select("grp", *(F.col(n).alias(n + s) for n in ("its", "each", "upd", "init")))
    t = side("off", "_o").join(side("auto", "_a"), "grp")
    cost = lambda s, *more: sum((F.col(m + s) for m in more), F.col("its" + s) * F.col("each" + s))
    first = F.try_divide(F.col("its_o") * F.col("each_o"), F.col("its_a") * F.col("each_o"))
    return t.select("grp", _r(first).alias("iterations"), _ratio(cost("_o", "upd"), cost("_a", "upd")).alias("with_updates"), _ratio(cost("_o", "upd", "init"), cost("_a", "upd", "init")).alias("with_setup"))


@query("a12_coarse_statistics", "lg sm", "SELECT np, sum(n0)::BIGINT AS n0, min(n0) AS least, max(n0) AS most, round(avg(n0), 6) AS mean, count(*) FILTER (n0 > 150) AS large, count(*) FILTER (converged < solves) AS incomplete FROM sm GROUP BY np")
def a12(c):
    """Of the coarse dimension that each part (run) brings."""
    n0 = F.col("n0")
    return c.runs.groupBy("np").agg(F.sum(n0).alias("n0"), F.min(n0).alias("least"), F.max(n0).alias("most"), _r(F.avg(n0)).alias("mean"), F.count_if(n0 > 150).alias("large"), F.count_if(F.col("converged") < F.col("solves")).alias("incomplete"))


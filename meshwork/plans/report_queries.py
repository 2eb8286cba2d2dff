"""Reports over solve logs. The log is the events table read as one (sources.tables.solve_log): runs are grouped by
problem (grp) and differ in mode; each row is a solve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.algebra import lower_median
from ..sources import tables
from .policy import Policy, decisions

Q, S = {}, {}
LOG = """lg AS (SELECT user_id // 3 AS grp, ['off', 'refactor', 'auto'][user_id % 3 + 1] AS mode, user_id AS run, seq, seq // 3 AS step, seq % 3 AS corrector,
 CASE WHEN event_type = 'purchase' THEN 'rebuild' WHEN event_type IN ('view', 'click') THEN 'refactorize' ELSE 'reuse' END AS level, 5 + event_id % 40 AS iterations,
 round(value / 10, 4) AS t_update, value AS t_solve, 1 + event_id % 8 AS decades, event_type <> 'error' AS converged, 100 + user_id AS n0, [240, 336, 432][(user_id // 3) % 3 + 1]::BIGINT AS np, user_id % 5 AS kind
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events))"""


def query(name, sql):
    def keep(f):
        Q[name] = lambda spark, d: f(tables.solve_log(spark, d))
        S[name] = "WITH " + LOG + "\n" + sql
        return f

    return keep


def _sum(cond, value):
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))


def _n(cond):
    return F.count(F.when(cond, 1))


def so_far():
    return Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def summary(log: DataFrame) -> DataFrame:
    """One row for each run: counts and times by level (the first solve is the initial setup), iterations, cost of a solve."""
    later = F.col("seq") > 0
    t = log.groupBy("run", "grp", "mode").agg(
        F.count(F.lit(1)).alias("solves"),
        _n(F.col("converged")).alias("converged"),
        *(_n(later & (F.col("level") == lv)).alias(lv) for lv in ("reuse", "refactorize", "rebuild")),
        _sum(~later, F.col("t_update")).alias("t_init"),
        _sum(later, F.col("t_update")).alias("t_upd"),
        F.sum("t_solve").alias("t_solve"),
        F.avg("iterations").alias("its_avg"),
        F.max("iterations").alias("its_max"),
        F.min("n0").alias("n0"),
        F.min("np").alias("np"),
    )
    return t.withColumn("per_solve", (F.col("t_init") + F.col("t_upd") + F.col("t_solve")) / F.col("solves"))


SUMMARY = """sm AS (SELECT run, grp, mode, count(*) AS solves, count(*) FILTER (converged) AS converged, count(*) FILTER (seq > 0 AND level = 'reuse') AS reuse, count(*) FILTER (seq > 0 AND level = 'refactorize') AS refactorize,
 count(*) FILTER (seq > 0 AND level = 'rebuild') AS rebuild, coalesce(sum(t_update) FILTER (seq = 0), 0) AS t_init, coalesce(sum(t_update) FILTER (seq > 0), 0) AS t_upd, sum(t_solve) AS t_solve, avg(iterations) AS its_avg,
 max(iterations) AS its_max, min(n0) AS n0, min(np) AS np, (coalesce(sum(t_update), 0) + sum(t_solve)) / count(*) AS per_solve FROM lg GROUP BY run, grp, mode)"""


@query("q01_reuse_summary", ", " + SUMMARY + " SELECT run, solves, converged, reuse, refactorize, rebuild, round(t_init, 4) AS t_init, round(t_upd, 4) AS t_upd, round(t_solve, 4) AS t_solve, round(its_avg, 6) AS its_avg, its_max, n0, np, round(per_solve, 6) AS per_solve FROM sm")
def q01(log):
    return summary(log).select("run", "solves", "converged", "reuse", "refactorize", "rebuild", *(F.round(c, 4).alias(c) for c in ("t_init", "t_upd", "t_solve")), F.round("its_avg", 6).alias("its_avg"), "its_max", "n0", "np", F.round("per_solve", 6).alias("per_solve"))


@query("q02_speedup_over_off", ", " + SUMMARY + " SELECT s.run, s.grp, s.mode, round(o.per_solve / nullif(s.per_solve, 0), 6) AS speedup FROM sm s LEFT JOIN sm o ON s.grp = o.grp AND o.mode = 'off'")
def q02(log):
    t = summary(log)
    off = t.filter("mode = 'off'").select("grp", F.col("per_solve").alias("off"))
    return t.join(off, "grp", "left").select("run", "grp", "mode", F.round(F.try_divide("off", "per_solve"), 6).alias("speedup"))


@query("q03_update_time_by_level", "SELECT run, level, count(*) AS n, round(avg(t_update), 9) AS mean_update FROM lg WHERE seq > 0 GROUP BY run, level")
def q03(log):
    return log.filter("seq > 0").groupBy("run", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("t_update"), 9).alias("mean_update"))


@query("q04_robust_cost", """, lv AS (SELECT run, sum(m) AS upd FROM (SELECT run, level, count(*) * median(t_update) AS m FROM lg WHERE seq > 0 GROUP BY run, level) GROUP BY run)
SELECT run, round((coalesce(sum(t_update) FILTER (seq = 0), 0) + coalesce(any_value(upd), 0) + sum(iterations) * median(t_solve / iterations)) / count(*), 6) AS cost_median FROM lg LEFT JOIN lv USING (run) GROUP BY run""")
def q04(log):
    by_level = log.filter("seq > 0").groupBy("run", "level").agg((F.count(F.lit(1)) * F.median("t_update")).alias("m")).groupBy("run").agg(F.sum("m").alias("upd"))
    own = log.groupBy("run").agg(_sum(F.col("seq") == 0, F.col("t_update")).alias("init"), F.sum("iterations").alias("its"), F.median(F.col("t_solve") / F.col("iterations")).alias("each"), F.count(F.lit(1)).alias("n"))
    cost = (F.col("init") + F.coalesce("upd", F.lit(0.0)) + F.col("its") * F.col("each")) / F.col("n")
    return own.join(by_level, "run", "left").select("run", F.round(cost, 6).alias("cost_median"))


@query("q05_fresh_iterations", "SELECT run, round(avg(iterations), 6) AS its_fresh FROM lg WHERE seq = 0 OR level = 'rebuild' GROUP BY run")
def q05(log):
    return log.filter("seq = 0 OR level = 'rebuild'").groupBy("run").agg(F.round(F.avg("iterations"), 6).alias("its_fresh"))


@query("q08_change_against_reference", ", " + SUMMARY + " SELECT run, round(per_solve / nullif(first_value(per_solve) OVER (PARTITION BY grp ORDER BY mode = 'off' DESC, run), 0) - 1, 6) AS change FROM sm")
def q08(log):
    by = Window.partitionBy("grp").orderBy(F.desc(F.col("mode") == "off"), "run")
    return summary(log).select("run", F.round(scalars.relative_change(F.col("per_solve"), F.first("per_solve").over(by)), 6).alias("change"))


@query("q10_update_share", "SELECT run, round(median(t_solve) FILTER (seq > 0), 6) AS median_solve, round(sum(t_update) / nullif(sum(t_update + t_solve), 0), 6) AS update_share FROM lg GROUP BY run")
def q10(log):
    return log.groupBy("run").agg(F.round(F.median(F.when(F.col("seq") > 0, F.col("t_solve"))), 6).alias("median_solve"), F.round(F.try_divide(F.sum("t_update"), F.sum(F.col("t_update") + F.col("t_solve"))), 6).alias("update_share"))


@query("q13_incomplete_runs", "SELECT run, count(*) AS solves, count(*) FILTER (NOT converged) AS failed FROM lg GROUP BY run HAVING count(*) <> (max(step) + 1) * 3 OR count(*) FILTER (NOT converged) > 0")
def q13(log):
    t = log.groupBy("run").agg(F.count(F.lit(1)).alias("solves"), _n(~F.col("converged")).alias("failed"), F.max("step").alias("last"))
    return t.filter((F.col("solves") != (F.col("last") + 1) * 3) | (F.col("failed") > 0)).drop("last")


@query("q14_cost_matrix", ", " + SUMMARY + """ SELECT mode, round(avg(per_solve) FILTER (np = 240), 6) AS np240, round(avg(per_solve) FILTER (np = 336), 6) AS np336, round(avg(per_solve) FILTER (np = 432), 6) AS np432,
 round(avg(per_solve) FILTER (np = 240) / nullif(avg(per_solve) FILTER (np = 432), 0), 6) AS ratio FROM sm GROUP BY mode""")
def q14(log):
    t = summary(log).groupBy("mode").pivot("np", [240, 336, 432]).agg(F.avg("per_solve"))
    return t.select("mode", *(F.round(str(n), 6).alias(f"np{n}") for n in (240, 336, 432)), F.round(F.try_divide("240", "432"), 6).alias("ratio"))


@query("q15_parallel_efficiency", ", " + SUMMARY + ", c AS (SELECT mode, np, avg(per_solve) AS cost FROM sm GROUP BY mode, np) SELECT mode, np, round(first_value(cost * np) OVER (PARTITION BY mode ORDER BY np) / nullif(cost * np, 0), 6) AS efficiency FROM c")
def q15(log):
    c = summary(log).groupBy("mode", "np").agg(F.avg("per_solve").alias("cost"))
    first = F.first(F.col("cost") * F.col("np")).over(Window.partitionBy("mode").orderBy("np"))
    return c.select("mode", "np", F.round(F.try_divide(first, F.col("cost") * F.col("np")), 6).alias("efficiency"))


@query("q16_largest_residual", "SELECT mode, round(max(pow(10.0, -decades)), 9) AS max_residual, count(*) FILTER (NOT converged) AS not_converged FROM lg GROUP BY mode")
def q16(log):
    return log.groupBy("mode").agg(F.round(F.max(F.pow(F.lit(10.0), -F.col("decades"))), 9).alias("max_residual"), _n(~F.col("converged")).alias("not_converged"))


@query("q17_setup_anomaly", "SELECT run, round(sum(t_update) FILTER (seq = 0) / nullif(median(t_update) FILTER (seq > 0 AND level = 'rebuild'), 0), 6) AS ratio FROM lg GROUP BY run")
def q17(log):
    rebuild = F.median(F.when((F.col("seq") > 0) & (F.col("level") == "rebuild"), F.col("t_update")))
    return log.groupBy("run").agg(F.round(F.try_divide(F.sum(F.when(F.col("seq") == 0, F.col("t_update"))), rebuild), 6).alias("ratio"))


@query("q20_steady_steps", """, l AS (SELECT *, corrector = max(corrector) OVER (PARTITION BY run) AS is_last FROM lg)
SELECT run, round(sum(t_update + t_solve) / (max(step) + 1), 6) AS per_step, round(sum(t_update + t_solve) FILTER (step > 0) / greatest(max(step), 1), 6) AS steady_step,
 round(avg(iterations) FILTER (NOT is_last), 6) AS its_corrector, round(avg(iterations) FILTER (is_last), 6) AS its_last, min(iterations) FILTER (is_last) AS last_min, max(iterations) FILTER (is_last) AS last_max, round(median(decades) FILTER (step > 0 AND corrector = 0), 6) AS first_residual FROM l GROUP BY run""")
def q20(log):
    t = log.withColumn("is_last", F.col("corrector") == F.max("corrector").over(Window.partitionBy("run")))
    cost, last = F.col("t_update") + F.col("t_solve"), F.col("is_last")
    return t.groupBy("run").agg(
        F.round(F.sum(cost) / (F.max("step") + 1), 6).alias("per_step"),
        F.round(F.sum(F.when(F.col("step") > 0, cost)) / F.greatest(F.max("step"), F.lit(1)), 6).alias("steady_step"),
        F.round(F.avg(F.when(~last, F.col("iterations"))), 6).alias("its_corrector"),
        F.round(F.avg(F.when(last, F.col("iterations"))), 6).alias("its_last"),
        F.min(F.when(last, F.col("iterations"))).alias("last_min"),
        F.max(F.when(last, F.col("iterations"))).alias("last_max"),
        F.round(F.median(F.when((F.col("step") > 0) & (F.col("corrector") == 0), F.col("decades"))), 6).alias("first_residual"),
    )


@query("q21_best_variant", ", " + SUMMARY + ", ok AS (SELECT * FROM sm WHERE converged * 5 >= solves * 3) SELECT grp, arg_min(mode, (per_solve, run)) AS best, round(min(per_solve), 6) AS cost FROM ok GROUP BY grp")
def q21(log):
    ok = summary(log).filter("converged * 5 >= solves * 3")
    return ok.groupBy("grp").agg(F.min_by("mode", F.struct("per_solve", "run")).alias("best"), F.round(F.min("per_solve"), 6).alias("cost"))


@query("q22_phase_stack", """SELECT run, kind, phase, round(sum(v) / count(DISTINCT step), 6) AS seconds_per_step FROM (SELECT run, step, CASE WHEN corrector = 0 THEN 'first' WHEN corrector = 2 THEN 'last' ELSE 'middle' END AS kind, 'update' AS phase, t_update AS v FROM lg
 UNION ALL SELECT run, step, CASE WHEN corrector = 0 THEN 'first' WHEN corrector = 2 THEN 'last' ELSE 'middle' END, 'solve', t_solve FROM lg) GROUP BY run, kind, phase""")
def q22(log):
    kind = F.when(F.col("corrector") == 0, "first").when(F.col("corrector") == 2, "last").otherwise("middle")
    t = log.select("run", "step", kind.alias("kind"), F.col("t_update").alias("update"), F.col("t_solve").alias("solve")).unpivot(["run", "step", "kind"], ["update", "solve"], "phase", "v")
    return t.groupBy("run", "kind", "phase").agg(F.round(F.sum("v") / F.count_distinct("step"), 6).alias("seconds_per_step"))


@query("q26_regression_flags", ", " + SUMMARY + " SELECT a.grp, a.its_max AS before_max, b.its_max AS after_max, a.its_max IS DISTINCT FROM b.its_max AS changed FROM sm a JOIN sm b ON a.grp = b.grp AND a.mode = 'off' AND b.mode = 'auto'")
def q26(log):
    t = summary(log)
    a = t.filter("mode = 'off'").select("grp", F.col("its_max").alias("before_max"))
    b = t.filter("mode = 'auto'").select("grp", F.col("its_max").alias("after_max"))
    return a.join(b, "grp").withColumn("changed", ~F.col("before_max").eqNullSafe(F.col("after_max")))


@query("q27_groups_that_disagree", ", " + SUMMARY + " SELECT grp, count(*) AS variants, arg_min(mode, (per_solve, run)) AS best, round(max(per_solve) / nullif(min(per_solve), 0), 6) AS spread, count(DISTINCT its_max) > 1 AS its_differ FROM sm GROUP BY grp HAVING count(*) > 1")
def q27(log):
    t = summary(log).groupBy("grp").agg(F.count(F.lit(1)).alias("variants"), F.min_by("mode", F.struct("per_solve", "run")).alias("best"), F.round(F.try_divide(F.max("per_solve"), F.min("per_solve")), 6).alias("spread"), (F.count_distinct("its_max") > 1).alias("its_differ"))
    return t.filter("variants > 1")


@query("q29_display_status", ", " + SUMMARY + " SELECT run, CASE WHEN solves < 10 THEN 'T/O' WHEN converged < solves THEN 'n.c.' ELSE '' END AS shown FROM sm")
def q29(log):
    t = summary(log)
    return t.select("run", scalars.display_status(F.when(F.col("solves") < 10, "timeout").otherwise("ok"), F.col("converged") == F.col("solves")).alias("shown"))


@query("q33_strong_scaling", ", " + SUMMARY + ", c AS (SELECT np, sum(t_init + t_upd + t_solve) / count(*) AS t FROM sm GROUP BY np) SELECT np, round(first_value(t) OVER w * first_value(np) OVER w / t, 6) AS speedup, round(first_value(t) OVER w * first_value(np) OVER w / t / np, 6) AS efficiency FROM c WINDOW w AS (ORDER BY np)")
def q33(log):
    c = summary(log).groupBy("np").agg((F.sum(F.col("t_init") + F.col("t_upd") + F.col("t_solve")) / F.count(F.lit(1))).alias("t"))
    by = Window.orderBy("np")  # a row for each processor count
    speedup = F.first("t").over(by) * F.first("np").over(by) / F.col("t")
    return c.select("np", F.round(speedup, 6).alias("speedup"), F.round(speedup / F.col("np"), 6).alias("efficiency"))


@query("q40_effect_decomposition", ", " + SUMMARY + """, p AS (SELECT grp, max(its_avg) FILTER (mode = 'off') AS i0, max(its_avg) FILTER (mode = 'auto') AS i1, max(t_solve / solves / its_avg) FILTER (mode = 'off') AS e0, max(t_solve / solves / its_avg) FILTER (mode = 'auto') AS e1,
 max(t_init + t_upd) FILTER (mode = 'off') AS u0, max(t_init + t_upd) FILTER (mode = 'auto') AS u1 FROM sm GROUP BY grp)
SELECT grp, round(i0 / i1, 6) AS applications, round(e0 / nullif(e1, 0), 6) AS per_application, round(u0 / nullif(u1, 0), 6) AS setup FROM p WHERE i0 IS NOT NULL AND i1 IS NOT NULL""")
def q40(log):
    own = summary(log).withColumns({"each": F.col("t_solve") / F.col("solves") / F.col("its_avg"), "setup": F.col("t_init") + F.col("t_upd")})
    p = own.groupBy("grp").pivot("mode", ["off", "auto"]).agg(F.max("its_avg").alias("its"), F.max("each").alias("each"), F.max("setup").alias("setup"))
    ratio = lambda c: F.round(F.try_divide(f"off_{c}", f"auto_{c}"), 6)
    return p.filter("off_its IS NOT NULL AND auto_its IS NOT NULL").select("grp", ratio("its").alias("applications"), ratio("each").alias("per_application"), ratio("setup").alias("setup"))


@query("q46_health", ", " + SUMMARY + " SELECT count(*) AS runs, sum(solves)::BIGINT AS solves, sum(converged)::BIGINT AS converged, count(*) FILTER (converged < solves) AS runs_not_ok FROM sm")
def q46(log):
    return summary(log).agg(F.count(F.lit(1)).alias("runs"), F.sum("solves").alias("solves"), F.sum("converged").alias("converged"), _n(F.col("converged") < F.col("solves")).alias("runs_not_ok"))


@query("q47_two_baselines", ", " + SUMMARY + " SELECT run, round(per_solve / nullif(max(per_solve) FILTER (mode = 'off') OVER (PARTITION BY grp), 0), 6) AS vs_off, round(per_solve / nullif(max(per_solve) FILTER (mode = 'refactor') OVER (PARTITION BY grp), 0), 6) AS vs_refactor FROM sm")
def q47(log):
    by = Window.partitionBy("grp")
    against = lambda m: F.round(F.try_divide(F.col("per_solve"), F.max(F.when(F.col("mode") == m, F.col("per_solve"))).over(by)), 6)
    return summary(log).select("run", against("off").alias("vs_off"), against("refactor").alias("vs_refactor"))


@query("j16_two_codes", ", " + SUMMARY + " SELECT coalesce(a.grp, b.grp) AS grp, round(a.per_solve, 6) AS own, round(b.per_solve, 6) AS other, round(b.per_solve / nullif(a.per_solve, 0), 6) AS ratio FROM (SELECT * FROM sm WHERE mode = 'auto') a FULL JOIN (SELECT * FROM sm WHERE mode = 'off') b ON a.grp = b.grp")
def j16(log):
    t = summary(log)
    one = lambda m, c: t.filter(F.col("mode") == m).select("grp", F.col("per_solve").alias(c))
    both = one("auto", "own").join(one("off", "other"), "grp", "full_outer")
    return both.select("grp", F.round("own", 6).alias("own"), F.round("other", 6).alias("other"), F.round(F.try_divide("other", "own"), 6).alias("ratio"))


@query("w04_cumulative_time", "SELECT run, seq, round(sum(t_update + t_solve) OVER (PARTITION BY run ORDER BY seq), 4) AS so_far FROM lg")
def w04(log):
    return log.select("run", "seq", F.round(F.sum(F.col("t_update") + F.col("t_solve")).over(so_far()), 4).alias("so_far"))


@query("w06_wasted_time", """, e AS (SELECT *, sum((level = 'rebuild')::INT) OVER (PARTITION BY run ORDER BY seq) AS epoch, iterations::DOUBLE / decades AS q FROM lg),
 r AS (SELECT *, first_value(q) OVER (PARTITION BY run, epoch, kind ORDER BY seq) AS ref FROM e)
SELECT run, seq, round(sum(greatest(iterations - ref * decades, 0) * t_solve / iterations) OVER (PARTITION BY run, epoch ORDER BY seq), 6) AS wasted, count(*) FILTER (level = 'refactorize') OVER (PARTITION BY run, epoch ORDER BY seq) AS age FROM r""")
def w06(log):
    """The reuse policy's waste and age as windows: since the last rebuild, against the first solve of each kind after it."""
    t = log.withColumns({"epoch": F.sum((F.col("level") == "rebuild").cast("int")).over(so_far()), "q": F.col("iterations") / F.col("decades")})
    t = t.withColumn("ref", F.first("q").over(Window.partitionBy("run", "epoch", "kind").orderBy("seq")))
    by = Window.partitionBy("run", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    excess = F.greatest(F.col("iterations") - F.col("ref") * F.col("decades"), F.lit(0.0)) * F.col("t_solve") / F.col("iterations")
    return t.select("run", "seq", F.round(F.sum(excess).over(by), 6).alias("wasted"), F.count(F.when(F.col("level") == "refactorize", 1)).over(by).alias("age"))


@query("w08_newest_run", ", " + SUMMARY + " SELECT np, mode, max(run) AS run, arg_max(solves, run) AS solves FROM sm GROUP BY np, mode")
def w08(log):
    return summary(log).groupBy("np", "mode").agg(F.max("run").alias("run"), F.max_by("solves", "run").alias("solves"))


@query("w09_first_correctors", "SELECT run, string_agg(iterations::VARCHAR || CASE WHEN level = 'rebuild' AND step > 0 THEN 'R' ELSE '' END, ' ' ORDER BY seq) AS sequence FROM lg WHERE corrector = 0 GROUP BY run")
def w09(log):
    mark = F.concat(F.col("iterations").cast("string"), F.when((F.col("level") == "rebuild") & (F.col("step") > 0), "R").otherwise(""))
    return log.filter("corrector = 0").groupBy("run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", mark.alias("mark")))), lambda x: x.mark), " ").alias("sequence"))


@query("a13_timer_report", "SELECT phase, round(min(v), 6) AS min, round(avg(v), 6) AS avg, round(max(v), 6) AS max FROM (SELECT level || '.update' AS phase, run, sum(t_update) AS v FROM lg GROUP BY ALL UNION ALL SELECT level || '.solve', run, sum(t_solve) FROM lg GROUP BY ALL) GROUP BY phase")
def a13(log):
    own = log.groupBy("level", "run").agg(F.sum("t_update").alias("update"), F.sum("t_solve").alias("solve")).unpivot(["level", "run"], ["update", "solve"], "part", "v")
    return own.groupBy(F.concat_ws(".", "level", "part").alias("phase")).agg(*(F.round(f("v"), 6).alias(n) for f, n in ((F.min, "min"), (F.avg, "avg"), (F.max, "max"))))


@query("a17_lower_median", "SELECT run, level, percentile_disc(0.5) WITHIN GROUP (ORDER BY t_update) AS lower_median FROM lg GROUP BY run, level")
def a17(log):
    return log.groupBy("run", "level").agg(lower_median("t_update").alias("lower_median"))


@query("a18_loop_summary", "SELECT level, count(*) FILTER (seq > 0) AS n, round(coalesce(sum(t_update) FILTER (seq > 0), 0), 4) AS t_update, max(iterations) AS its_max, round(avg(iterations), 6) AS its_avg FROM lg GROUP BY level")
def a18(log):
    later = F.col("seq") > 0
    return log.groupBy("level").agg(_n(later).alias("n"), F.round(_sum(later, F.col("t_update")), 4).alias("t_update"), F.max("iterations").alias("its_max"), F.round(F.avg("iterations"), 6).alias("its_avg"))


@query("t06_rebuild_premium", """, m AS (SELECT run, percentile_disc(0.5) WITHIN GROUP (ORDER BY t_update) FILTER (level = 'rebuild' AND t_update > 0) AS reb, percentile_disc(0.5) WITHIN GROUP (ORDER BY t_update) FILTER (level = 'refactorize' AND t_update > 0) AS ref FROM lg GROUP BY run)
SELECT run, round(CASE WHEN reb IS NULL THEN 0 ELSE greatest(0, reb - coalesce(ref, 0)) END, 6) AS premium FROM m""")
def t06(log):
    some = log.filter("t_update > 0").groupBy("run").pivot("level", ["rebuild", "refactorize"]).agg(lower_median("t_update"))
    premium = F.when(F.col("rebuild").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("rebuild") - F.coalesce("refactorize", F.lit(0.0))))
    return log.select("run").distinct().join(some, "run", "left").select("run", F.round(premium, 6).alias("premium"))


POLICY_SQL = """, sv AS (SELECT run, mode, seq, corrector = 0 AS changed, iterations, decades, converged, t_update, t_solve, corrector AS kind FROM lg),
 st AS (SELECT run, -1::BIGINT AS seq, NULL::VARCHAR AS level, 0 AS age, 0.0::DOUBLE AS wasted, 0.0::DOUBLE AS premium, true AS sound, 0.0::DOUBLE AS rate, 0.0::DOUBLE AS reference, [0, 0, 0]::DOUBLE[] AS refs, []::DOUBLE[] AS reb, []::DOUBLE[] AS rfc FROM (SELECT DISTINCT run FROM sv)
 UNION ALL
 SELECT run, n, lv, CASE lv WHEN 'rebuild' THEN 0 WHEN 'refactorize' THEN age + 1 ELSE age END, w0 + CASE WHEN own > 0 THEN greatest(iterations - own * decades, 0.0) * t_solve / iterations ELSE 0.0 END, prem, converged, iterations / decades, CASE WHEN own > 0 THEN own ELSE iterations / decades END,
  CASE WHEN own > 0 THEN refs0 ELSE list_transform(refs0, lambda x, i: CASE WHEN i = kind + 1 THEN iterations / decades ELSE x END) END, CASE WHEN lv = 'rebuild' AND t_update > 0 THEN list_append(reb, t_update) ELSE reb END, CASE WHEN lv = 'refactorize' AND t_update > 0 THEN list_append(rfc, t_update) ELSE rfc END
 FROM (SELECT *, refs0[kind + 1] AS own FROM (SELECT *, CASE WHEN lv = 'rebuild' THEN 0.0 ELSE wasted END AS w0, CASE WHEN lv = 'rebuild' THEN [0, 0, 0]::DOUBLE[] ELSE refs END AS refs0
 FROM (SELECT *, CASE WHEN seq < 0 OR mode = 'off' OR (mode = 'auto' AND changed AND (NOT sound OR (prem > 0 AND wasted >= prem) OR (reference > 0 AND rate > 4 * reference))) THEN 'rebuild' WHEN changed THEN 'refactorize' ELSE 'reuse' END AS lv
 FROM (SELECT st.*, sv.seq AS n, mode, changed, iterations, decades, converged, t_update, t_solve, kind, CASE WHEN len(reb) > 0 THEN greatest(list_sort(reb)[(len(reb) + 1) // 2] - coalesce(list_sort(rfc)[(len(rfc) + 1) // 2], 0.0), 0.0) ELSE 0.0 END AS prem FROM st JOIN sv ON sv.run = st.run AND sv.seq = st.seq + 1)))))
SELECT run, seq, level, age, round(wasted, 6) AS wasted, round(premium, 6) AS premium FROM st WHERE seq >= 0"""


@query("t04_reuse_policy", POLICY_SQL)
def t04(log):
    """What the policy would have decided for each solve, with the matrix new in each step; correctors are kinds of solves."""
    solves = log.select("run", "mode", "seq", (F.col("corrector") == 0).alias("changed"), "iterations", "decades", "converged", "t_update", "t_solve", F.col("corrector").alias("kind"))
    return decisions(solves, Policy(), "mode").select("run", "seq", "level", "age", F.round("wasted", 6).alias("wasted"), F.round("premium", 6).alias("premium"))


S["t04_reuse_policy"] = S["t04_reuse_policy"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("o05_mode_order", ", " + SUMMARY + " SELECT grp, run, row_number() OVER (PARTITION BY grp ORDER BY CASE mode WHEN 'off' THEN 0 WHEN 'refactor' THEN 1 WHEN 'auto' THEN 2 ELSE 3 END, mode, run) AS place FROM sm")
def o05(log):
    rank = F.when(F.col("mode") == "off", 0).when(F.col("mode") == "refactor", 1).when(F.col("mode") == "auto", 2).otherwise(3)
    return summary(log).select("grp", "run", F.row_number().over(Window.partitionBy("grp").orderBy(rank, "mode", "run")).cast("long").alias("place"))


@query("u04_common_runs", "SELECT grp FROM lg WHERE mode = 'off' INTERSECT SELECT grp FROM lg WHERE mode = 'auto'")
def u04(log):
    return log.filter("mode = 'off'").select("grp").intersect(log.filter("mode = 'auto'").select("grp"))


@query("f12_level_maps", "SELECT run, count(DISTINCT level) AS levels, count(*) FILTER (level = 'reuse') AS reuse, count(*) FILTER (level = 'refactorize') AS refactorize, count(*) FILTER (level = 'rebuild') AS rebuild FROM lg GROUP BY run")
def f12(log):
    """Each run's solves by level as a map, and what is looked up in it."""
    maps = log.groupBy("run", "level").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("by"))
    of = lambda name: F.coalesce(F.try_element_at("by", F.lit(name)), F.lit(0).cast("long")).alias(name)
    return maps.select("run", F.size("by").cast("long").alias("levels"), of("reuse"), of("refactorize"), of("rebuild"))


@query("f04_per_decade", "SELECT run, seq, round(iterations / log10(1 / pow(10.0, -decades)), 6) AS per_decade, CASE WHEN t_solve >= 100 THEN 0 WHEN t_solve >= 10 THEN 1 WHEN t_solve >= 1 THEN 2 ELSE 3 END AS digits FROM lg")
def f04(log):
    reduction = F.pow(F.lit(10.0), -F.col("decades"))
    shown = scalars.adaptive_number(F.col("t_solve"))
    digits = F.when(F.instr(shown, ".") == 0, 0).otherwise(F.length(shown) - F.instr(shown, "."))
    return log.select("run", "seq", F.round(scalars.per_decade(F.col("iterations"), reduction), 6).alias("per_decade"), digits.alias("digits"))

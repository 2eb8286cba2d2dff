"""Round trips through the file formats: each query writes a table in a format into the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions import scalars
from ..operators import algebra
from ..sources import campaign, matrix_market, tables
from .matrix_queries import CTE
from .report_queries import LOG, SUMMARY, summary
from .store import shared_dir

Q, S = {}, {}


def query(name, sql):
    def keep(f):
        Q[name], S[name] = f, sql
        return f

    return keep


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Ends a log in a file of many.
END = "\x1e"


def _lines(df, name: str, *lines) -> str:
    """One folder of text with a log for each row of df: its `run`, then the lines (columns) in order; the folder's path."""
    path = _place(df.sparkSession, name)
    df.select(F.concat_ws("\n", F.concat(F.lit("run "), F.col("run").cast("string")), *lines).alias("value")).write.option("lineSep", END).text(path)
    return path


def _logs(spark, path: str):
    """run and value (the log's text after its first line) of such a folder."""
    raw = spark.read.option("lineSep", END).text(path)
    return raw.select(F.regexp_extract("value", r"^run (\d+)\n", 1).cast("long").alias("run"), F.regexp_replace("value", r"^run \d+\n", "").alias("value"))


@query("s01_matrix_file", "SELECT l_orderkey AS row, l_partkey AS col, sum(l_quantity) AS val FROM lineitem GROUP BY ALL HAVING sum(l_quantity) <> 0")
def s01(spark, d):
    """K-01 and S-01: the orders' matrix as a coordinate file and back."""
    a, path = tables.order_part(spark, d), _place(spark, "matrix")
    size = a.agg(F.max("row"), F.max("col")).first()
    matrix_market.write_matrix(a, size[0] + 1, size[1] + 1, path)
    return matrix_market.read_matrix(spark, path)[0]


@query("s02_banner", "SELECT count(*) + 2 AS lines, count(*) AS entries, max(l_orderkey) + 1 AS nrows, max(l_partkey) + 1 AS ncols FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def s02(spark, d):
    """The banner and the sizes of such a file, and its lines."""
    a, path = tables.order_part(spark, d), _place(spark, "matrix")
    size = a.agg(F.max("row"), F.max("col")).first()
    matrix_market.write_matrix(a, size[0] + 1, size[1] + 1, path)
    back, nrows, ncols = matrix_market.read_matrix(spark, path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines")).crossJoin(back.agg(F.count(F.lit(1)).alias("entries"))).select("lines", "entries", F.lit(nrows).cast("long").alias("nrows"), F.lit(ncols).cast("long").alias("ncols"))


@query("s03_vector_file", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_acctbal AS val FROM customer")
def s03(spark, d):
    """K-02 and S-03: the balances as an array file, in the keys' order."""
    x, path = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("val")), _place(spark, "vector")
    matrix_market.write_vector(x, path)
    return matrix_market.read_vector(spark, path)


@query("s05_step_files", "SELECT l_linenumber::BIGINT AS step, count(DISTINCT (l_orderkey, l_partkey)) AS entries FROM lineitem GROUP BY l_linenumber")
def s05(spark, d):
    """A matrix file for each step (a line's number in its order, of which there are few), found by its pattern."""
    pattern, out = _place(spark, "steps") + "/a_%04d", None
    lines = tables.table(spark, d, "lineitem")
    for (step,) in lines.select("l_linenumber").distinct().orderBy("l_linenumber").collect():
        a = lines.filter(F.col("l_linenumber") == step).groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))
        matrix_market.write_matrix(a, 1, 1, matrix_market.step_file(pattern, step))
        back = matrix_market.read_matrix(spark, matrix_market.step_file(pattern, step))[0].agg(F.count(F.lit(1)).alias("entries")).select(F.lit(step).cast("long").alias("step"), "entries")
        out = back if out is None else out.union(back)
    return out


@query("s20_log_file", "WITH " + LOG + " SELECT run::BIGINT AS run, seq, level, iterations, t_solve, NULL::DOUBLE AS true_residual, 7::BIGINT AS n0 FROM lg")
def s20(spark, d):
    """K-03, K-06 and S-20: the log as CSV rows, appended in two parts, read with a column that it lacks and a default."""
    log, path = tables.solve_log(spark, d), _place(spark, "log")
    for half in (0, 1):
        campaign.append_rows(log.filter(F.col("run") % 2 == half).select(F.col("run").alias("own_run"), "seq", "level", "iterations", "t_solve"), path)
    kind = _parse_datatype_string("own_run long, seq long, level string, iterations long, t_solve double, true_residual double, n0 long")
    return campaign.read_log(spark, path, kind, {"n0": 7}).drop("run").withColumnRenamed("own_run", "run")


@query("s21_settings_file", "SELECT c_custkey AS run, unnest(['N', 'NP', 'OPTS']) AS key, unnest([c_nationkey::VARCHAR || ' 64', (c_custkey % 5)::VARCHAR, '']) AS setting FROM customer")
def s21(spark, d):
    c = tables.table(spark, d, "customer").withColumn("run", F.col("c_custkey"))
    line = F.format_string("N='%d 64' NP=%d OPTS=''", F.col("c_nationkey").cast("long"), (F.col("c_custkey") % 5).cast("long"))
    return campaign.parse_settings(_logs(spark, _lines(c, "settings", line, F.lit("# end")))).select("run", "key", "setting")


@query("s22_status_file", "SELECT 'r' || c_custkey AS name, (c_custkey % 8)::INTEGER AS np, CASE WHEN c_custkey % 3 = 0 THEN 'timeout' ELSE 'ok' END AS status, c_acctbal AS wall FROM customer")
def s22(spark, d):
    c, path = tables.table(spark, d, "customer"), _place(spark, "status")
    status = F.when(F.col("c_custkey") % 3 == 0, "timeout").otherwise("ok")
    rows = c.select(F.concat_ws("  ", F.concat(F.lit("r"), F.col("c_custkey").cast("string")), (F.col("c_custkey") % 8).cast("string"), status, F.col("c_acctbal").cast("string"), F.lit("0")).alias("value"))
    rows.union(spark.createDataFrame([("# name np status wall",), ("short line",)], "value string")).write.text(path)
    return campaign.read_status(spark, path)


@query("s23_timer_table", "SELECT user_id AS run, event_type AS timer, min(value) AS min, round(avg(value), 6) AS avg, max(value) AS max FROM events GROUP BY ALL")
def s23(spark, d):
    """Logs with a table of timers at their end, an older one before it."""
    t = tables.table(spark, d, "events").groupBy(F.col("user_id").alias("run"), "event_type").agg(F.min("value").alias("lo"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("hi"))
    row = F.concat_ws(" ", "event_type", *(F.col(c).cast("string") for c in ("lo", "mean", "hi")))
    runs = t.groupBy("run").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("rows"))
    head = F.lit("phase   min  avg  max")
    path = _lines(runs, "timers", F.lit("start"), head, F.lit("old 1 2 3"), F.lit(""), head, F.col("rows"), F.lit("end of the log"))
    lines = _logs(spark, path).select("run", F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    return campaign.parse_timers(lines).select("run", "timer", "min", "avg", "max")


@query("s24_log_facts", "SELECT o_custkey AS run, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS true_residual, NULL::DOUBLE AS nnz FROM orders GROUP BY o_custkey")
def s24(spark, d):
    o = tables.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    path = _lines(o, "facts", F.format_string("system of n = %d", "n"), F.concat(F.lit("true residual "), F.col("total").cast("string"), F.lit(" done")))
    return campaign.parse_facts(_logs(spark, path), {"n": rf"n = ({campaign.NUMBER})", "true_residual": rf"residual ({campaign.NUMBER})", "nnz": r"nnz (\d+)"}).select("run", "n", "true_residual", "nnz")


@query("s25_history_file", "SELECT event_id::INTEGER AS k, round(value / 1000, 8) AS rel_res FROM events")
def s25(spark, d):
    """K-04 and S-25: a residual history with ten digits."""
    e, path = tables.table(spark, d, "events"), _place(spark, "history")
    campaign.history_lines(e.select(F.col("event_id").alias("k"), (F.col("value") / 1000).alias("v"))).write.text(path)
    return campaign.read_history(spark, path).select("k", F.round("rel_res", 8).alias("rel_res"))


@query("s26_variants_file", "SELECT n_nationkey::INTEGER AS place, 'v' || n_nationkey AS name, '--np ' || n_regionkey AS options FROM nation")
def s26(spark, d):
    n, path = tables.table(spark, d, "nation"), _place(spark, "variants")
    line = F.concat(F.lit("v"), F.col("n_nationkey").cast("string"), F.lit("   --np "), F.col("n_regionkey").cast("string"))
    one = n.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x.line), "\n").alias("body"))  # a row for each nation
    one.select(F.concat(F.lit("# variants\n\n"), "body").alias("value")).write.text(path)
    return campaign.read_variants(spark, path)


@query("k08_summary_and_phases", "WITH " + LOG + " SELECT run, np, 'update' AS timer, round(sum(t_update), 4) AS seconds FROM lg GROUP BY run, np UNION ALL SELECT run, np, 'solve', round(sum(t_solve), 4) FROM lg GROUP BY run, np")
def k08(spark, d):
    """phases.csv: a row for each run, process count and timer, appended and read back."""
    log, path = tables.solve_log(spark, d), _place(spark, "phases")
    t = log.groupBy("run", "np").agg(F.round(F.sum("t_update"), 4).alias("update"), F.round(F.sum("t_solve"), 4).alias("solve"))
    campaign.append_rows(t.unpivot(["run", "np"], ["update", "solve"], "timer", "seconds"), path)
    return spark.read.option("header", True).schema("run long, np long, timer string, seconds double").csv(path)


@query("k08_summary_file", "WITH " + LOG + ", " + SUMMARY + " SELECT run, np, solves, converged, rebuild, refactorize, round(per_solve, 6) AS per_solve FROM sm")
def k08_summary(spark, d):
    """summary.csv: a row for each run, appended and read back."""
    path, kind = _place(spark, "summary"), _parse_datatype_string("run long, np long, solves long, converged long, rebuild long, refactorize long, per_solve double")
    rows = summary(tables.solve_log(spark, d)).withColumn("per_solve", F.round("per_solve", 6))
    campaign.append_rows(rows.select(*kind.fieldNames()), path)
    return spark.read.option("header", True).schema(kind).csv(path)


@query("k09_markdown", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS at, '| ' || c_custkey || ' | ' || upper(c_nationkey::VARCHAR || 'n') || ' | ' || format('{:.3f}', c_acctbal) || ' |' AS line FROM customer")
def k09(spark, d):
    """The lines of a Markdown table of all customers, without its head."""
    c = tables.table(spark, d, "customer").select("c_custkey", F.upper(F.concat(F.col("c_nationkey").cast("string"), F.lit("n"))).alias("nation"), "c_acctbal")
    return campaign.markdown(c, "c_custkey").filter("at >= 0")


@query("s19_loaded_problem", f"WITH {CTE['sys']}, b AS (SELECT row, sum(val * (1 + col % 7)) AS val FROM a GROUP BY row) SELECT max(row) + 1 AS n, count(*) AS entries, true AS symmetric, (SELECT round(sum(val), 6) FROM b) AS rhs_total, (SELECT count(*) FILTER (val <> 0) FROM b) AS given FROM a")
def s19(spark, d):
    """K-07, S-18 and S-19: a generated system as a pair of files, loaded with the checks of sizes and symmetry."""
    a, folder = tables.order_chain(spark, d), _place(spark, "system")
    x = tables.known_solution(tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("idx")))
    matrix_market.write_problem(a, algebra.spmv(a, x), folder)
    p = matrix_market.load_problem(spark, f"{folder}/matrix", f"{folder}/rhs")
    one = p.matrix.agg(F.count(F.lit(1)).alias("entries")).crossJoin(p.rhs.agg(F.round(F.sum("val"), 6).alias("rhs_total"), F.count(F.when(F.col("val") != 0, 1)).alias("given")))  # one row each
    return one.select(F.lit(p.n).cast("long").alias("n"), "entries", F.lit(p.symmetric).alias("symmetric"), "rhs_total", "given")


@query("f_scalars", """SELECT event_id, isfinite(value / nullif(event_id % 3, 0)) IS TRUE AS finite, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS truth, sqrt(value * value + user_id * user_id) AS modulus,
 CASE WHEN event_id % 2 = 0 THEN value END AS strict, CASE event_id % 4 WHEN 0 THEN 'T/O' WHEN 1 THEN 'ERR' WHEN 2 THEN 'n.c.' ELSE '' END AS shown FROM events""")
def scalar_functions(spark, d):
    """F-02, F-03, F-06 to F-09 over the events."""
    e, i = tables.table(spark, d, "events"), F.col("event_id")
    word = F.when(F.col("event_type") == "purchase", " Yes").when(F.col("event_type") == "error", "OFF").otherwise("maybe")
    text = F.when(i % 2 == 0, F.col("value").cast("string")).otherwise(F.concat(F.col("value").cast("string"), F.lit("s")))
    status = F.when(i % 4 == 0, "timeout").when(i % 4 == 1, "error").when(i % 4 == 2, "not_converged").otherwise("ok")
    return e.select("event_id", scalars.is_finite(F.try_divide("value", i % 3)).alias("finite"), scalars.truth(word).alias("truth"), scalars.modulus(F.col("value"), F.col("user_id")).alias("modulus"), scalars.strict_number(text).alias("strict"), scalars.display_status(status, F.lit(True)).alias("shown"))

"""One solve from files to an answer, with an exit status: options, loading, partition, checks, setup, solve, report."""

from __future__ import annotations

import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decompose, partition
from ..sources import campaign, matrix_market
from .schwarz import Config, Schwarz, agreed, local_checks, solve
from .store import written

#: Exit statuses.
CONVERGED, FAILED, NOT_CONVERGED = 0, 1, 2
OWN = {"matrix": str, "rhs": str, "seed": int, "step": int, "block": int, "parts": int, "solution": str, "csv": str}


def parsed(args: list[str]) -> tuple[dict, Config]:
    """The driver's own options and the solver's; unknown ones and wrong values raise an error."""
    own, rest, at = {"rhs": "ones", "seed": matrix_market.SEED, "step": 0, "block": 1, "parts": 1}, [], 0
    while at < len(args):
        key, eq, value = args[at].removeprefix("--").partition("=")
        if args[at].startswith("--") and key in OWN:
            if not eq:
                at += 1
                if at == len(args):
                    raise ValueError(f"option --{key} has no value")
                value = args[at]
            own[key] = OWN[key](value)
        else:
            rest.append(args[at])
        at += 1
    if "matrix" not in own:
        raise ValueError("--matrix is missing")
    if own["parts"] < 1:
        raise ValueError("--parts must be positive")
    return own, Config.from_options(rest)


def solved(spark: SparkSession, own: dict, config: Config) -> tuple[DataFrame, dict]:
    """The solution in the matrix's own order, and the report's figures. A subdomain whose factorization fails stops the
    solve for all, with the parts that failed in the error."""
    p = matrix_market.load_problem(spark, own["matrix"], own["rhs"], own["step"], own["block"], own["seed"])
    a, b = written(p.matrix, "matrix"), written(p.rhs, "rhs")
    parts = written(partition.graph_partition(a, b.select("idx"), own["parts"], p.block), "partition")
    start = time.perf_counter()
    fallbacks = 0
    if config.one_level != "none" and config.local_solver == "exact":
        members = written(decompose.membership(a, parts, config.unity), "members")
        checks, failed, fallbacks = agreed(local_checks(a, members, p.symmetric, config.single))
        if failed:
            some = [r.part for r in checks.filter("NOT ok").orderBy("part").limit(10).collect()]
            raise ValueError(f"the factorizations of {failed} subdomains failed, among them {some}")
    m = Schwarz(a, parts, config, p.symmetric)
    t_setup, start = time.perf_counter() - start, time.perf_counter()
    r = solve(a, b, m, config)
    figures = {"n": p.n, "parts": own["parts"], "iterations": r.iterations, "converged": bool(r.converged), "rel_res": float(r.history[-1] / r.history[0]) if r.history[0] else 0.0, "fallbacks": fallbacks, "t_setup": t_setup, "t_solve": time.perf_counter() - start}
    return r.x, figures


def main(spark: SparkSession, args: list[str]) -> int:
    """0: converged, 2: not converged, 1: anything else went wrong, which is said on the error stream."""
    try:
        own, config = parsed(args)
        x, figures = solved(spark, own, config)
        print(" ".join(f"{k}={v:.6g}" if isinstance(v, float) else f"{k}={v}" for k, v in figures.items()))
        if "solution" in own:
            every = spark.range(figures["n"]).select(F.col("id").alias("idx"))
            matrix_market.write_vector(every.join(x, "idx", "left").select("idx", F.coalesce("val", F.lit(0.0)).alias("val")), own["solution"])
        if "csv" in own:
            campaign.append_rows(spark.createDataFrame([tuple(figures.values())], "n long, parts int, iterations int, converged boolean, rel_res double, fallbacks int, t_setup double, t_solve double"), own["csv"])
        return CONVERGED if figures["converged"] else NOT_CONVERGED
    except (ValueError, OSError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return FAILED

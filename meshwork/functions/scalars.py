"""Scalar functions of run reports, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def per_decade(iterations: Column, reduction: Column) -> Column:
    """Iterations for each factor of ten of the residual; 0 where that has no meaning."""
    fine = (iterations > 0) & (reduction > 0) & (reduction < 1)
    return F.when(fine, iterations / F.log10(1.0 / reduction)).otherwise(0.0)


def adaptive_number(x: Column) -> Column:
    """Fewer digits for larger numbers; `-` for null."""
    size = F.abs(x)
    digits = F.when(size >= 100, F.format_string("%.0f", x)).when(size >= 10, F.format_string("%.1f", x)).when(size >= 1, F.format_string("%.2f", x)).otherwise(F.format_string("%.3f", x))
    return F.when(is_finite(x), digits).otherwise("-")


def relative_change(x: Column, reference: Column) -> Column:
    """x over reference - 1; null where either is missing or the reference is zero."""
    return F.when(is_finite(x) & is_finite(reference) & (reference != 0), x / reference - 1)


def truth(text: Column) -> Column:
    """1/true/yes/on and 0/false/no/off in any case; null for anything else."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False)


def strict_number(text: Column) -> Column:
    """A number if the whole text is one; else null."""
    return F.when(text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), text.try_cast("double"))


def display_status(status: Column, converged: Column) -> Column:
    return F.when(status == "timeout", "T/O").when(status == "error", "ERR").when((status == "not_converged") | (converged == F.lit(False)), "n.c.").otherwise("")


def modulus(re: Column, im: Column) -> Column:
    return F.hypot(re, im)

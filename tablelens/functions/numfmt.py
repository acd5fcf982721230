"""Significant-digit rounding, identical in Spark and in the DuckDB oracle.

Floating aggregates computed by two engines differ in the last bits (summation
order); rounding the mantissa to a fixed number of significant digits makes the
two results bit-identical except at rounding boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIG_DIGITS = 8


def sig(c: Column | str, digits: int = SIG_DIGITS) -> Column:
    if isinstance(c, str) and "." not in c and "`" not in c:
        # one parsed SQL expression instead of a dozen client-side column operations
        x = f"CAST(`{c}` AS DOUBLE)"
        p = f"power(10, floor(log10(abs({x}))))"
        return F.expr(f"CASE WHEN {x} IS NULL OR {x} = 0 OR isnan({x}) THEN {x} "
                      f"ELSE round({x} / {p} * {_scale(digits)}, 0) / {_scale(digits)} * {p} END")
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    s = F.lit(float(10 ** (digits - 1)))
    return F.when(x.isNull() | (x == 0) | F.isnan(x), x).otherwise(F.round(x / p * s, 0) / s * p)


def _scale(digits: int) -> str:
    # the mantissa is scaled to an integer-valued double and rounded there: both
    # engines then round the same double (never a decimal re-reading of it)
    return f"{float(10 ** (digits - 1))!r}"


def sig_sql(expr: str, digits: int = SIG_DIGITS) -> str:
    """DuckDB counterpart of :func:`sig`."""
    e = f"(({expr})::DOUBLE)"
    p = f"power(10, floor(log10(abs({e}))))"
    return (f"(CASE WHEN {e} IS NULL OR {e} = 0 OR isnan({e}) THEN {e} "
            f"ELSE round({e} / {p} * {_scale(digits)}) / {_scale(digits)} * {p} END)")

"""Exact (and opt-in approximate) quantiles by bracketed selection (``selection``): nothing is sorted, and only the
values around the wanted ranks move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import clean_value, numeric_long
from tablelens.functions.selection import select_ranks

DEFAULT_PROBS = (0.25, 0.5, 0.75)


def frequency(long: DataFrame) -> DataFrame:
    """(column, value, n) from a long (column, value) table."""
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def quantiles_long(long: DataFrame, probs=DEFAULT_PROBS, wide: DataFrame | None = None) -> DataFrame:
    """(column, prob, value) of the series of a long (column, value) table, with linear interpolation (pandas /
    quantile_cont semantics). ``wide``: the same series as columns."""
    probs = [float(p) for p in probs]
    place = lambda n, p: (n - 1) * F.lit(p)
    got = select_ranks(long, probs, lambda n, p: (F.floor(place(n, p)), F.ceil(place(n, p))), wide=wide)
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("pi") + 1)
    h = (F.col("N") - 1) * prob
    return got.select("column", prob.alias("prob"), (F.col("v_lo") + (h - F.floor(h)) * (F.col("v_hi") - F.col("v_lo"))).alias("value"))


def quantiles(df: DataFrame, cols: list[str], probs=DEFAULT_PROBS, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """(column, prob, value) for each numeric column and probability; NULL/NaN skipped.

    Exact by default; ``approx=True`` uses ``percentile_approx`` (bounded sketch) for every column.
    """
    probs = [float(p) for p in probs]
    if not approx:
        return quantiles_long(numeric_long(df, cols), probs, df.select([clean_value(df, c).cast("double").alias(c) for c in cols]))
    prob_tab = F.array(*[F.lit(p) for p in probs])
    return (
        numeric_long(df, cols).groupBy("column")
        .agg(F.percentile_approx("value", probs, accuracy).alias("qs"))
        .select("column", F.posexplode("qs").alias("pi", "value"))
        .select("column", F.element_at(prob_tab, F.col("pi") + 1).alias("prob"), "value")
    )


def quantiles_wide(df: DataFrame, cols: list[str], probs=DEFAULT_PROBS, names=None, **kw) -> DataFrame:
    """One row per column: (column, <name_i> for each prob)."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    q = quantiles(df, cols, probs, **kw)
    aggs = [F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    return q.groupBy("column").agg(*aggs)

"""Feature scaling (M5-M7) with scikit-learn semantics, fitted on one frame and applied to another.

Spark ML's scalers differ (sample std, 0.5 for constants, approximate
quantiles), so these are per-column statistics from one aggregate plus one
projection. Constant columns scale by 1, as scikit-learn does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import clean_value, numeric_columns
from tablelens.functions.quantiles import quantiles_wide


def _apply(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    out = []
    for c in df.columns:
        if c in params:
            centre, scale = params[c]
            x = clean_value(df, c).cast("double")
            out.append(((x - F.lit(centre)) / F.lit(scale)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(out)


def _nz(v):
    return 1.0 if v is None or v == 0 else v


def fit_standard(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.avg(clean_value(df, c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(clean_value(df, c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"] or 0.0, _nz(row[f"s{i}"])) for i, c in enumerate(cols)}


def fit_minmax(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.min(clean_value(df, c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.max(clean_value(df, c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"a{i}"], row[f"b{i}"]
        out[c] = (lo or 0.0, _nz(None if lo is None else hi - lo))
    return out


def fit_robust(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    q = {r["column"]: r for r in quantiles_wide(df, cols, (0.25, 0.5, 0.75), ["q1", "q2", "q3"]).collect()}
    out = {}
    for c in cols:
        r = q.get(c)
        if r is None or r["q2"] is None:
            out[c] = (0.0, 1.0)
        else:
            out[c] = (r["q2"], _nz(r["q3"] - r["q1"]))
    return out


_FITTERS = {"standard": fit_standard, "minmax": fit_minmax, "robust": fit_robust}


def scale(fit_df: DataFrame, apply_df: DataFrame | None = None, method: str = "standard",
          cols: list[str] | None = None) -> DataFrame:
    """Fit the scaler on ``fit_df`` (the training rows) and transform ``apply_df`` (default: the same)."""
    cols = cols or numeric_columns(fit_df)
    params = _FITTERS[method](fit_df, cols)
    return _apply(apply_df if apply_df is not None else fit_df, params)

"""Model explanation (M22, re-aimed from per-row SHAP).

Permutation importance: a feature's values are re-dealt to other rows -- the
row at natural rank i (by key) receives the value of the row at hash rank i --
with two distributed row numbers and one equi-join on the rank, made once for
all features and written; then the model is re-scored with one feature after
the other; the importance is the drop of the primary metric.
Linear contributions are exact: coefficient x (value - training mean).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.ranking import sorted_row_number
from tablelens.operators import models as M
from tablelens.operators.splits import hash_key
from tablelens.session import scratch_path


def permuted(df: DataFrame, key_cols: list[str], columns: list[str], seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """The frame (or its columns ``keep``) with a second value ``_p<i>`` for each of ``columns``, re-dealt by a seeded
    permutation of the rows. The rows are evaluated once; the second ranking reads the first one's slices."""
    ranked = sorted_row_number(df, [], key_cols, "_rn")
    hashed = ranked.select(*key_cols, *[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(columns)], hash_key(key_cols, seed).alias("_h"))
    dealt = sorted_row_number(hashed, [], ["_h", *key_cols], "_rn", keep=[f"_p{i}" for i in range(len(columns))])
    natural = ranked.select("_rn", *[F.col(f"`{c}`") for c in df.columns if keep is None or c in keep])
    return natural.join(dealt, "_rn").drop("_rn")


def permute_column(df: DataFrame, key_cols: list[str], column: str, seed: int = 42) -> DataFrame:
    """The frame with ``column`` re-dealt by a seeded permutation of the rows."""
    return permuted(df, key_cols, [column], seed).select(*[F.col("_p0").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def permutation_importance(model, test: DataFrame, target: str, task: str, features: list[str],
                           key_cols: list[str], seed: int = 42) -> DataFrame:
    """(feature, baseline, permuted, importance) with the primary metric (accuracy or R^2)."""
    metric = "accuracy" if task == "classification" else "r2_score"
    rows = []
    path = scratch_path(test.sparkSession, "permuted")
    used = [c for c in test.columns if c == target or c in features]
    permuted(test, key_cols, features, seed, used).write.parquet(path)
    both = test.sparkSession.read.parquet(path)
    base = M.score(M.predict(model, both, target, task, features), task, target)[metric]
    for i, f in enumerate(features):
        perm = both.select(*[F.col(f"_p{i}").alias(c) if c == f else F.col(f"`{c}`") for c in used])
        s = M.score(M.predict(model, perm, target, task, features), task, target)[metric]
        rows.append((f, float(base), float(s), float(base - s)))
    return test.sparkSession.createDataFrame(rows, "feature string, baseline double, permuted double, importance double")


def linear_contributions(df: DataFrame, coefficients: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Per row and feature: coefficient * (value - mean); the columns keep their names."""
    return df.select(*[((F.col(c).cast("double") - F.lit(means[c])) * F.lit(coefficients[c])).alias(c)
                       if c in coefficients else F.col(c) for c in df.columns])

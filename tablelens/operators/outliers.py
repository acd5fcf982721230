"""Outliers (A22-A25, P8 bounds): IQR fences from the distributed quantiles,
z-scores from population moments. The bounds (one row per column) are fetched
and counted against as literals in one wide pass over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import clean_value, numeric_columns
from tablelens.functions.numfmt import sig
from tablelens.functions.quantiles import quantiles_wide
from tablelens.functions.wide import wide_agg


def iqr_bounds(df: DataFrame, cols: list[str] | None = None, **kw) -> DataFrame:
    """(column, q1, q3, iqr, lower_bound, upper_bound)."""
    cols = cols or numeric_columns(df)
    q = quantiles_wide(df, cols, (0.25, 0.75), ["q1", "q3"], **kw)
    iqr = F.col("q3") - F.col("q1")
    return q.select("column", "q1", "q3", iqr.alias("iqr"),
                    (F.col("q1") - 1.5 * iqr).alias("lower_bound"), (F.col("q3") + 1.5 * iqr).alias("upper_bound"))


def iqr_outliers(df: DataFrame, cols: list[str] | None = None, **kw) -> DataFrame:
    """Count and share (of non-missing values) outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR]."""
    cols = cols or numeric_columns(df)
    fences = {r["column"]: r for r in iqr_bounds(df, cols, **kw).collect()}
    cols = [c for c in cols if c in fences]
    schema = "column string, lower_bound double, upper_bound double"
    b = df.sparkSession.createDataFrame([(c, fences[c]["lower_bound"], fences[c]["upper_bound"]) for c in cols], schema)
    if not cols:
        return b.select("column", F.lit(0).cast("long").alias("iqr_outliers_count"), F.lit(0.0).alias("iqr_outliers_percentage"), "lower_bound", "upper_bound")

    def beyond(c: str) -> F.Column:
        v = clean_value(df, c).cast("double")
        return F.count(F.when((v < F.lit(fences[c]["lower_bound"])) | (v > F.lit(fences[c]["upper_bound"])), 1))

    cnt = wide_agg(df, cols, {"n": lambda c: F.count(clean_value(df, c)), "iqr_outliers_count": beyond})
    return b.join(cnt, "column").select(
        "column", "iqr_outliers_count",
        sig(F.try_divide(F.col("iqr_outliers_count") * 100.0, F.col("n"))).alias("iqr_outliers_percentage"),
        sig("lower_bound").alias("lower_bound"), sig("upper_bound").alias("upper_bound"))


def zscore_outliers(df: DataFrame, cols: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """|x - mean| / std_pop > threshold; a constant column has none."""
    cols = cols or numeric_columns(df)
    moments = {r["column"]: r for r in wide_agg(df, cols, {
        "mean": lambda c: F.avg(clean_value(df, c).cast("double")),
        "std_pop": lambda c: F.stddev_pop(clean_value(df, c).cast("double"))}).collect()}

    def far(c: str) -> F.Column:
        mean, std = moments[c]["mean"], moments[c]["std_pop"]
        if not std:
            return F.count(F.lit(None))
        z = F.abs((clean_value(df, c).cast("double") - F.lit(mean)) / F.lit(std))
        return F.count(F.when(z > threshold, 1))

    cnt = wide_agg(df, cols, {"n": lambda c: F.count(clean_value(df, c)), "z_score_outliers_count": far}).where("n > 0")
    return cnt.select("column", "z_score_outliers_count",
                      sig(F.try_divide(F.col("z_score_outliers_count") * 100.0, F.col("n"))).alias("z_score_outliers_percentage"))


def outlier_rows(df: DataFrame, key: str, cols: list[str] | None = None, k: int = 20, **kw) -> DataFrame:
    """Per column, the first k IQR-outlier rows by key (key replaces the positional index)."""
    cols = cols or [c for c in numeric_columns(df) if c != key]
    b = iqr_bounds(df, cols, **kw).select("column", "lower_bound", "upper_bound")
    wide = df.select(F.col(key).alias("_key"), *[clean_value(df, c).cast("double").alias(c) for c in cols])
    long = wide.unpivot(["_key"], cols, "column", "value").where(F.col("value").isNotNull())
    long = long.join(F.broadcast(b), "column").where(
        (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
    w = Window.partitionBy("column").orderBy("_key", "value")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "column", F.col("_key").alias(key), "value", "rank")


def outlier_cell_count(df: DataFrame, cols: list[str] | None = None, **kw) -> DataFrame:
    """IQR outlier cells summed over all numeric columns."""
    return iqr_outliers(df, cols, **kw).agg(F.sum("iqr_outliers_count").cast("long").alias("outlier_cells"))

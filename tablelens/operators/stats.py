"""Descriptive statistics (A9-A16, A26, A27): moments from one wide aggregate,
quantiles from the distributed quantile operator, categorical stats from A0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import categorical_columns, clean_value, numeric_columns
from tablelens.functions.numfmt import sig
from tablelens.functions.quantiles import quantiles_wide
from tablelens.functions.wide import val_sql, wide_agg
from tablelens.operators.profile import value_frequencies


SUMMARY_METRICS = {
    "count": "count({x})", "mean": "avg({x})", "std": "stddev_samp({x})", "std_pop": "stddev_pop({x})",
    "variance": "var_samp({x})", "min": "min({x})", "max": "max({x})", "skewness": "skewness({x})",
    "kurtosis": "kurtosis({x})", "n_negative": "count(CASE WHEN {x} < 0 THEN 1 END)",
}


def numeric_summary(df: DataFrame, cols: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Single-pass moments per numeric column (raw doubles, not rounded); ``metrics`` picks a subset."""
    cols = cols or numeric_columns(df)
    names = metrics or list(SUMMARY_METRICS)
    return wide_agg(df, cols, {m: (lambda c, m=m: SUMMARY_METRICS[m].format(x=val_sql(df, c))) for m in names})


def quartiles(df: DataFrame, cols: list[str] | None = None, **kw) -> DataFrame:
    """(column, q1, q2, q3) exact linear-interpolated quartiles."""
    cols = cols or numeric_columns(df)
    q = quantiles_wide(df, cols, (0.25, 0.5, 0.75), ["q1", "q2", "q3"], **kw)
    return q.select("column", sig("q1").alias("q1"), sig("q2").alias("q2"), sig("q3").alias("q3"))


def describe_numeric(df: DataFrame, cols: list[str] | None = None, **kw) -> DataFrame:
    """Pandas ``describe()`` per numeric column."""
    cols = cols or numeric_columns(df)
    s = numeric_summary(df, cols, ["count", "mean", "std", "min", "max"])
    q = quantiles_wide(df, cols, (0.25, 0.5, 0.75), ["p25", "p50", "p75"], **kw)
    return s.join(q, "column", "left").select(
        "column", "ordinal", F.col("count").cast("long").alias("count"),
        sig("mean").alias("mean"), sig("std").alias("std"), sig("min").alias("min"),
        sig("p25").alias("p25"), sig("p50").alias("p50"), sig("p75").alias("p75"), sig("max").alias("max"))


def _mode_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, unique_count, top, freq, least, least_freq) from A0; ties: (n desc, value asc)."""
    freq = value_frequencies(df, cols)
    return freq.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("least"),
    ).select("column", "unique_count",
             F.col("top.value").alias("top"), F.col("top.n").alias("freq"),
             F.col("least.value").alias("least"), F.col("least.n").alias("least_freq"))


def categorical_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Unique count, mode, its frequency, least frequent value."""
    cols = cols or categorical_columns(df)
    m = _mode_table(df, cols)
    return m.select("column", "unique_count", F.col("top").alias("most_frequent"),
                    F.col("freq").alias("frequency_of_most_frequent"), F.col("least").alias("least_frequent"))


def categorical_analysis(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """most/least frequent value and count, cardinality ratio (unique / all rows)."""
    cols = cols or categorical_columns(df)
    m = _mode_table(df, cols)
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    n_rows = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n_rows").alias("n_rows")) for c in cols])).alias("s")).select("s.*")
    return m.join(n_rows, "column").select(
        "column", F.col("unique_count").alias("unique_values"),
        F.col("top").alias("most_frequent_value"), F.col("freq").alias("most_frequent_count"),
        F.col("least").alias("least_frequent_value"), F.col("least_freq").alias("least_frequent_count"),
        sig(F.try_divide(F.col("unique_count"), F.col("n_rows"))).alias("cardinality_ratio"))


def describe_all(df: DataFrame, **kw) -> DataFrame:
    """A10: ``describe(include='all')`` -- numeric stats plus unique/top/freq for strings."""
    num = numeric_columns(df)
    cat = categorical_columns(df)
    d = describe_numeric(df, num, **kw).drop("ordinal") if num else None
    out = None
    if d is not None:
        out = d.select("column", "count", F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
                       F.lit(None).cast("long").alias("freq"), "mean", "std", "min", "p25", "p50", "p75", "max")
    if cat:
        m = _mode_table(df, cat)
        cnt = wide_agg(df, cat, {"count": lambda c: F.count(clean_value(df, c))}).select("column", "count")
        c = m.join(cnt, "column").select(
            "column", F.col("count").cast("long").alias("count"), F.col("unique_count").alias("unique"), "top", "freq",
            *[F.lit(None).cast("double").alias(x) for x in ["mean", "std", "min", "p25", "p50", "p75", "max"]])
        out = c if out is None else out.unionByName(c)
    return out


def skewness(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Population (biased) skewness, NULL for constant columns."""
    return numeric_summary(df, cols, ["skewness"]).select("column", F.round("skewness", 6).alias("skewness"))


def kurtosis(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Excess kurtosis, population (biased)."""
    return numeric_summary(df, cols, ["kurtosis"]).select("column", F.round("kurtosis", 6).alias("kurtosis"))


def variance_cv(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Sample variance and coefficient of variation (0 when the mean is 0)."""
    s = numeric_summary(df, cols, ["mean", "std", "variance"])
    return s.select("column", sig("variance").alias("variance"),
                    sig(F.when(F.col("mean") != 0, F.try_divide(F.col("std"), F.col("mean"))).otherwise(F.lit(0.0)))
                    .alias("coefficient_of_variation"))


def scale_ratio(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """max(std) / min(std) over numeric columns; a zero minimum means an infinite ratio."""
    s = numeric_summary(df, cols, ["std"])
    return s.agg(F.max("std").alias("max_std"), F.min("std").alias("min_std")).select(
        sig("max_std").alias("max_std"), sig("min_std").alias("min_std"),
        sig(F.try_divide(F.col("max_std"), F.col("min_std"))).alias("scale_ratio"),
        (F.col("min_std") == 0).alias("infinite"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, n) for a target column; missing target rows are not a class."""
    return (df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """max/min class count and their ratio."""
    cc = class_counts(df, target)
    return cc.agg(F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("max_count"), F.min("n").alias("min_count")).select(
        "n_classes", "max_count", "min_count", sig(F.try_divide(F.col("max_count"), F.col("min_count"))).alias("imbalance_ratio"))


def top_k_per_group(df: DataFrame, group: str, order, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

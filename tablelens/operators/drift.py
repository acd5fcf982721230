"""Drift between a training snapshot and new data.

Numeric columns: two-sample Kolmogorov-Smirnov statistic. Both snapshots are
reduced to value-frequency tables per side, combined, and the empirical CDFs
are running sums in value order -- computed by the distributed running sum, so
a column with billions of distinct values is never ordered in one task.

Categorical columns: the reference's chi-square of category *proportions*
divided by the number of categories; a category unseen in training makes it
infinite (reported as ``infinite = true`` with a NULL score).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import categorical_columns, numeric_columns, numeric_long, string_long
from tablelens.functions.ranking import running_sum


def value_counts(df: DataFrame, cols: list[str], numeric: bool) -> DataFrame:
    """(column, value, n): all that a drift test needs of one snapshot."""
    long = numeric_long(df, cols) if numeric else string_long(df, cols)
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).cast("long").alias("n"))


def drift_ks(train: DataFrame, new: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, ks_statistic)."""
    cols = cols or [c for c in numeric_columns(train) if c in new.columns]
    return ks_from_counts(value_counts(train, cols, True), value_counts(new, cols, True))


def ks_from_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """KS statistic of two (column, value, n) tables: one grouping of both sides, then one running sum."""
    both = (a.select("column", "value", F.col("n").alias("n1"), F.lit(0).cast("long").alias("n2"))
            .union(b.select("column", "value", F.lit(0).cast("long").alias("n1"), F.col("n").alias("n2")))
            .groupBy("column", "value").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")))
    cum = running_sum(both, ["column"], ["value"], ["n1", "n2"])
    tot = cum.groupBy("column").agg(F.max("cum_n1").alias("t1"), F.max("cum_n2").alias("t2"))  # one row per column
    d = cum.join(tot, "column").select(
        "column", F.abs(F.try_divide(F.col("cum_n1"), F.col("t1")) - F.try_divide(F.col("cum_n2"), F.col("t2"))).alias("d"))
    return d.groupBy("column").agg(F.round(F.max("d"), 6).alias("ks_statistic"))


def drift_chi2(train: DataFrame, new: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_categories, chi2_score, infinite)."""
    cols = cols or [c for c in categorical_columns(train) if c in new.columns]
    return chi2_from_counts(value_counts(train, cols, False), value_counts(new, cols, False))


def chi2_from_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    def props(f, name):
        t = f.groupBy("column").agg(F.sum("n").alias("t"))  # one row per column
        return f.join(t, "column").select("column", "value", (F.col("n") / F.col("t")).alias(name))

    j = props(a, "p").join(props(b, "q"), ["column", "value"], "full").fillna(0.0, ["p", "q"])
    s = j.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.sum(F.when(F.col("p") > 0, (F.col("q") - F.col("p")) * (F.col("q") - F.col("p")) / F.col("p"))).alias("chi2"),
        F.max((F.col("p") == 0) & (F.col("q") > 0)).alias("infinite"))
    return s.select("column", "n_categories",
                    F.when(F.col("infinite"), F.lit(None).cast("double"))
                    .otherwise(F.round(F.col("chi2") / F.col("n_categories"), 6)).alias("chi2_score"), "infinite")


def drift_report(train: DataFrame, new: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Per column: test, score, drifted; plus the overall verdict and recommendation columns."""
    num = [c for c in numeric_columns(train) if c in new.columns]
    cat = [c for c in categorical_columns(train) if c in new.columns]
    return report_from_counts(value_counts(train, num, True) if num else None, value_counts(train, cat, False) if cat else None,
                              new, num, cat, len(train.columns), threshold)


def report_from_counts(numbers: DataFrame | None, words: DataFrame | None, new: DataFrame, num: list[str], cat: list[str],
                       n_cols: int, threshold: float) -> DataFrame:
    """The report of ``new`` against a snapshot given by its value counts."""
    parts = []
    if num:
        parts.append(ks_from_counts(numbers, value_counts(new, num, True)).select(
            "column", F.lit("ks").alias("test"), F.col("ks_statistic").alias("score"), F.lit(False).alias("infinite")))
    if cat:
        parts.append(chi2_from_counts(words, value_counts(new, cat, False)).select(
            "column", F.lit("chi2").alias("test"), F.col("chi2_score").alias("score"), "infinite"))
    per = parts[0]
    for p in parts[1:]:
        per = per.unionByName(p)
    per = per.withColumn("drifted", F.col("infinite") | F.coalesce(F.col("score") > threshold, F.lit(False)))
    # the per-column table has #columns rows: a global window over it is small
    n_drifted = F.sum(F.col("drifted").cast("int")).over(Window.partitionBy())
    return per.select("column", "test", "score", "infinite", "drifted",
                      (n_drifted > 0).alias("overall_drift"), (n_drifted > n_cols * 0.5).alias("full_retrain"))

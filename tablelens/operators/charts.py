"""Chart data (C1-C9, C13): the aggregated table behind each chart instead of raw rows.

The reference ships every row to the browser and bins there; here each chart
is a bounded aggregate: bins x columns, groups x stats, strips x columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import clean_value, kind_of, missing_flag, numeric_columns, numeric_long
from tablelens.functions.numfmt import sig
from tablelens.functions.quantiles import frequency, quantiles_long
from tablelens.operators.profile import distinct_counts, null_counts, top_values, value_frequencies


def _bin(value, lo, hi, bins: int):
    width = (hi - lo) / F.lit(float(bins))
    return F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((value - lo) / width), F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 30) -> DataFrame:
    """(column, bin, bin_start, bin_end, n) -- equal-width bins over [min, max], max in the last bin."""
    cols = cols or numeric_columns(df)
    long = numeric_long(df, cols)
    rng = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    h = long.join(F.broadcast(rng), "column").withColumn("bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
    c = h.groupBy("column", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return c.select("column", "bin", sig(F.col("lo") + F.col("bin") * width).alias("bin_start"),
                    sig(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), "n")


def histogram_markers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C1 overlay lines: (column, mean, median)."""
    cols = cols or numeric_columns(df)
    long = numeric_long(df, cols)
    med = quantiles_long(long, (0.5,)).select("column", F.col("value").alias("median"))
    mean = long.groupBy("column").agg(F.avg("value").alias("mean"))
    return mean.join(med, "column").select("column", sig("mean").alias("mean"), sig("median").alias("median"))


def scatter_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """OLS trendline and Pearson r over complete (x, y) pairs."""
    xv, yv = clean_value(df, x).cast("double"), clean_value(df, y).cast("double")
    d = df.select(xv.alias("x"), yv.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("r"),
    ).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", sig("slope").alias("slope"),
             sig("intercept").alias("intercept"), F.round("r", 6).alias("r"))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """C2 at scale: 2-D binned counts (bins x bins cells at most)."""
    xv, yv = clean_value(df, x).cast("double"), clean_value(df, y).cast("double")
    d = df.select(xv.alias("x"), yv.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    # the ranges are four scalars: fetch them and bin with literals
    r = d.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    b = d.select(_bin(F.col("x"), F.lit(r["x0"]), F.lit(r["x1"]), bins).alias("xbin"),
                 _bin(F.col("y"), F.lit(r["y0"]), F.lit(r["y1"]), bins).alias("ybin"))
    return b.groupBy("xbin", "ybin").agg(F.count(F.lit(1)).alias("n"))


def _group_long(df: DataFrame, col: str, group_by: str | None) -> DataFrame:
    g = F.coalesce(F.col(group_by).cast("string"), F.lit("NULL")) if group_by else F.lit("all")
    return df.select(g.alias("column"), clean_value(df, col).cast("double").alias("value")).where(
        F.col("value").isNotNull())


def box_stats(df: DataFrame, col: str, group_by: str | None = None) -> DataFrame:
    """Per group quartiles, fences, whiskers (extreme points inside the fences), outlier count."""
    long = _group_long(df, col, group_by)
    freq = frequency(long)
    q = quantiles_long(long, (0.25, 0.5, 0.75))
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                                   for p, n in [(0.25, "q1"), (0.5, "median"), (0.75, "q3")]])
    qw = qw.withColumn("lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
           .withColumn("hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    s = freq.join(qw.select("column", "lo", "hi"), "column").groupBy("column").agg(
        F.sum("n").alias("n"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("n_outliers"))
    return qw.join(s, "column").select(
        F.col("column").alias("group"), F.col("n").cast("long").alias("n"), sig("q1").alias("q1"),
        sig("median").alias("median"), sig("q3").alias("q3"), sig("lo").alias("lower_fence"),
        sig("hi").alias("upper_fence"), sig("whisker_low").alias("whisker_low"),
        sig("whisker_high").alias("whisker_high"), F.col("n_outliers").cast("long").alias("n_outliers"))


def violin_density(df: DataFrame, col: str, group_by: str, bins: int = 30) -> DataFrame:
    """Per-group density histogram over the common range: n / (group n * bin width)."""
    long = _group_long(df, col, group_by)
    r = long.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    b = long.withColumn("lo", F.lit(r["lo"]).cast("double")).withColumn("hi", F.lit(r["hi"]).cast("double")).withColumn(
        "bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
    c = b.groupBy("column", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return c.select(F.col("column").alias("group"), "bin", "n",
                    sig(F.try_divide(F.col("n"), F.sum("n").over(w) * width)).alias("density"))


def bar_top10(df: DataFrame, cols: list[str]) -> DataFrame:
    """Top-10 value counts per column."""
    return top_values(df, cols, 10)


def pie_shares(df: DataFrame, col: str) -> DataFrame:
    """Category shares when 1 < distinct <= 10 (no rows otherwise)."""
    f = value_frequencies(df, [col])
    s = f.groupBy("column").agg(F.count(F.lit(1)).alias("_d"), F.sum("n").alias("_t")).where(
        (F.col("_d") > 1) & (F.col("_d") <= 10))
    return f.join(F.broadcast(s), "column").select(
        "value", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def missing_bar(df: DataFrame) -> DataFrame:
    """Columns with missing values and their counts."""
    return null_counts(df).where(F.col("null_count") > 0).select("column", "ordinal", "null_count")


def missing_matrix(df: DataFrame, key: str, strips: int = 100) -> DataFrame:
    """Share of missing cells per (row strip by key range, column); strips x columns cells."""
    r = df.agg(F.min(key).cast("double").alias("k0"), F.max(key).cast("double").alias("k1")).first()
    d = df
    strip = _bin(F.col(key).cast("double"), F.lit(r["k0"]).cast("double"), F.lit(r["k1"]).cast("double"), strips).alias("strip")
    cols = df.columns
    flags = d.select(strip, *[missing_flag(df, c).cast("int").alias(c) for c in cols])
    agg = flags.groupBy("strip").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in cols])
    long = agg.unpivot(["strip", "rows"], cols, "column", "missing_share")
    return long.select("strip", "column", "rows", F.round("missing_share", 6).alias("missing_share"))


def chart_plan(df: DataFrame, target: str | None = None, max_charts: int = 20) -> DataFrame:
    """Which charts the full visual report contains, in order, for which columns."""
    spark = df.sparkSession
    num = numeric_columns(df)
    nc = {r["column"]: r["null_count"] for r in null_counts(df).collect()}
    any_missing = sum(nc.values()) > 0
    dtypes = {f.dataType.simpleString() for f in df.schema.fields}
    plan = []
    if len(dtypes) > 1:
        plan.append(("pie", "dtypes"))
    if any_missing:
        plan.append(("bar", ",".join(c for c in df.columns if nc.get(c, 0) > 0)))
    plan += [("histogram", c) for c in num[:5]]
    if len(num) > 1:
        plan.append(("correlation_heatmap", ",".join(num)))
    if target and target in df.columns:
        is_str = kind_of(df.schema[target].dataType) == "categorical"
        nu = distinct_counts(df, [target]).first()["unique_count"]
        plan.append(("bar", target) if is_str or nu < 10 else ("histogram", target))
    if any_missing:
        plan.append(("missing_heatmap", ",".join(df.columns)))
    plan += [("box", c) for c in num[:3]]
    n_rows = next(iter(null_counts(df, df.columns[:1]).collect()))["n_rows"]
    if len(num) >= 3 and n_rows >= 10:
        plan.append(("pca_scatter", ",".join(num)))
    plan = plan[:max_charts]
    return spark.createDataFrame([(i, c, cols) for i, (c, cols) in enumerate(plan)],
                                 "position int, chart string, columns string")

"""Rule-based findings (R1-R9): predicates over per-column facts.

Per-column rules are ``when`` chains over a facts table (#columns rows) built
from the shared aggregates. Dataset-level rules read a handful of scalars
(row count, missing share, max correlation, ...) computed by Spark and emit a
small findings table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import categorical_columns, clean_value, kind_of, numeric_columns
from tablelens.functions.wide import wide_agg
from tablelens.operators.outliers import iqr_outliers
from tablelens.operators.profile import distinct_counts, null_counts
from tablelens.operators.relate import correlation_long
from tablelens.operators.stats import class_counts, numeric_summary

# fixed values: rule thresholds of the reference, in the order they appear there
BINARY_CONFIDENCE, MULTICLASS_CONFIDENCE, REGRESSION_CONFIDENCE = 0.9, 0.7, 0.6
MULTICLASS_MAX_UNIQUE, REGRESSION_MIN_UNIQUE = 20, 20
TEXT_MEAN_LENGTH = 20
HIGH_CARD_RATIO, HIGH_CARD_MIN = 0.5, 50


def _types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(f.name, i, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "column string, ordinal int, dtype string, kind string")


def column_facts(df: DataFrame) -> DataFrame:
    """(column, ordinal, dtype, kind, n_rows, null_count, unique_count, std, skewness, mean_length)."""
    t = _types(df)
    nc = null_counts(df).select("column", "null_count", "n_rows")
    dc = distinct_counts(df, df.columns)
    out = t.join(nc, "column").join(dc, "column")
    num = numeric_columns(df)
    if num:
        out = out.join(numeric_summary(df, num, ["std", "skewness"]).select("column", "std", "skewness"), "column", "left")
    else:
        out = out.withColumn("std", F.lit(None).cast("double")).withColumn("skewness", F.lit(None).cast("double"))
    cat = categorical_columns(df)
    if cat:
        ml = wide_agg(df, cat, {"mean_length": lambda c: F.avg(F.length(clean_value(df, c))).cast("double")})
        out = out.join(ml.select("column", "mean_length"), "column", "left")
    else:
        out = out.withColumn("mean_length", F.lit(None).cast("double"))
    return out


def suggest_targets(df: DataFrame, top: int = 5) -> DataFrame:
    """Candidate targets with task type and confidence, best first (ties in column order)."""
    f = column_facts(df)
    u = F.col("unique_count")
    task = (F.when(u == 2, F.lit("binary_classification"))
            .when((u <= MULTICLASS_MAX_UNIQUE) & (F.col("kind") == "categorical"), F.lit("multiclass_classification"))
            .when((F.col("kind") == "numeric") & (u > REGRESSION_MIN_UNIQUE), F.lit("regression")))
    conf = (F.when(u == 2, F.lit(BINARY_CONFIDENCE))
            .when((u <= MULTICLASS_MAX_UNIQUE) & (F.col("kind") == "categorical"), F.lit(MULTICLASS_CONFIDENCE))
            .when((F.col("kind") == "numeric") & (u > REGRESSION_MIN_UNIQUE), F.lit(REGRESSION_CONFIDENCE)))
    s = f.select("column", "ordinal", task.alias("task_type"), conf.alias("confidence")).where(F.col("task_type").isNotNull())
    return s.orderBy(F.desc("confidence"), "ordinal").limit(top).select("column", "task_type", "confidence")


def modeling_suggestions(df: DataFrame) -> DataFrame:
    """R2: potential targets (null ratio < .1, 2 <= unique <= .9 n) with algorithm and test-size advice."""
    f = column_facts(df)
    n = F.col("n_rows")
    ratio = F.col("null_count") / n
    algos = F.when(n < 1000, F.lit("random_forest,xgboost")).otherwise(F.lit("xgboost,lightgbm,random_forest"))
    tsize = F.when(n < 100, F.lit(0.15)).when(n > 10000, F.lit(0.25)).otherwise(F.lit(0.2))
    return f.where((ratio < 0.1) & (F.col("unique_count") >= 2) & (F.col("unique_count") <= n * 0.9)).select(
        "column", F.col("unique_count").alias("unique_values"), F.round(ratio * 100, 6).alias("null_percentage"),
        algos.alias("recommended_algorithms"), tsize.alias("recommended_test_size"))


def feature_types(df: DataFrame) -> DataFrame:
    """Constant, datetime, binary, numeric, high_cardinality, text or categorical, checked in that order."""
    f = column_facts(df)
    u = F.col("unique_count")
    kind = F.col("kind")
    t = (F.when(u <= 1, "constant")
         .when(kind == "datetime", "datetime")
         .when(kind.isin("numeric", "boolean") & (u == 2), "binary")
         .when(kind.isin("numeric", "boolean"), "numeric")
         .when((kind == "categorical") & (u == 2), "binary")
         .when((kind == "categorical") & (u / F.col("n_rows") > HIGH_CARD_RATIO) & (u > HIGH_CARD_MIN), "high_cardinality")
         .when((kind == "categorical") & (F.col("mean_length") > TEXT_MEAN_LENGTH), "text")
         .when(kind == "categorical", "categorical"))
    return f.select("column", "ordinal", t.alias("feature_type")).where(F.col("feature_type").isNotNull())


def report_bands(df: DataFrame) -> DataFrame:
    """The report's per-column bands (null badge, missing severity, cardinality, shape, outlier severity)."""
    f = column_facts(df)
    num = numeric_columns(df)
    if num:
        o = iqr_outliers(df, num).select("column", "iqr_outliers_count", "iqr_outliers_percentage")
        f = f.join(o, "column", "left")
    else:
        f = f.withColumn("iqr_outliers_count", F.lit(None).cast("long")).withColumn(
            "iqr_outliers_percentage", F.lit(None).cast("double"))
    pct = F.col("null_count") * 100.0 / F.col("n_rows")
    u = F.col("unique_count")
    sk = F.col("skewness")
    op = F.col("iqr_outliers_percentage")
    return f.select(
        "column",
        F.when(pct == 0, "success").when(pct < 10, "warning").otherwise("error").alias("null_badge"),
        F.when(F.col("null_count") == 0, F.lit(None)).when(pct > 50, "critical").when(pct > 20, "high")
        .otherwise("low").alias("missing_severity"),
        F.when(F.col("kind") != "categorical", F.lit(None)).when(u > 50, "High").when(u > 10, "Medium")
        .otherwise("Low").alias("cardinality"),
        F.when(sk.isNull(), F.lit(None)).when(F.abs(sk) < 0.5, "Symmetric").when(sk > 0, "Right-skewed")
        .otherwise("Left-skewed").alias("distribution"),
        F.when(F.coalesce(F.col("iqr_outliers_count"), F.lit(0)) == 0, F.lit(None)).when(op > 10, "High")
        .when(op > 5, "Medium").otherwise("Low").alias("outlier_severity"))


# ------------------------------------------------------------------ dataset-level rules
def _overview(df: DataFrame) -> dict:
    nc = null_counts(df).collect()
    n_rows = nc[0]["n_rows"] if nc else 0
    missing = sum(r["null_count"] for r in nc)
    return {"n_rows": n_rows, "n_columns": len(df.columns), "missing_cells": missing,
            "missing_pct": (missing * 100.0 / (n_rows * len(df.columns))) if n_rows else 0.0}


def _findings(spark, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, r, m) for i, (r, m) in enumerate(rows)], "position int, rule string, message string")


def eda_insights(df: DataFrame, target: str | None = None) -> DataFrame:
    """Dataset size, missing share, strong correlation, class imbalance, width."""
    ov = _overview(df)
    rows = []
    if ov["n_rows"] < 1000:
        rows.append(("small_dataset", "Dataset is small; more data would help model quality."))
    elif ov["n_rows"] > 100000:
        rows.append(("large_dataset", "Large dataset; sampling can speed up exploration."))
    if ov["missing_pct"] > 20:
        rows.append(("high_missing", f"High share of missing values ({ov['missing_pct']:.1f}%); plan imputation."))
    elif ov["missing_pct"] < 1:
        rows.append(("low_missing", "Very few missing values."))
    num = numeric_columns(df)
    if num:
        hit = correlation_long(df, num).where((F.abs("r") > 0.8) & (F.col("r") != 1.0)).limit(1).count()
        if hit:
            rows.append(("high_correlation", "Some features are highly correlated; consider feature selection."))
    if target and target in df.columns:
        is_str = kind_of(df.schema[target].dataType) == "categorical"
        cc = class_counts(df, target).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("mx"), F.min("n").alias("mn")).first()
        if (is_str or (cc["k"] or 0) < 10) and cc["mn"]:
            if cc["mx"] / cc["mn"] > 5:
                rows.append(("class_imbalance", "Significant class imbalance; consider resampling."))
    if ov["n_columns"] > 100:
        rows.append(("high_dimensional", "Many columns; consider dimensionality reduction."))
    return _findings(df.sparkSession, rows)


def eda_recommendations(df: DataFrame, target: str | None = None) -> DataFrame:
    """Imputation, high-cardinality encoding, task family, scaling, sample size."""
    ov = _overview(df)
    rows = []
    if ov["missing_pct"] > 10:
        rows.append(("imputation", "Impute missing values before modelling."))
    cat = categorical_columns(df)
    if cat and distinct_counts(df, cat).where(F.col("unique_count") > 50).limit(1).count():
        rows.append(("high_cardinality_encoding", "Use target encoding or embeddings for high-cardinality categories."))
    if target and target in df.columns:
        if kind_of(df.schema[target].dataType) == "categorical":
            rows.append(("classification", "Classification task: try random forest or gradient boosting."))
        else:
            rows.append(("regression", "Regression task: try random forest, gradient boosting or linear models."))
    num = numeric_columns(df)
    if num:
        s = numeric_summary(df, num, ["std"]).agg(F.max("std").alias("mx"), F.min("std").alias("mn")).first()
        if s["mn"] is not None and (s["mn"] == 0 or s["mx"] / s["mn"] > 100):
            rows.append(("scaling", "Features have very different scales; standardise or normalise."))
    if ov["n_rows"] < 1000:
        rows.append(("more_data", "Few rows: augment or collect more data."))
    return _findings(df.sparkSession, rows)


def suggest_preprocessing(df: DataFrame, target: str | None = None) -> DataFrame:
    """Scaling, selection, reduction, encoding, per-column missing strategy, outliers, feature engineering."""
    facts = {r["column"]: r for r in column_facts(df).collect()}
    types = {r["column"]: r["feature_type"] for r in feature_types(df).collect()}
    n_rows = next(iter(facts.values()))["n_rows"] if facts else 0
    rows = []
    numeric = [c for c in df.columns if types.get(c) == "numeric"]
    if numeric:
        stds = [facts[c]["std"] for c in numeric if facts[c]["std"] is not None]
        mins = df.agg(*[F.min(clean_value(df, c)).cast("double").alias(c) for c in numeric]).first()
        ratio_big = bool(stds) and (min(stds) == 0 or max(stds) / min(stds) > 100)
        any_neg = any(mins[c] is not None and mins[c] < 0 for c in numeric)
        rows.append(("scaling", None, "standard" if ratio_big or any_neg else "minmax"))
    n_features = len(df.columns) - (1 if target else 0)
    if n_features > n_rows:
        rows.append(("feature_selection", None, "univariate"))
    elif n_features > 50:
        rows.append(("feature_selection", None, "model_based"))
    if n_features > 20 and n_rows > 100:
        rows.append(("dimensionality_reduction", None, "pca"))
    if any(t == "categorical" for t in types.values()):
        rows.append(("encoding", None, "one_hot_encoding"))
    if any(t == "high_cardinality" for t in types.values()):
        rows.append(("encoding", None, "target_encoding"))
    for c in df.columns:
        r = facts[c]
        frac = r["null_count"] / r["n_rows"] if r["n_rows"] else 0
        if frac > 0:
            if frac > 0.5:
                s = "drop_column"
            elif r["kind"] == "numeric":
                s = "mean_imputation" if frac < 0.1 else "median_imputation"
            else:
                s = "mode_imputation"
            rows.append(("missing_value_strategy", c, s))
    if numeric:
        cells = iqr_outliers(df, numeric).agg(F.sum("iqr_outliers_count")).first()[0] or 0
        if cells > n_rows * 0.05:
            rows.append(("outlier_treatment", None, "true"))
    if any(t == "datetime" for t in types.values()):
        rows.append(("feature_engineering", None, "datetime_features"))
    if len(numeric) > 1:
        rows.append(("feature_engineering", None, "polynomial_features"))
    if any(t == "text" for t in types.values()):
        rows.append(("feature_engineering", None, "text_features"))
    return df.sparkSession.createDataFrame([(i, a, c, s) for i, (a, c, s) in enumerate(rows)],
                                           "position int, aspect string, column string, suggestion string")


def ml_recommendations(leaderboard: DataFrame, task_type: str) -> DataFrame:
    """Advice from the best primary metric (accuracy or R^2) of a leaderboard (algorithm, score)."""
    rows_in = leaderboard.select("algorithm", "score").collect()
    rows = []
    if not rows_in:
        rows.append(("no_models", "No model trained successfully; check data quality and preprocessing."))
    else:
        best = max(r["score"] or 0.0 for r in rows_in)
        if task_type == "classification":
            if best < 0.7:
                rows.append(("low_accuracy", "Low accuracy: engineer features, add data or try other algorithms."))
            elif best > 0.9:
                rows.append(("high_accuracy", "High accuracy: confirm with cross-validation against overfitting."))
        else:
            if best < 0.5:
                rows.append(("low_r2", "Low R^2: engineer features or try ensembles."))
            elif best > 0.95:
                rows.append(("high_r2", "Very high R^2: check for leakage."))
        top = {r["algorithm"] for r in rows_in if (r["score"] or 0.0) == best}
        if "xgboost" in top:
            rows.append(("xgboost_best", "Boosting performed best; tune it further."))
        if "random_forest" in top:
            rows.append(("random_forest_best", "Random forest performed best; use its importances."))
    return _findings(leaderboard.sparkSession, rows)


def chart_insights(df: DataFrame, target: str | None = None, x: str | None = None, y: str | None = None) -> DataFrame:
    """The one-line insights attached to histograms, box plots, scatter, missing and target charts."""
    num = numeric_columns(df)
    rows = []
    if num:
        s = {r["column"]: r for r in numeric_summary(df, num, ["skewness"]).collect()}
        nc = {r["column"]: r for r in null_counts(df).collect()}
        o = {r["column"]: r for r in iqr_outliers(df, num).collect()}
        for c in num:
            sk = s[c]["skewness"]
            if sk is not None and abs(sk) > 1:
                rows.append(("histogram", c, "right_skewed" if sk > 0 else "left_skewed"))
            else:
                rows.append(("histogram", c, "symmetric"))
            if nc[c]["null_count"] > 0:
                rows.append(("histogram", c, f"missing:{nc[c]['null_count']}"))
            cnt = o[c]["iqr_outliers_count"]
            n_all = nc[c]["n_rows"]
            rows.append(("box", c, f"outliers:{cnt}:{cnt * 100.0 / n_all:.1f}%" if cnt else "no_outliers"))
    if x and y:
        r = correlation_long(df, [x, y]).where((F.col("i") == 0) & (F.col("j") == 1)).first()["r"]
        if r is not None:
            band = "strong" if abs(r) > 0.7 else "moderate" if abs(r) > 0.3 else "weak"
            rows.append(("scatter", f"{x},{y}", band if band == "weak" else f"{band}_{'positive' if r > 0 else 'negative'}"))
    miss = [r for r in null_counts(df).collect() if r["null_count"] > 0]
    if miss:
        rows.append(("missing", None, f"columns_with_missing:{len(miss)}"))
        high = [r for r in miss if r["null_count"] * 100.0 / r["n_rows"] > 50]
        if high:
            rows.append(("missing", None, f"columns_over_50pct:{len(high)}"))
    if target and target in df.columns and kind_of(df.schema[target].dataType) == "categorical":
        cc = class_counts(df, target).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("mx"), F.min("n").alias("mn")).first()
        rows.append(("target", target, f"classes:{cc['k']}"))
        if cc["mn"] and cc["mx"] / cc["mn"] > 5:
            rows.append(("target", target, f"imbalance:{cc['mx'] / cc['mn']:.1f}"))
    return df.sparkSession.createDataFrame([(i, a, c, s) for i, (a, c, s) in enumerate(rows)],
                                           "position int, chart string, column string, insight string")


def correlation_bands(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """The highly correlated pairs with their band: above .9 very strong, else strong."""
    from tablelens.operators.relate import high_corr_pairs
    return high_corr_pairs(df, cols, threshold).withColumn(
        "strength", F.when(F.abs("correlation") > 0.9, "Very Strong").otherwise("Strong"))


def importance_bands(importance: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most important features and their impact. ``importance``: (feature, importance)."""
    a = F.abs("importance")
    return (importance.select("feature", "importance").orderBy(a.desc(), "feature").limit(k)
            .withColumn("impact", F.when(a > 0.2, "Very High").when(a > 0.1, "High").when(a > 0.05, "Moderate").otherwise("Low")))


def correlation_insights(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """How many pairs are highly correlated, and the first three."""
    c = correlation_long(df, cols).where((F.col("i") < F.col("j")) & (F.abs("r") > threshold))
    n = c.count()
    rows = [("correlation", None, f"high_pairs:{n}" if n else "no_high_pairs")]
    rows += [("correlation", f"{r['col1']},{r['col2']}", f"{r['r']:.3f}") for r in c.orderBy("i", "j").limit(3).collect()]
    return df.sparkSession.createDataFrame([(i, a, b, s) for i, (a, b, s) in enumerate(rows)],
                                           "position int, chart string, column string, insight string")


def importance_insights(importance: DataFrame) -> DataFrame:
    """The most important feature, and whether the first five hold more than .8 of the importance."""
    top = importance.orderBy(F.desc("importance"), "feature").limit(5).collect()
    rows = []
    if top:
        rows.append(("importance", top[0]["feature"], f"top:{top[0]['importance']:.3f}"))
        if sum(r["importance"] for r in top) > 0.8:
            rows.append(("importance", None, "concentrated_in_top_5"))
    return importance.sparkSession.createDataFrame([(i, a, b, s) for i, (a, b, s) in enumerate(rows)],
                                                   "position int, chart string, column string, insight string")

"""Composite entry points (E1-E4): profile, full EDA, training, report data.

Each section is an independent DataFrame plan. ``report`` runs the sections one by
one and writes each; one that fails, while planned or while it runs, is recorded
and does not lose the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import categorical_columns, kind_of, numeric_columns
from tablelens.operators import charts, normality, outliers, profile, relate, rules, stats
from tablelens.operators.models import automl
from tablelens.session import scratch_path


def _sections(plan: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    out, errors = {}, {}
    for name, fn in plan.items():
        try:
            out[name] = fn()
        except Exception as e:  # noqa: BLE001 -- isolation per section
            errors[name] = f"{type(e).__name__}: {e}"
    return out, errors


def profile_table(df: DataFrame, order_by: list[str] | None = None, preview_rows: int = 10) -> dict[str, DataFrame]:
    """The upload profile -- quality report, shape, preview, schema listing."""
    order_by = order_by or df.columns[:1]
    return {
        "quality_report": profile.quality_report(df),
        "shape": profile.shape(df),
        "preview": profile.preview_head(df, order_by, preview_rows),
        "schema": profile.schema_listing(df, order_by),
    }


def eda(df: DataFrame, target: str | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The EDA sections as DataFrames, plus the errors of sections whose plan failed."""
    if df.isEmpty():
        raise ValueError("Cannot analyze empty dataset")
    num = numeric_columns(df)
    cat = categorical_columns(df)
    plan: dict[str, Callable[[], DataFrame]] = {
        "overview": lambda: profile.column_kinds(df),
        "descriptive_numeric": lambda: stats.describe_numeric(df, num),
        "descriptive_categorical": lambda: stats.categorical_stats(df, cat),
        "missing_values": lambda: profile.missing_pct(df),
        "missing_patterns": lambda: profile.missing_patterns(df),
        "correlation": lambda: relate.correlation_matrix(df, num),
        "high_correlations": lambda: relate.high_corr_pairs(df, num),
        "distribution": lambda: stats.skewness(df, num).join(stats.kurtosis(df, num), "column")
        .join(stats.quartiles(df, num), "column"),
        "shapiro_wilk": lambda: normality.shapiro_wilk(df, num),
        "anderson_darling": lambda: normality.anderson_darling(df, num),
        "outliers": lambda: outliers.iqr_outliers(df, num).join(outliers.zscore_outliers(df, num), "column"),
        "categorical": lambda: stats.categorical_analysis(df, cat),
        "insights": lambda: rules.eda_insights(df, target),
        "recommendations": lambda: rules.eda_recommendations(df, target),
        "chart_plan": lambda: charts.chart_plan(df, target),
        "chart_correlation": lambda: relate.corr_heatmap(df, num),
        "chart_missing": lambda: charts.missing_bar(df),
    }
    plan |= {f"chart_box_{c}": (lambda c=c: charts.box_stats(df, c)) for c in num}
    if target and target in df.columns:
        if kind_of(df.schema[target].dataType) == "numeric":
            plan["target_relationships"] = lambda: relate.target_correlation(df, target, num)
        else:
            plan["target_relationships"] = lambda: relate.anova_f(df, target, [c for c in num if c != target])
    return _sections(plan)


def train(df: DataFrame, target: str, key_cols: list[str], **kw):
    """Validate the target and run the AutoML pipeline."""
    return automl(df, target, key_cols, **kw)


def report(df: DataFrame, target: str | None = None, automl_result=None) -> DataFrame:
    """One long-format table (section, item, metric, value) for the JSON sink."""
    sections, errors = eda(df, target)
    spark = df.sparkSession
    if automl_result is not None:
        sections["models"] = automl_result.leaderboard.select("algorithm", "score", "rank", "error")
    path, done = scratch_path(spark, "report"), []
    for name, sdf in sections.items():
        key, rest = sdf.columns[0], sdf.columns[1:]
        if not rest:
            continue
        try:  # here the section runs
            long = sdf.select(F.col(f"`{key}`").cast("string").alias("item"), *[F.col(f"`{c}`").cast("string").alias(c) for c in rest])
            (long.unpivot(["item"], rest, "metric", "value").select(F.lit(name).alias("section"), "item", "metric", "value")
             .write.parquet(f"{path}/{len(done)}"))
            done.append(f"{path}/{len(done)}")
        except Exception as e:  # noqa: BLE001 -- one section must not lose the others
            errors[name] = f"{type(e).__name__}: {str(e)[:500]}"
            path = scratch_path(spark, "report")  # a folder that the failed section has not begun
    schema = "section string, item string, metric string, value string"
    failed = spark.createDataFrame([("errors", k, "error", v) for k, v in errors.items()], schema)
    return spark.read.schema(schema).parquet(*done).unionByName(failed) if done else failed

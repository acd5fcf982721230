"""Cleaning and encoding.

Each step fits small per-column statistics (distinct counts, null fractions,
means, medians, modes, category lists, quantile fences) with one distributed
aggregate, brings only those per-column values to the driver, and applies them
as one projection over the table -- the way Spark ML estimators fit and
transform. No step moves rows to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import categorical_columns, clean_value, kind_of, numeric_columns
from tablelens.functions.quantiles import quantiles_wide
from tablelens.functions.ranking import row_number
from tablelens.operators.profile import distinct_counts, null_counts, value_frequencies

ONE_HOT_MAX = 10


@dataclass
class PrepReport:
    rows: list = field(default_factory=list)  # (step_no, step, column, action)

    def add(self, step_no: int, step: str, column: str | None, action: str):
        self.rows.append((step_no, step, column, action))

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "step_no int, step string, column string, action string")


def _ident(c: str):
    return F.col(f"`{c}`")


def is_strict_numeric(dt: T.DataType) -> bool:
    return kind_of(dt) == "numeric"


# ----------------------------------------------------------------------------- P2
def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct non-missing value (an all-NULL column is constant)."""
    dc = distinct_counts(df, df.columns).where(F.col("unique_count") <= 1).select("column").collect()
    return sorted((r["column"] for r in dc), key=df.columns.index)


def drop_constant(df: DataFrame, report: PrepReport | None = None) -> DataFrame:
    cols = constant_columns(df)
    for c in cols:
        report and report.add(1, "removed_constant_columns", c, "dropped_constant")
    return df.drop(*cols)


# ----------------------------------------------------------------------------- P3-P6
def missing_fractions(df: DataFrame) -> dict[str, float]:
    nc = null_counts(df).collect()
    return {r["column"]: (r["null_count"] / r["n_rows"] if r["n_rows"] else 0.0) for r in nc}


def impute_plan(df: DataFrame) -> dict[str, str]:
    """Strategy per column with missing values: drop (> 0.5), mean (< 0.1, numeric), median, mode."""
    plan = {}
    for c, frac in missing_fractions(df).items():
        if frac == 0:
            continue
        if frac > 0.5:
            plan[c] = "dropped_high_missing"
        elif is_strict_numeric(df.schema[c].dataType):
            plan[c] = "mean_imputation" if frac < 0.1 else "median_imputation"
        else:
            plan[c] = "mode_imputation"
    return plan


def fill_values(df: DataFrame, plan: dict[str, str]) -> dict[str, object]:
    """Per-column surrogate: mean / exact median / mode (ties -> smallest value; none -> 'Unknown')."""
    vals: dict[str, object] = {}
    mean_cols = [c for c, s in plan.items() if s == "mean_imputation"]
    med_cols = [c for c, s in plan.items() if s == "median_imputation"]
    mode_cols = [c for c, s in plan.items() if s == "mode_imputation"]
    if mean_cols:
        row = df.agg(*[F.avg(clean_value(df, c).cast("double")).alias(c) for c in mean_cols]).first()
        vals.update({c: row[c] for c in mean_cols})
    if med_cols:
        for r in quantiles_wide(df, med_cols, (0.5,), ["median"]).collect():
            vals[r["column"]] = r["median"]
    if mode_cols:
        freq = value_frequencies(df, mode_cols)
        modes = freq.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
        got = {r["column"]: r["mode"] for r in modes.collect()}
        for c in mode_cols:
            vals[c] = got.get(c, "Unknown")
    return vals


def apply_imputation(df: DataFrame, plan: dict[str, str], vals: dict[str, object]) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = f.name
        s = plan.get(c)
        if s == "dropped_high_missing":
            continue
        if s in ("mean_imputation", "median_imputation"):
            v = vals.get(c)
            out.append(F.coalesce(clean_value(df, c).cast("double"), F.lit(v).cast("double")).alias(c))
        elif s == "mode_imputation":
            v = vals.get(c)
            out.append(F.coalesce(_ident(c), F.lit(v).cast(f.dataType)).alias(c))
        else:
            out.append(_ident(c))
    return df.select(out)


def handle_missing(df: DataFrame, report: PrepReport | None = None) -> DataFrame:
    plan = impute_plan(df)
    vals = fill_values(df, plan)
    for c, s in plan.items():
        report and report.add(2, "missing_value_imputation", c, s)
    return apply_imputation(df, plan, vals)


def impute(df: DataFrame, cols: list[str], strategy: str) -> DataFrame:
    """Impute the given columns with one strategy (mean / median / mode)."""
    plan = {c: f"{strategy}_imputation" for c in cols}
    return apply_imputation(df, plan, fill_values(df, plan))


# ----------------------------------------------------------------------------- P9, P10
def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): code = position of str(value) in the sorted distinct values, from 0.

    The distinct values are numbered by the distributed row number (range
    partitioned), so a huge domain never sits in one task.
    """
    vals = df.select(F.coalesce(_ident(col).cast("string"), F.lit("nan")).alias("value")).distinct()
    return row_number(vals, [], ["value"], "code").select("value", (F.col("code") - 1).cast("int").alias("code"))


def encode_label(df: DataFrame, col: str, null_as_nan: bool = True) -> DataFrame:
    codes = label_codes(df, col)  # the planner sends it to all tasks only if it is small
    key = F.coalesce(_ident(col).cast("string"), F.lit("nan")) if null_as_nan else _ident(col).cast("string")
    joined = df.withColumn("_lv", key).join(codes.withColumnRenamed("value", "_lv"), "_lv", "left")
    return joined.select(*[F.col("code").alias(c) if c == col else _ident(c) for c in df.columns])


def onehot_categories(df: DataFrame, col: str) -> list[str]:
    freq = value_frequencies(df, [col]).select("value").orderBy("value")
    return [r["value"] for r in freq.limit(ONE_HOT_MAX + 1).collect()]


def encode_onehot(df: DataFrame, col: str, cats: list[str] | None = None) -> DataFrame:
    """Dummy columns ``col_value`` (boolean) for every category but the first (sorted)."""
    cats = cats if cats is not None else onehot_categories(df, col)
    others = [_ident(c) for c in df.columns if c != col]
    dummies = [F.coalesce(_ident(col).cast("string") == F.lit(v), F.lit(False)).alias(f"{col}_{v}") for v in cats[1:]]
    return df.select(*others, *dummies)


def encode_categoricals(df: DataFrame, target: str | None = None, report: PrepReport | None = None) -> DataFrame:
    cats = categorical_columns(df)
    if not cats:
        return df
    dc = {r["column"]: r["unique_count"] for r in distinct_counts(df, cats).collect()}
    out = df
    for c in cats:
        if c == target or dc.get(c, 0) > ONE_HOT_MAX:
            out = encode_label(out, c, null_as_nan=False)
            report and report.add(3, "categorical_encoding", c, "label_encoding")
        else:
            out = encode_onehot(out, c)
            report and report.add(3, "categorical_encoding", c, "one_hot_encoding")
    return out


# ----------------------------------------------------------------------------- P8
def winsorize_iqr(df: DataFrame, cols: list[str] | None = None, exclude: tuple | list = ()) -> DataFrame:
    """Clamp numeric columns to [Q1 - 1.5 IQR, Q3 + 1.5 IQR]; NULL stays NULL."""
    cols = [c for c in (cols or numeric_columns(df)) if c not in exclude]
    if not cols:
        return df
    b = {r["column"]: r for r in quantiles_wide(df, cols, (0.25, 0.75), ["q1", "q3"]).collect()}
    out = []
    for c in df.columns:
        if c in b and b[c]["q1"] is not None:
            q1, q3 = b[c]["q1"], b[c]["q3"]
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            x = clean_value(df, c).cast("double")
            out.append(F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x).alias(c))
        else:
            out.append(_ident(c))
    return df.select(out)


# ----------------------------------------------------------------------------- P11
def preprocess(df: DataFrame, target: str | None = None, strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """P2 -> P3..P6 -> P9/P10 -> P8; returns (clean table, step report)."""
    if df.isEmpty():
        raise ValueError("Cannot preprocess empty dataset")
    # every step fits statistics with its own pass over the input: read it once, and only while fitting
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    rep = PrepReport()
    try:
        out = drop_constant(df, rep)
        out = handle_missing(out, rep)
        out = encode_categoricals(out, target, rep)
        if strategy == "auto" or "outlier" in strategy:
            out = winsorize_iqr(out)
            rep.add(4, "outlier_treatment", None, "iqr_winsorize")
    finally:
        df.unpersist()
    return out, rep.to_df(df.sparkSession)


# ----------------------------------------------------------------------------- P14, P15
def drop_rare_classes(df: DataFrame, target: str, min_count: int = 2) -> DataFrame:
    """Keep rows whose target class has at least ``min_count`` rows (left-semi on the kept classes)."""
    keep = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count).select(target)
    return df.join(keep, [target], "left_semi")  # the planner broadcasts the kept classes if they are few


def drop_high_missing(df: DataFrame, threshold: float = 0.5, report: PrepReport | None = None) -> DataFrame:
    """P3 alone: drop columns whose missing fraction is strictly above ``threshold``."""
    drop = [c for c, f in missing_fractions(df).items() if f > threshold]
    for c in drop:
        report and report.add(2, "missing_value_imputation", c, "dropped_high_missing")
    return df.drop(*drop)


def validate_target(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found")
    row = df.agg(F.count(_ident(target)).alias("n"), F.count_distinct(_ident(target)).alias("d")).first()
    if row["n"] == 0:
        raise ValueError(f"Target column '{target}' has only missing values")
    if row["d"] < 2:
        raise ValueError(f"Target column '{target}' needs at least two distinct values")

"""Edge frames (FIXTURES.md F4)."""

import math

import pytest

from tablelens.operators import drift, outliers, prep, profile, relate, stats


def test_empty_raises(spark):
    df = spark.createDataFrame([], "a long, b string")
    with pytest.raises(ValueError):
        profile.quality_report(df)
    with pytest.raises(ValueError):
        prep.preprocess(df)


def test_all_null_column_is_constant(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "a long, b double")
    assert prep.constant_columns(df) == ["b"]
    assert profile.null_counts(df).where("column = 'b'").first()["null_count"] == 3


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "x double")
    assert profile.null_counts(df).first()["null_count"] == 2
    d = stats.describe_numeric(df).first()
    assert d["count"] == 2 and d["mean"] == pytest.approx(2.5)


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    c = {(r["col1"], r["col2"]): r["correlation"] for r in relate.correlation_matrix(df).collect()}
    assert c[("x", "c")] is None and c[("c", "c")] is None and c[("x", "x")] == 1.0


def test_single_row(spark):
    df = spark.createDataFrame([(7.0,)], "x double")
    d = stats.describe_numeric(df).first()
    assert d["count"] == 1 and d["std"] is None and d["p50"] == 7.0


def test_no_numeric_column(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert stats.describe_all(df).count() == 1
    assert relate.correlation_matrix(df).count() == 0


def test_singleton_class_dropped(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k long, y string")
    assert sorted(r["y"] for r in prep.drop_rare_classes(df, "y").collect()) == ["a", "a"]


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    out = prep.impute(df, ["s"], "mode").collect()
    assert sorted(r["s"] for r in out) == ["a", "a", "a", "b", "b"]


def test_iqr_zero(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(5.0,)], "x double")
    o = outliers.iqr_outliers(df).first()
    assert o["lower_bound"] == 1.0 and o["upper_bound"] == 1.0 and o["iqr_outliers_count"] == 1


def test_unseen_category_is_infinite_drift(spark):
    a = spark.createDataFrame([("x",), ("y",)], "c string")
    b = spark.createDataFrame([("x",), ("z",)], "c string")
    r = drift.drift_chi2(a, b).first()
    assert r["infinite"] and r["chi2_score"] is None


def test_encoding_threshold(spark):
    rows = [(i, f"v{i % 11:02d}", f"w{i % 10}") for i in range(44)]
    df = spark.createDataFrame(rows, "k long, eleven string, ten string")
    out, rep = prep.preprocess(df, strategy="none")
    acts = {r["column"]: r["action"] for r in rep.where("step_no = 3").collect()}
    assert acts == {"eleven": "label_encoding", "ten": "one_hot_encoding"}
    assert len([c for c in out.columns if c.startswith("ten_")]) == 9


def test_missing_fraction_boundaries(spark):
    # exactly 10 % missing -> median (rule is < 0.1 for mean); exactly 50 % -> kept (rule is > 0.5 to drop)
    rows = [(i, None if i < 2 else float(i), None if i < 10 else float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, ten double, half double")
    plan = prep.impute_plan(df)
    assert plan == {"ten": "median_imputation", "half": "median_imputation"}


def test_winsorize_keeps_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (None,)], "x double")
    vals = sorted((r["x"] for r in prep.winsorize_iqr(df).collect()), key=lambda v: (v is None, v))
    assert vals[-1] is None and vals[3] < 100 and not math.isnan(vals[3])

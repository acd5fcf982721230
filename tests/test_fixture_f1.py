"""Hand-derived goldens of the fifteen-row table (FIXTURES.md F1)."""

import pytest

from tablelens.operators import outliers, profile, relate, rules, splits, stats


def _by(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_describe(f1):
    d = _by(stats.describe_numeric(f1))
    assert d["id"]["mean"] == pytest.approx(8.0)
    assert d["age"]["std"] == pytest.approx(10.406042, rel=1e-6)
    assert d["income"]["mean"] == pytest.approx(63933.333333, rel=1e-8)
    assert (d["income"]["p25"], d["income"]["p50"], d["income"]["p75"]) == (51000, 60000, 72500)
    assert (d["age"]["p25"], d["age"]["p50"], d["age"]["p75"]) == (27, 35, 43.5)
    assert (d["score"]["min"], d["score"]["max"]) == (75, 98)


def test_moments(f1):
    sk = _by(stats.skewness(f1))
    ku = _by(stats.kurtosis(f1))
    cv = _by(stats.variance_cv(f1))
    assert sk["age"]["skewness"] == pytest.approx(0.311798, abs=1e-6)
    assert sk["income"]["skewness"] == pytest.approx(0.872412, abs=1e-6)
    assert ku["id"]["kurtosis"] == pytest.approx(-1.210714, abs=1e-6)
    assert ku["score"]["kurtosis"] == pytest.approx(-0.895960, abs=1e-6)
    assert cv["id"]["coefficient_of_variation"] == pytest.approx(0.559017, abs=1e-6)
    assert cv["score"]["coefficient_of_variation"] == pytest.approx(0.077717, abs=1e-6)


def test_distinct_and_flags(f1):
    fl = _by(profile.column_flags(f1))
    assert all(fl[c]["unique_count"] == 15 for c in ["id", "age", "income", "score"])
    assert fl["target"]["unique_count"] == 2
    assert {c for c, r in fl.items() if r["is_potential_id"]} == {"id", "age", "income", "score"}
    assert not any(r["is_constant"] or r["is_high_cardinality"] for r in fl.values())
    assert profile.duplicate_rows(f1).first()["duplicate_rows"] == 0


def test_iqr_fences_and_outliers(f1):
    o = _by(outliers.iqr_outliers(f1))
    assert (o["id"]["lower_bound"], o["id"]["upper_bound"]) == pytest.approx((-6, 22))
    assert (o["income"]["lower_bound"], o["income"]["upper_bound"]) == pytest.approx((18750, 104750))
    assert (o["age"]["lower_bound"], o["age"]["upper_bound"]) == pytest.approx((2.25, 68.25))
    assert all(r["iqr_outliers_count"] == 0 for r in o.values())


def test_anova_by_target(f1):
    a = _by(relate.anova_table(f1, "target", ["id", "age", "income", "score"]))
    assert a["id"]["f"] == pytest.approx(0.0, abs=1e-12)
    assert a["age"]["f"] == pytest.approx(0.339393, rel=1e-5)
    assert a["income"]["f"] == pytest.approx(0.085984, rel=1e-5)
    assert a["score"]["f"] == pytest.approx(0.493742, rel=1e-5)


def test_correlation(f1):
    c = {(r["col1"], r["col2"]): r["correlation"] for r in relate.correlation_matrix(f1).collect()}
    assert c[("age", "income")] == pytest.approx(0.970, abs=1e-3)
    assert c[("id", "age")] == pytest.approx(0.132, abs=1e-3)
    pairs = {(r["feature1"], r["feature2"]) for r in relate.high_corr_pairs(f1).collect()}
    assert pairs == {("age", "income"), ("age", "score"), ("income", "score")}
    s = relate.correlation_summary(f1).first()
    assert s["mean_abs_correlation"] == pytest.approx(0.678140, abs=1e-6)
    assert s["min_correlation"] == pytest.approx(0.131999, abs=1e-6)
    assert s["max_correlation"] == 1.0


def test_target_rules(f1):
    t = stats.class_imbalance(f1, "target").first()
    assert (t["max_count"], t["min_count"]) == (8, 7)
    sug = rules.suggest_targets(f1.select("target", "id")).collect()
    assert [(r["column"], r["task_type"], r["confidence"]) for r in sug][0] == ("target", "binary_classification", 0.9)
    assert stats.scale_ratio(f1.drop("target")).first()["scale_ratio"] == pytest.approx(3637.568523, rel=1e-8)


def test_split_and_folds(f1):
    sp = splits.split_random(f1, ["id"], 0.2)
    assert sp.where("split = 'test'").count() == 3 and sp.count() == 15
    train = sp.where("split = 'train'")
    assert splits.cv_fold_count(train, "target").first()["cv_folds"] == 2

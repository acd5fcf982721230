"""Catalog queries against their DuckDB oracle on the smallest driver tables.

A representative subset runs by default; TABLELENS_FULL_ORACLE=1 runs every key.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duckdb_con

SF = "/root/testdata/sf0.001"
SUBSET = ["shape", "null_counts", "missing_patterns", "duplicate_rows", "distinct_counts", "quality_report",
          "describe_numeric", "describe_all", "skewness", "kurtosis", "categorical_analysis", "correlation_matrix",
          "anova_f", "iqr_outliers", "zscore_outliers", "top_values", "impute_median", "preprocess_report",
          "encode_label", "split_stratified", "cv_folds", "drift_ks", "drift_chi2", "histogram", "box_stats",
          "suggest_targets", "report_bands", "select_k_best", "mutual_information", "pca_variance",
          "load_csv_sniff", "load_arff"]
KEYS = sorted(entry.oracle_sql()) if os.environ.get("TABLELENS_FULL_ORACLE") else SUBSET


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF)


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, con, key):
    ok, msg = compare(spark, con, key, entry.queries()[key], entry.oracle_sql()[key], SF)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "column" in df.columns

"""The blocked correlation matrix and the bottom-k sample against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import normality, relate


def test_blocks_of_columns_equal_pairwise_correlations(spark, monkeypatch):
    monkeypatch.setattr(relate, "BLOCK", 4)
    monkeypatch.setattr(relate, "FAN", 2)
    monkeypatch.setattr(relate, "COLUMNS_PER_AGG", 3)
    g = np.random.default_rng(1)
    x = g.standard_normal((300, 10)) @ g.standard_normal((10, 10)) * 10.0 ** g.integers(-3, 6, 10) + 1e5
    x[g.random((300, 10)) < 0.1] = np.nan
    x[:, 3] = 5.0
    x[:, 7] = np.where(np.isnan(x[:, 0]), x[:, 7], 2.0)  # constant where column 0 is there
    rows = [[None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"`a b{k}` double" for k in range(10))).repartition(7)
    got = {(r.i, r.j): r.r for r in relate.correlation_long(df).collect()}
    assert len(got) == 100
    for i in range(10):
        for j in range(10):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if i == 3 or j == 3 or (i != j and (np.ptp(a) == 0 or np.ptp(b) == 0)):
                assert got[i, j] is None, (i, j)
            else:
                assert got[i, j] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9), (i, j)
    assert all(r.r is None for r in relate.correlation_long(df.limit(0)).collect())


def test_many_columns_in_one_scan(spark):
    cols = [f"c{k}" for k in range(400)]
    df = spark.range(500).select(*[(F.pmod(F.xxhash64("id", F.lit(k % 390)), F.lit(1000))).cast("double").alias(c) for k, c in enumerate(cols)])
    got = relate.high_corr_pairs(df, cols).collect()
    assert {(r.feature1, r.feature2) for r in got} == {(f"c{k}", f"c{k + 390}") for k in range(10)}


def test_equal_rows_are_sampled_in_proportion(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7.5).otherwise(F.col("id").cast("double")).alias("x"),
                                    F.when(F.col("id") % 2 == 0, None).otherwise(F.lit(1.0)).alias("y")).repartition(40)
    got = normality.normality_sample(df, ["x", "y"], 5000, fan=4)
    counts = {r["column"]: (r.n, r.hot) for r in got.groupBy("column").agg(F.count("*").alias("n"), F.sum((F.col("value") == 7.5).cast("int")).alias("hot")).collect()}
    assert counts["x"][0] == 5000 and abs(counts["x"][1] - 1667) < 200 and counts["y"] == (5000, 0)
    few = normality.normality_sample(df.limit(30), ["x", "y"], 5000)
    assert few.where("column = 'x'").count() == 30
    assert normality.normality_sample(df.limit(0), ["x"]).count() == 0

"""Invariants for operators without a SQL oracle, and agreement of alternative physical paths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablelens.functions import quantiles as Q
from tablelens.functions import ranking
from tablelens.functions.knn import knn
from tablelens.operators import features, models, normality, resample, splits

SF = "/root/testdata/sf0.001"


def test_quantiles_of_any_shape(spark):
    """Evenly in log scale, one hot value, two values, one value, with missing cells: against numpy."""
    g = np.random.default_rng(0)
    n = 3000
    data = {"log": 10.0 ** g.uniform(-30, 30, n), "hot": np.where(g.random(n) < 0.4, 7.0, g.normal(size=n)), "two": g.integers(0, 2, n).astype(float),
            "one": np.full(n, -3.5), "gaps": np.where(g.random(n) < 0.3, np.nan, g.normal(size=n) * 1e6)}
    df = spark.createDataFrame([tuple(float(data[c][i]) for c in data) for i in range(n)], ", ".join(f"{c} double" for c in data))
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {r["column"]: r for r in Q.quantiles_wide(df, list(data), probs, list("abcdef")).collect()}
    for c, v in data.items():
        for name, want in zip("abcdef", np.quantile(v[~np.isnan(v)], probs)):
            assert got[c][name] == pytest.approx(want, rel=1e-12)


def test_running_sum_of_negative_and_missing_values(spark):
    rows = [(None if i % 5 == 0 else "ab"[i % 2], i, None if i % 7 == 0 else (i % 11) - 5.5) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    got = {r.o: r.cum_v for r in ranking.running_sum(df, ["k"], ["o"], ["v"], num_partitions=9).collect()}
    total = {}
    for k, o, v in rows:
        total[k] = total.get(k, 0.0) + (v or 0.0)
        assert got[o] == pytest.approx(total[k], abs=1e-9)
    alone = {r.o: r.cum_v for r in ranking.running_sum(df, [], ["o"], ["v"], num_partitions=5).collect()}
    assert alone[699] == pytest.approx(sum(v or 0.0 for _, _, v in rows), abs=1e-9)
    assert ranking.running_sum(df.limit(0), ["k"], ["o"], ["v"]).count() == 0


def test_splits_conserve_rows(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus")
    s = splits.split_stratified(o, ["o_orderkey"], "o_orderstatus", 0.2)
    assert s.count() == o.count()
    per = {r["o_orderstatus"]: (r["t"], r["n"]) for r in s.groupBy("o_orderstatus").agg(
        F.sum((F.col("split") == "test").cast("int")).alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    assert all(t == round(n * 0.2 + 1e-9) or abs(t - n * 0.2) <= 0.5 for t, n in per.values())
    f = splits.cv_folds(o, ["o_orderkey"], 5, "o_orderstatus")
    sizes = [r["c"] for r in f.groupBy("fold").agg(F.count(F.lit(1)).alias("c")).collect()]
    assert max(sizes) - min(sizes) <= 3


def test_knn_exact(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    res = knn(e, 3, "vec_id", "embedding", chunk=16).toPandas()
    pdf = e.toPandas()
    X = np.stack(pdf.embedding.apply(lambda v: np.asarray(v, dtype="float64")))
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for i, q in enumerate(pdf.vec_id):
        got = np.sort(res[res.qid == q].dist.to_numpy())
        assert np.allclose(np.sort(D[i])[:3], got, atol=1e-9)


def test_smote_balances_on_segments(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    out = resample.smote(e, "vec_id", "embedding", "label", k=3)
    counts = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(set(counts.values())) == 1
    syn = out.where("synthetic").limit(5).collect()
    base = {r["vec_id"]: np.asarray(r["embedding"]) for r in e.collect()}
    for r in syn:
        v = np.asarray(r["vec"])
        # a synthetic point lies on a segment between two same-class points
        best = min(np.linalg.norm(v - b) for b in base.values())
        assert best < max(np.linalg.norm(a - b) for a in list(base.values())[:2] for b in list(base.values())[:2]) + 10


def test_shapiro_known_values():
    w, p = normality.shapiro_wilk_np([1, 2, 4])
    assert w == pytest.approx(0.9642857, abs=1e-6) and p == pytest.approx(0.6368868, abs=1e-6)
    rng = np.random.default_rng(1)
    assert normality.shapiro_wilk_np(rng.exponential(size=200))[1] < 1e-4
    assert normality.shapiro_wilk_np([1, 2])[1] == 1.0


def test_anderson_darling_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=300), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = normality.anderson_darling(df).first()["anderson_darling_stat"]
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    n = len(z)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, n + 1)
    a2 = -n - np.sum((2 * i - 1) / n * (np.log(cdf) + np.log(1 - cdf[::-1])))
    assert got == pytest.approx(a2, abs=1e-4)


def test_auto_components():
    assert features.auto_components([0.7, 0.2, 0.06, 0.04], 4) == 2
    assert features.auto_components([0.5, 0.3, 0.1, 0.1], 10) == 4


def test_importance_ensemble_sums_to_one(spark):
    imp = spark.createDataFrame([("m1", "a", 0.6), ("m1", "b", 0.4), ("m2", "a", 2.0), ("m2", "c", 1.0)],
                                "model string, feature string, importance double")
    rows = features.importance_ensemble(imp).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0, abs=1e-5)
    assert rows[0]["feature"] == "a" or max(rows, key=lambda r: r["importance"])["feature"] == "a"


def test_model_save_load_equal(spark, f1):
    from tablelens.session import scratch_path
    m = models.train(f1, "target", "decision_tree", "classification", None, ["age", "income", "score"])
    p = scratch_path(spark, "m")
    models.save(m, p)
    prep = models.prepare(f1, "target", "classification", ["age", "income", "score"], extra=["id"])
    a = m.transform(prep).select("id", F.col("prediction").alias("a"))
    b = models.load(p).transform(prep).select("id", F.col("prediction").alias("b"))
    assert a.join(b, "id").where("a <> b").count() == 0


def test_row_number_window_equivalent(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey")
    r = ranking.row_number(o, ["o_custkey"], ["o_orderkey"])
    ref = o.withColumn("ref", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    assert r.join(ref, ["o_orderkey", "o_custkey"]).where("rn <> ref").count() == 0


def test_quantiles_of_many_groups(spark):
    from tablelens.operators import charts
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = {r["group"]: r for r in charts.box_stats(li, "l_extendedprice", "l_orderkey").collect()}
    rows = {}
    for r in li.select("l_orderkey", "l_extendedprice").collect():
        rows.setdefault(str(r.l_orderkey), []).append(r.l_extendedprice)
    assert got.keys() == rows.keys()
    for k, v in rows.items():
        for name, want in zip(("q1", "median", "q3"), np.quantile(v, (0.25, 0.5, 0.75))):
            assert got[k][name] == pytest.approx(want, rel=1e-7)

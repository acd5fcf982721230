"""Training, tuning, ranking, scoring and resampling: stated bounds and exact small answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import models as M
from tablelens.operators import resample


@pytest.fixture(scope="module")
def labelled(spark):
    g = np.random.default_rng(1)
    rows = []
    for i in range(240):
        x, y, b = float(g.normal()), float(g.normal()), bool(g.integers(2))
        rows.append((i, x, y, b, "uvw"[int(g.integers(3))], "yes" if x + 2 * b > 1 else "no", 3 * x - y + (2 if b else 0)))
    df = spark.createDataFrame(rows, "k long, x double, y double, b boolean, c string, cls string, num double")
    return df.withColumn("x", F.when(F.col("k") % 29 == 0, float("nan")).otherwise(F.col("x")))


def test_parameters_are_fitted_as_given(spark):
    p = M.tree_params("random_forest", {"n_estimators": 300, "max_depth": 10, "min_samples_leaf": 7})
    assert (p["trees"], p["depth"], p["min_leaf"]) == (300, 10, 7)
    est = M.make_estimator("random_forest", "classification", 2, {"n_estimators": 211, "max_depth": 9})
    assert est.getNumTrees() == 211 and est.getMaxDepth() == 9
    kinds = {tuple(sorted(M.tree_params(n, None).items())) for n in M.BOOSTERS}
    assert len(kinds) == 3
    assert M.tree_spec("decision_tree", "regression", 0, {"max_depth": 31}).depth == 31 and M.tree_spec("random_forest", "regression", 0, None).depth == 0
    spec = M.tree_spec("xgboost", "classification", 3, {"reg_alpha": 2.5, "reg_lambda": 0.5, "subsample": 0.7})
    assert (spec.l1, spec.l2, spec.subsample, spec.n_classes, spec.second_order, spec.leaves) == (2.5, 0.5, 0.7, 3, True, 0)
    assert M.tree_spec("lightgbm", "regression", 0, None).leaves == 31 and not M.tree_spec("gradient_boosting", "regression", 0, None).second_order
    assert {"reg_alpha", "reg_lambda"} <= set(M.SPACES["xgboost"]) & set(M.SPACES["lightgbm"])
    draws = M.sample_trials("random_forest", 20)
    assert max(d["n_estimators"] for d in draws) > 200 and max(d["max_depth"] for d in draws) > 8


def test_task_inference_ignores_missing_values(spark):
    df = spark.createDataFrame([(float(i % 19),) for i in range(60)] + [(None,), (float("nan"),)], "t double")
    assert M.infer_task(df, "t") == "classification"
    assert M.infer_task(spark.createDataFrame([(float(i),) for i in range(30)], "t double"), "t") == "regression"


@pytest.mark.parametrize("name", M.CLASSIFIERS)
def test_classifiers_beat_the_majority(labelled, name):
    hp = {"n_estimators": 8, "max_depth": 4} if name in M.TREE_DEFAULTS else None
    model = M.train(labelled, "cls", name, "classification", hp, ["x", "y", "b", "c"])
    got = M.score(M.predict(model, labelled, "cls", "classification", ["x", "y", "b", "c"]), "classification", "cls")
    base = labelled.groupBy("cls").count().agg(F.max("count")).first()[0] / 240
    assert got["accuracy"] > max(base, 0.7)
    assert len(M.feature_importance(model, ["x", "y", "b", "c"])) in (0, 4)


def test_a_boolean_feature_counts_and_missing_targets_go(labelled):
    df = labelled.withColumn("num", F.when(F.col("k") < 5, float("nan")).when(F.col("k") < 9, None).otherwise(F.col("num")))
    assert M.prepare(df, "num", "regression", ["x", "b"]).count() == 231
    model = M.train(df, "num", "linear_regression", "regression", None, ["x", "y", "b"])
    names = [n for n, _ in M.feature_importance(model, M.feature_stages(df, "num", "regression", ["x", "y", "b"])[1])]
    assert set(names) == {"x", "y", "b"}
    r2 = M.score(M.predict(model, df, "num", "regression", ["x", "y", "b"]), "regression", "num")["r2_score"]
    assert r2 > 0.9


def test_ridge_equals_the_closed_form(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(80, 2))
    x /= x.std(axis=0, ddof=1)
    y = x @ [2.0, -1.0] + 0.3 * g.normal(size=80)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, t double")
    model = M.train(df, "t", "ridge", "regression", {"alpha": 5.0}, ["a", "b"])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(2), xc.T @ yc)
    assert np.allclose(model.stages[-1].coefficients.toArray(), want, atol=1e-6)


def test_tuning_reports_what_it_fits(labelled, monkeypatch):
    best, trials = M.tune(labelled, "cls", "random_forest", "classification", 2, 2, ["x", "b"], ["k"])
    assert [hp for hp, _ in trials] == M.sample_trials("random_forest", 2) and best in [hp for hp, _ in trials]
    assert all(t.folds_done == 2 and t.error is None for t in trials)
    assert M.tune(labelled, "cls", "random_forest", "classification", 2, 2, ["x", "b"], ["k"], 1e-9) == ({}, [])  # nothing began in time
    monkeypatch.setattr(M.trees, "TASK_BYTES", 1)  # concurrent distributed fits instead of tasks of one job
    monkeypatch.setitem(M.SPACES, "random_forest", {"n_estimators": (2, 3), "max_depth": (2, 3)})
    _, far = M.tune(labelled, "cls", "random_forest", "classification", 2, 2, ["x", "b"], ["k"])
    assert [t.folds_done for t in far] == [2, 2] and all(s > 0.5 and t.error is None for t, (_, s) in zip(far, far))
    assert all(s > 0.5 for _, s in trials) and max(s for _, s in trials) == dict((str(h), s) for h, s in trials)[str(best)]


def test_automl_ranks_and_reports_failures(labelled):
    res = M.automl(labelled.drop("num"), "cls", ["k"], algorithms=["decision_tree", "knn", "nonsense"], tune_trials=0, defaults={"decision_tree": {"max_depth": 4}})
    rows = res.leaderboard.orderBy("rank").collect()
    assert res.task_type == "classification" and {r.algorithm for r in rows} == {"decision_tree", "knn", "nonsense"}
    assert rows[-1].algorithm == "nonsense" and "Unsupported" in rows[-1].error and rows[-1].score is None
    assert rows[0].score >= rows[1].score and {"accuracy", "train_accuracy"} <= set(rows[0].metrics)
    assert res.best_algorithm == rows[0].algorithm
    with pytest.raises(ValueError):
        M.automl(labelled.limit(6), "num", ["k"], task_type="regression")


def test_saved_pipeline_scores_alike(spark, labelled):
    from tablelens.session import scratch_path
    model = M.train(labelled, "num", "linear_regression", "regression", None, ["x", "y", "b"])
    path = scratch_path(spark, "m")
    M.save(model, path)
    a = [round(r.prediction, 9) for r in M.predict(model, labelled, "num", "regression", ["x", "y", "b"]).collect()]
    b = [round(r.prediction, 9) for r in M.batch_score(path, labelled, "num", "regression", ["x", "y", "b"]).collect()]
    assert sorted(a) == sorted(b)


def test_neighbours_with_ties_and_far_coordinates(spark):
    from tablelens.functions.knn import knn
    pts = [(i, [1e5 + (i // 4) * 2.0 ** -10, 1.0]) for i in range(40)]
    a = spark.createDataFrame(pts, "id long, v array<double>")
    want = {}
    for i, v in pts:
        d = sorted((abs(v[0] - w[0]), j) for j, w in pts if j != i)
        want[i] = [j for _, j in d[:5]]
    for df in (a, a.orderBy(F.desc("id")).repartition(3)):
        got = {}
        for r in knn(df, 5, "id", "v").orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.nid)
        assert got == want


def test_neighbours_within_groups(spark):
    from tablelens.functions.knn import knn
    g = np.random.default_rng(7)
    rows = [(i, g.normal(size=3).tolist(), None if i % 17 == 0 else f"g{int(g.exponential(2))}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y string")
    got = {}
    for r in knn(df, 4, "id", "v", chunk=16, group="y").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.nid)
    for i, v, y in rows:
        near = sorted((float(np.linalg.norm(np.array(v) - w)), j) for j, w, z in rows if z == y and j != i and y is not None)
        assert got.get(i, []) == [j for _, j in near[:4]], i


def test_neighbours_among_many_equal_vectors_move_no_copies(spark, monkeypatch):
    """Points that share a vector are compared once, and only the smallest ids of each."""
    from tablelens.functions import knn as K
    made, keep_rows = [], K._materialize
    monkeypatch.setattr(K, "_materialize", lambda df: made.append(keep_rows(df)) or made[-1])
    pts = [(i, [float(i % 4)]) for i in range(4000)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = {}
    for r in K.knn(df, 3, "id", "v", queries=df.where("id < 900"), chunk=2).collect():
        got.setdefault(r.qid, []).append((r.rank, r.nid))
    assert all([n for _, n in sorted(got[i])] == [i % 4, i % 4 + 4, i % 4 + 8] for i in range(900))
    assert made[0].count() == 4 and max(f.count() for f in made) <= 900


def test_neighbours_in_cells_equal_brute_force(spark):
    """Points on a grid, with ties, null and non-finite vectors; cells of 20, so that most answers come from several."""
    from tablelens.functions.knn import knn
    g = np.random.default_rng(11)
    pts = [(i, [float(a) for a in v]) for i, v in enumerate(g.integers(0, 6, (700, 4)))]
    odd = [(9000, None), (9001, [1.0, None, 2.0, 3.0]), (9002, [float("nan"), 1.0, 1.0, 1.0]), (9003, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(pts + odd, "id long, v array<double>")
    asked = [(i, [float(a) for a in v]) for i, v in enumerate(g.normal(3, 3, (60, 4)))] + [(500, [2.0, 2.0, 2.0, 2.0]), (501, None)]
    x = np.array([v for _, v in pts])
    for queries in (None, spark.createDataFrame(asked, "id long, v array<double>")):
        got = {}
        for r in knn(df, 4, "id", "v", queries=queries, chunk=20).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((round(r.dist, 9), r.nid))
        want = {}
        for i, v in pts if queries is None else asked:
            if v is not None:
                d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
                want[i] = sorted((round(float(e), 9), j) for j, e in enumerate(d) if queries is not None or j != i)[:4]
        assert got == want


def test_many_classes_grow_in_one_plan(spark):
    rows = [(i, [float(i), 0.0], i // 3) for i in range(900)] + [(9000 + i, [float(i), 1.0], 5000) for i in range(6)] + [(1, [0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    got = resample.smote(df, "id", "v", "y").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {k: 6 for k in [*range(300), 5000]} | {None: 1}


@pytest.mark.parametrize("grow", [resample.smote, resample.adasyn])
def test_synthetic_points_lie_on_segments(spark, grow):
    g = np.random.default_rng(3)
    rows = [(i, g.normal(size=2).tolist(), "big") for i in range(40)]
    rows += [(9_300_000_000_000 + i, (g.normal(size=2) * 0.4 + 1).tolist(), "small") for i in range(9)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y string")
    out = grow(df, "id", "v", "y", 3).collect()
    made = [r for r in out if r.synthetic]
    assert len({r.id for r in out}) == len(out) and all(r.id < 0 for r in made) and {r.y for r in made} == {"small"}
    assert abs(len(made) - 31) <= (0 if grow is resample.smote else 9)
    own = [np.array(v) for _, v, y in rows if y == "small"]

    def on_a_segment(p):
        for a in own:
            for b in own:
                d = b - a
                t = (p - a) @ d / max(d @ d, 1e-30)
                if -1e-9 <= t <= 1 + 1e-9 and np.linalg.norm(a + t * d - p) < 1e-9:
                    return True
        return False
    assert all(on_a_segment(np.array(r.vec)) for r in made)


def test_impute_knn_is_the_mean_of_the_nearest(spark):
    rows = [(i, float(i % 5), None if i % 7 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, f double, v double")
    for frame in (df, df.orderBy(F.desc("id"))):
        got = {r.id: r.v for r in resample.impute_knn(frame, "id", "v", ["f"], 4).collect()}
        for i, f, v in rows:
            if v is None:
                near = sorted((abs(f - g), j, w) for j, g, w in rows if w is not None)[:4]
                assert got[i] == pytest.approx(sum(w for _, _, w in near) / 4)


def test_tuning_inside_automl_uses_the_folds_of_m3(labelled, monkeypatch):
    monkeypatch.setitem(M.SPACES, "xgboost", {"n_estimators": (2, 4), "max_depth": (2, 3)})
    tuned, folds, fitted = [], [], []
    tune, cut, fit = M.tune, M.cv_folds, M.train
    monkeypatch.setattr(M, "tune", lambda *a: tuned.append((a, tune(*a))) or tuned[-1][1])
    monkeypatch.setattr(M, "cv_folds", lambda df, keys, k, *a: folds.append(k) or cut(df, keys, k, *a))
    monkeypatch.setattr(M, "train", lambda *a: fitted.append(a[4]) or fit(*a))
    M.automl(labelled.drop("num"), "cls", ["k"], algorithms=["xgboost"], tune_trials=2)
    assert folds == [5]  # 192 training rows, more than 5 of either class
    (args, (best, trials)), = tuned
    assert len(trials) == 2 and fitted == [best] and max(s for _, s in trials) > 0.5


SMALL = "/root/testdata/sf0.001"


def test_automl_queries_search_and_share_one_run(spark, monkeypatch):
    import inspect
    from tablelens.plans.catalog import QUERIES
    asked, fitted = [], []
    names, fit = inspect.signature(M.tune), M.train

    def tune(*a, **kw):
        asked.append(names.bind(*a, **kw).arguments)
        return {"n_estimators": 2, "max_depth": 2}, []

    def train(df, target, algorithm, task, hp, feats):
        fitted.append((algorithm, hp))
        return fit(df, target, algorithm, task, {"n_estimators": 2, "max_depth": 2}, feats)
    monkeypatch.setattr(M, "tune", tune)
    monkeypatch.setattr(M, "train", train)
    for key in ("automl_classification", "leaderboard", "ml_recommendations", "automl_regression"):
        assert QUERIES[key][0](spark, SMALL).count() > 0
    assert [(a["algorithm"], a["task"], a["n_trials"], a.get("folds")) for a in asked] == [
        (alg, task, 20, None) for task in ("classification", "regression") for alg in ("random_forest", "xgboost")]
    assert [hp for alg, hp in fitted if alg not in M.SPACES] == [{}] * 4


def test_training_queries_ask_for_the_defaults(spark, monkeypatch):
    import inspect
    from tablelens.plans.catalog import QUERIES

    class Asked(Exception):
        pass

    def asking(names):
        def ask(*a, **kw):
            raise Asked(names.bind(*a, **kw).arguments)
        return ask
    for name in ("train", "tune"):
        monkeypatch.setattr(M, name, asking(inspect.signature(getattr(M, name))))
    for key in [k for k in QUERIES if k.startswith("train_")] + ["feature_importance", "model_roundtrip", "tune_random_search"]:
        with pytest.raises(Asked) as got:
            QUERIES[key][0](spark, SMALL)
        asked = got.value.args[0]
        assert not asked.get("hp"), key
        if key == "tune_random_search":
            assert asked["n_trials"] == 20 and asked.get("folds") is None

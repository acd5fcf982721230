"""Forests and boosting: the distributed growth against the one at hand, and both against plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelens.operators import tree_growth as G
from tablelens.operators import trees as T


def rows(n=400, d=3, classes=0, seed=0):
    g = np.random.default_rng(seed)
    x = g.integers(0, 12, (n, d)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 5) * 3 * x[:, 2] + g.integers(-2, 3, n)
    if classes:
        y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(v.tolist(), float(t), i) for i, (v, t) in enumerate(zip(x, y))], "x array<double>, label double, k long").select(
        array_to_vector("x").alias("features"), "label", "k").coalesce(1)


def predicted(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("k").collect()])


SPECS = {
    "forest": (G.Spec("forest", trees=4, bootstrap=True), 0),
    "forest classes": (G.Spec("forest", 3, trees=4, bootstrap=True, per_node=2, min_leaf=2, min_split=6), 3),
    "tree of depth 3": (G.Spec("forest", trees=1, depth=3), 0),
    "first order": (G.Spec("boost", trees=5, depth=3, rate=0.5, second_order=False), 0),
    "second order": (G.Spec("boost", 2, trees=4, depth=3, rate=0.3, l1=0.2, l2=1.0, min_hessian=0.5, subsample=0.7, colsample=0.7), 2),
    "three classes": (G.Spec("boost", 3, trees=3, depth=2, l2=1.0), 3),
    "leaf-wise": (G.Spec("boost", trees=3, leaves=6, min_leaf=10), 0),
    "more rounds than between writes": (G.Spec("boost", trees=10, depth=1, rate=0.4), 0),
}


@pytest.mark.parametrize("name", SPECS)
def test_distributed_growth_equals_growth_at_hand(spark, name, monkeypatch):
    spec, classes = SPECS[name]
    x, y = rows(classes=classes)
    df = frame(spark, x, y)
    at_hand = T.Trees(spec).fit(df)
    apart = T.Trees(spec, task_bytes=(40 if spec.kind == "forest" else 1) * 27).fit(df)  # nodes above 40 rows are split by aggregates
    want = predicted(at_hand, df)
    assert np.allclose(predicted(apart, df), want)
    apart.broadcast_bytes = at_hand.broadcast_bytes = 0  # rows routed to subtrees, and joined there
    assert np.allclose(predicted(apart, df), want) and np.allclose(predicted(at_hand, df), want)
    assert np.allclose(apart.featureImportances.toArray(), at_hand.featureImportances.toArray()) and abs(at_hand.featureImportances.toArray().sum() - 1) < 1e-9


def test_leaf_wise_growth_takes_fewer_aggregates_than_leaves(spark, monkeypatch):
    x, y = rows()
    df, calls, split = frame(spark, x, y), [], T._split_level
    monkeypatch.setattr(T, "_split_level", lambda *a, **k: calls.append(1) or split(*a, **k))
    spec = G.Spec("boost", trees=1, leaves=12, min_leaf=5)
    apart = T.Trees(spec, task_bytes=27).fit(df)
    assert len(calls) < 10 and np.allclose(predicted(apart, df), predicted(T.Trees(spec).fit(df), df))


def test_matrices_are_read_from_slices_and_chunks():
    import pyarrow as pa
    col = pa.array([bytes([i, i + 1]) for i in range(9)], pa.binary())
    got = T._matrix(pa.chunked_array([col.slice(2, 3), col.slice(0, 0), col.slice(7)]), np.uint8)
    assert got.tolist() == [[2, 3, 4, 7, 8], [3, 4, 5, 8, 9]]


def plain_tree(x, y, depth, classes):
    """Greedy splits by brute force: value(s) of each row's leaf."""
    def worth(t):
        return sum((t == k).sum() ** 2 for k in range(classes)) / len(t) if classes else t.sum() ** 2 / len(t)

    if depth == 0 or len(y) < 2 or (y == y[0]).all():
        return np.full(len(y), np.bincount(y.astype(int), minlength=classes).argmax() if classes else y.mean())
    best = None
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            w = worth(y[left]) + worth(y[~left])
            if best is None or w > best[0] + 1e-9:
                best = (w, left)
    if best is None:
        return np.full(len(y), np.bincount(y.astype(int), minlength=classes).argmax() if classes else y.mean())
    out = np.empty(len(y))
    for side in (best[1], ~best[1]):
        out[side] = plain_tree(x[side], y[side], depth - 1, classes)
    return out


@pytest.mark.parametrize("classes,depth", [(0, 3), (3, 3), (0, 99), (2, 99)])
def test_a_tree_equals_greedy_splits(classes, depth):
    x, y = rows(150, classes=classes, seed=4)
    spec = G.Spec("forest", classes, trees=1, depth=0 if depth == 99 else depth)
    bins = x.T.astype(np.uint8)
    grown, start = G.grow_all(spec, bins, [12] * 3, y, np.arange(len(y)))
    mine, plain = G.predict_all(spec, grown, start, bins), plain_tree(x, y, depth, classes)
    if classes:  # equal worths may be cut elsewhere: the same errors then, not the same leaves
        assert abs((mine == y).mean() - (plain == y).mean()) < 0.02
    else:
        assert np.allclose(mine, plain) or abs(((mine - y) ** 2).sum() / max(((plain - y) ** 2).sum(), 1e-9) - 1) < 0.02


def test_a_boosting_step_is_the_newton_step_with_penalties():
    y = np.array([1.0, 1.0, 0.0, 1.0, 0.0, 0.0])
    x = np.array([[0, 0, 0, 1, 1, 1]], np.uint8)
    spec = G.Spec("boost", 2, trees=1, depth=1, rate=1.0, l1=0.25, l2=2.0)
    (_, nodes), = G.grow_all(spec, x, [2], y, np.arange(6))[0]
    for side in (0, 1):
        r = y[x[0] == side] - 0.5
        want = np.sign(r.sum()) * max(abs(r.sum()) - 0.25, 0) / (3 * 0.25 + 2.0)
        assert nodes.value[nodes.left[0] + side, 0] == pytest.approx(want)


def test_bootstrap_draws_are_poisson_and_keep_no_order():
    w = G.bootstrap_weights(G.Spec("forest", bootstrap=True), 3, np.arange(50_000))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert (w[::-1] == G.bootstrap_weights(G.Spec("forest", bootstrap=True), 3, np.arange(50_000)[::-1])).all()


def test_bins_are_exact_where_values_are_few_and_quantiles_else(spark):
    g = np.random.default_rng(3)
    x = np.stack([g.integers(0, 200, 3000), g.standard_normal(3000), np.full(3000, 7.0)], axis=1)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    a, b, c = T.bin_edges(df, 3)
    v = np.unique(x[:, 0])
    assert np.allclose(a, (v[1:] + v[:-1]) / 2) and len(c) == 0
    counts = np.bincount(np.searchsorted(b, x[:, 1], side="left"))
    assert len(b) == 255 and counts.max() < 40


def test_a_forest_of_unlimited_depth_learns_what_a_deep_tree_can(spark):
    """Held-out fit of the forest, within bounds that a single-machine forest meets on these rows."""
    x, y = rows(3000, seed=9)
    model = T.Trees(G.Spec("forest", trees=30, bootstrap=True)).fit(frame(spark, x[:2400], y[:2400]))
    p = predicted(model, frame(spark, x[2400:], y[2400:]))
    best = 1 - 2.0 / y[2400:].var()  # the noise -2..2 has variance 2
    r2 = 1 - ((p - y[2400:]) ** 2).mean() / y[2400:].var()
    assert best - 0.03 < r2 <= 1


def test_models_are_saved_alone_and_in_pipelines(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import StandardScaler
    x, y = rows(200)
    df = frame(spark, x, y).withColumnRenamed("features", "raw")
    model = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features"), T.Trees(G.Spec("forest", trees=3, bootstrap=True))]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert np.allclose(predicted(PipelineModel.load(str(tmp_path / "m")), df), predicted(model, df))


def test_search_reports_trials_errors_and_the_deadline(spark):
    x, y = rows(120, classes=2)
    df = frame(spark, x, y).withColumn("fold", (F.col("k") % 3).cast("int"))
    data = T.binned(df, others=("fold",))
    good, bad = G.Spec("forest", 2, trees=3, bootstrap=True), G.Spec("boost", 2, trees=2, depth=2, per_node="?")
    (scores, none), (zero, error) = T.search_at_hand(data, [good, bad], 3)
    assert len(scores) == 3 and min(scores) > 0.5 and none is None and zero == [0.0] * 3 and "TypeError" in error
    assert T.search_at_hand(data, [good], 3, deadline=0.0) == [([], None)]
    assert T.fit_and_score(data, G.Spec("forest", 2, trees=3), 1, task_bytes=20 * 27) > 0.5


@pytest.mark.parametrize("classes", [2, 3])
def test_rows_alike_in_all_bins_are_grown_as_one(classes, monkeypatch):
    from tablelens.operators import tree_growth as G
    g = np.random.default_rng(3)
    n = 6_000
    x = np.stack([g.integers(0, 20, n), g.integers(0, 4, n), g.integers(0, 5, n)]).astype(np.uint8)
    y = ((x[0] > 9) + (g.random(n) < 0.3)).clip(0, classes - 1).astype(float)
    specs = [G.Spec("forest", n_classes=classes, trees=4, per_node=1, bootstrap=True, min_leaf=3), G.Spec("forest", n_classes=classes, trees=1),
             G.Spec("boost", n_classes=classes, trees=5, depth=5, subsample=0.7, colsample=0.7, l1=0.3, l2=1.0, min_hessian=1.0),
             G.Spec("boost", n_classes=classes, trees=5, leaves=9, min_leaf=20), G.Spec("boost", n_classes=classes, trees=5, depth=3, second_order=False)]
    grown, grow = [], G.grow
    monkeypatch.setattr(G, "grow", lambda x, *a: grown.append(x.shape[1]) or grow(x, *a))
    for spec in specs:
        trees, start = G.grow_all(spec, x, [20, 4, 5], y, np.arange(n) * 7)
        assert max(grown) <= 400  # distinct rows, not all of them
        with monkeypatch.context() as plain:
            plain.setattr(G, "distinct", lambda x: None)
            expected, _ = G.grow_all(spec, x, [20, 4, 5], y, np.arange(n) * 7)
            predicted = G.predict_all(spec, expected, start, x)
        for (_, a), (_, b) in zip(trees, expected, strict=True):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.left == b.left).all()
            np.testing.assert_allclose(a.value, b.value, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(G.predict_all(spec, trees, start, x), predicted, rtol=1e-9)
        grown.clear()


def test_sparse_cells_split_alike_sorted_or_counted():
    g = np.random.default_rng(3)
    n, n_nodes, n_bins = 3000, 200, 256
    x, node = g.integers(0, n_bins, n).astype(np.uint8), g.integers(0, n_nodes, n)
    c, y = g.integers(1, 4, n).astype(float), g.normal(size=n)
    spec, sums = G.Spec("forest"), [c * y]
    totals = (np.bincount(node, c), np.bincount(node, c), [np.bincount(node, sums[0])])
    order = G._sorted_rows(x, np.arange(n), node, n_bins)
    assert (order == np.lexsort((np.arange(n), x, node))).all()
    counted = G._feature_best(x, node, n_nodes, n_bins, c, c, sums, totals, spec)
    by_rows = G._feature_best_sorted(x, order, np.bincount(node, minlength=n_nodes), c, c, sums, totals, spec)
    assert np.allclose(counted[0], by_rows[0]) and (counted[1] == by_rows[1]).all()
    child = np.where(g.random(n) < 0.1, -1, 2 * node + (x > 100)).astype(np.int32)  # dealt on to the children, some rows done
    on = child >= 0
    got = G._dealt(order, child, np.bincount(child[on], minlength=2 * n_nodes))
    rows = np.flatnonzero(on)
    assert (got == rows[np.lexsort((rows, x[rows], child[rows]))]).all()


def test_rows_of_a_node_travel_packed(spark, monkeypatch):
    x, y = rows(2000)
    df, seen, write = frame(spark, x, y), [], T._write
    monkeypatch.setattr(T, "_write", lambda d, name: seen.append((name, out := write(d, name))) or out)
    model = T.Trees(G.Spec("forest", trees=3, bootstrap=True), task_bytes=500 * 27).fit(df)
    model.broadcast_bytes = 0
    assert len(predicted(model, df)) == 2000
    routed = dict(seen)["routed"]
    assert routed.where("tree IS NOT NULL").count() < 200 and routed.where("tree IS NULL").agg(F.sum("n")).first()[0] == 2000


@pytest.mark.parametrize("gather", [0, 1 << 24])
def test_boosting_keeps_blocks_whose_sums_meet_by_key_or_on_the_driver(spark, monkeypatch, gather):
    monkeypatch.setattr(T, "GATHER_BYTES", gather)
    x, y = rows()
    df = frame(spark, x, y)
    spec = G.Spec("boost", trees=3, depth=3, rate=0.5)
    kept = T._kept_blocks(T.binned(df).df, spec, np.array([1.5])).collect()
    assert sum(len(b[1]) for b in kept) == 400 and all(b[2] is None and (b[3] == 1.5).all() for b in kept)  # no draws: no ids
    aggregates, met = [], T._Kept.met
    monkeypatch.setattr(T._Kept, "met", lambda *a: aggregates.append(1) or met(*a))
    apart = T.Trees(spec, task_bytes=27).fit(df)
    assert len(aggregates) <= 9  # three levels a round
    assert np.allclose(predicted(apart, df), predicted(T.Trees(spec).fit(df), df))


def test_rows_find_their_leaves_in_deep_and_in_small_trees():
    g = np.random.default_rng(5)
    x = g.integers(0, 200, (3, 3000)).astype(np.uint8)
    y = g.normal(size=3000)
    for depth, n in ((2, 3000), (0, 3000), (0, 40)):  # the last with fewer rows than nodes
        (_, nodes), = G.grow_all(G.Spec("forest", trees=1, depth=depth), x, [200] * 3, y, np.arange(3000))[0]
        want = []
        for k in range(n):
            a = 0
            while nodes.feature[a] >= 0:
                a = nodes.left[a] + int(x[nodes.feature[a], k] > nodes.cut[a])
            want.append(a)
        assert nodes.leaf(x[:, :n]).tolist() == want
